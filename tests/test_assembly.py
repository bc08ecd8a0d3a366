import random
import re

from pyspark.sql import functions as F

from estateloom.operators import chunking as C
from estateloom.operators import questions as Q
from estateloom.operators import tables as T
from estateloom.sources import sinks

TABLE = "doc_id bigint, table_no int, header array<string>, rows array<array<string>>"


def size(t):
    return max(1, len(t) // 4)


def test_overlap_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["\n\n".join(" ".join("w" * rng.randint(1, 60) + rng.choice([".", "!", ","]) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = {(r.doc_id, r.chunk_no): r.chunk for r in C.packed_chunks(df, 120).collect()}
    for r in C.overlapped_chunks(df, 120, 30).collect():
        want: list[str] = []
        if r.chunk_no and sum(map(size, plain[r.doc_id, r.chunk_no - 1].split("\n\n"))) > 30:
            used = 0
            for s in reversed(re.split(r"(?<=[.!?])\s+", plain[r.doc_id, r.chunk_no - 1])):
                if used + size(s) > 30:
                    break
                want.insert(0, s)
                used += size(s)
        assert (r.carried, r.chunk) == (" ".join(want), plain[r.doc_id, r.chunk_no])


def test_row_groups_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [[["x" * rng.randint(1, 200), "y"] for _ in range(rng.randint(0, 30))] for _ in range(30)]
    df = spark.createDataFrame([(i, 0, ["a", "b"], r) for i, r in enumerate(rows)], TABLE)
    got = {}
    for g in T.row_groups(df, most_rows=5, budget=80).orderBy("doc_id", "group_no").collect():
        got.setdefault(g.doc_id, []).append((g.first_row, g.n_rows, g.tokens))
    for i, r in enumerate(rows):
        want, room = [], max(80 - size("a | b"), 20)
        for k, row in enumerate(r):
            t = size(" | ".join(row))
            if want and want[-1][1] < 5 and want[-1][2] + t <= room:
                want[-1] = (want[-1][0], want[-1][1] + 1, want[-1][2] + t)
            else:
                want.append((k, 1, t))
        assert got.get(i, []) == want


def test_cleaned_tables(spark):
    rows = [["a", "1"], ["Host", "v-CPU"], ["Total", "3"], ["b", "2"], ["Sub-totals of all", "9"], ["this is a note", ""], ["and one more note", ""]]
    df = spark.createDataFrame([(1, 0, ["Host", "vCPU"], rows), (2, 0, ["a"], [])], TABLE)
    got = {r.doc_id: r for r in T.cleaned_tables(df).collect()}
    assert got[1].rows == [["a", "1"], ["b", "2"]] and (got[1].n_totals, got[1].n_repeats, got[1].n_notes) == (2, 1, 2)
    assert got[2].rows == []


def test_first_of_sources_and_terms(spark):
    a = spark.createDataFrame([(1, "own")], "k int, v string")
    b = spark.createDataFrame([(1, "other"), (2, "only")], "k int, v string")
    assert {(r.k, r.v) for r in Q.first_of_sources(a, b, "k").collect()} == {(1, "own"), (2, "only")}
    t = spark.createDataFrame([("What is the RTO of 99.9% services?",)], "t string").select(Q.terms(F.col("t"))).first()[0]
    assert t == ["rto", "of", "99.9%"]


def test_passages(spark):
    docs = spark.createDataFrame([(1, "Nothing here. The database Orion fails over by hand! Orion ends."), (2, "Weather is fine."), (3, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "How does database Orion fails?")], "query_id bigint, text string")
    rows = Q.passages(docs, q).collect()
    assert [(r.query_id, r.doc_id, r.passage, r.hits) for r in rows] == [(7, 1, "The database Orion fails over by hand!", 3)]


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.overwrite_partitions(df, path, ["k"])
    sinks.overwrite_partitions(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    sinks.write_answers(spark.createDataFrame([("=1+1", 1), ("ok", 2), (None, 3)], "t string, n int"), f"{tmp_path}/c")
    assert {r.t for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()} == {"'=1+1", "ok", None}


def test_segments(spark):
    text = "intro\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n| c |\n"
    got = [(r.segment_no, r.kind) for r in T.segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")).collect()]
    assert got == [(0, "prose"), (1, "table"), (2, "prose"), (3, "table")]


def test_stacked_headers(spark):
    rows = [["Host", "Avg", "Max", "Avg"], ["a", "1", "2", "3"]]
    df = spark.createDataFrame([(1, 0, ["", "CPU", "", "Memory"], rows), (2, 0, ["x", ""], [["a", "b"], ["c", "d"]])], TABLE)
    got = {r.doc_id: (r.n_header_rows, r.header) for r in T.stacked_headers(df).collect()}
    assert got == {1: (2, ["Host", "CPU Avg", "Max", "Memory Avg"]), 2: (1, ["x", "x"])}
