from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estateloom.llm import mixing as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 1000), st.integers(0, 5)), min_size=1, max_size=8), st.one_of(st.none(), st.floats(1, 5000)))
def test_water_filling(rows, total):
    plan = M.water_fill([M.Allotment(str(i), t, a, r) for i, (t, a, r) in enumerate(rows)], total)
    assert all(s.tokens <= s.most * (1 + 1e-9) + 1e-9 for s in plan)
    most, given_ = sum(s.most for s in plan if s.target > 0), sum(s.tokens for s in plan)
    if total is not None:
        assert abs(given_ - min(total, most)) <= 1e-6 * max(1.0, most)
    free = [s for s in plan if 0 < s.tokens < s.most * (1 - 1e-9)]
    assert all(abs(s.tokens / s.target - free[0].tokens / free[0].target) <= 1e-6 * free[0].tokens / free[0].target for s in free)


def documents(spark):
    rows = [(i, "big", "word " * (5 + i % 30)) for i in range(3000)] + [(10000 + i, "small", "word " * (3 + i % 5)) for i in range(60)]
    rows += [(20000, None, "x y z"), (20001, "unlisted", "x y z"), (20002, "small", None), (20003, "big", "")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def targets(spark):
    return spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 3), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")


def test_shares_are_met_within_repeats(spark):
    got = {r.source: r for r in M.shares(documents(spark), targets(spark)).collect()}
    assert abs(got["big"].actual_share - 0.7 / 0.95) < 0.01 and abs(got["small"].actual_share - 0.25 / 0.95) < 0.01
    assert got["none"].mixed_tokens == 0 and got["small"].most_repeats <= 3


def test_clamped_and_seeded(spark):
    d, t = documents(spark), targets(spark)
    a = M.mixed(d, t, total_tokens=40_000, seed=1)
    assert {r.source for r in a.select("source").distinct().collect()} == {"big", "small"}
    assert a.where("source = 'small'").agg({"repeats": "min"}).first()[0] == 3  # clamped at its repeats
    rows = {(r.doc_id, r.repeats) for r in a.collect()}
    assert rows == {(r.doc_id, r.repeats) for r in M.mixed(d.repartition(7), t, total_tokens=40_000, seed=1).collect()}
    one, two = (M.mixed(d, t, total_tokens=9_000, seed=s).agg({"n_tokens": "sum"}).first()[0] for s in (1, 2))
    assert abs(one - two) < 400


def test_empty(spark):
    assert M.mixed(documents(spark).limit(0), targets(spark)).count() == 0
    assert M.mixed(documents(spark), targets(spark).limit(0)).count() == 0


def test_queries_mix_at_the_size_of_the_corpus(spark, tmp_path):
    from estateloom.llm.queries import QUERIES

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    targets(spark).write.parquet(f"{tmp_path}/mix_targets.parquet")
    of = {r.source: r for r in QUERIES["p8_shares"](spark, str(tmp_path)).collect()}
    total = sum(r.available_tokens for r in of.values())
    assert of["small"].epochs == 3 and of["small"].mixed_tokens == 3 * of["small"].available_tokens  # clamped
    assert of["big"].epochs > 0.9  # the excess comes here
    mix = {r.source: r for r in QUERIES["p8_mix"](spark, str(tmp_path)).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n"), F.min("repeats").alias("least")).collect()}
    assert mix["small"].least == 3 and all(mix[s].n == of[s].mixed_tokens for s in mix)
    assert abs(sum(r.n for r in mix.values()) - total) < 0.01 * total
