import json
import random

from estateloom.operators import schema_drift as S

SCHEMA = "record_id bigint, assessment_id string, feed_id string, file_seq int, row_no int, payload string"


def feed(spark, files):
    rows, k = [], 0
    for seq, records in files.items():
        for n, r in enumerate(records):
            k += 1
            rows.append((k, "a", "f", seq, n, r if r is None or isinstance(r, str) else json.dumps(r)))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {tuple(r)[1:] for r in S.changes(df).collect()}


def hosts(n, seed=1):
    rng = random.Random(seed)
    return [{"name": f"abc-web-{i:02}", "cpu": rng.choice([1, 2, 4, 8, 16, 48]), "mem": rng.choice([4, 12, 24, 96]), "site": rng.choice(["x", "y", "z"])} for i in range(n)]


def test_all_kinds_of_change(spark):
    h = hosts(12)
    one = [{"Hostname": x["name"], "Cores": x["cpu"], "RAM (MB)": x["mem"] * 1024, "site": x["site"], "old": x["cpu"] * 7} for x in h]
    two = [{"vcpu": f"{x['cpu']} vCPU", "FQDN": x["name"].upper() + ".corp.example", "memory_gb": x["mem"], "site": x["site"], "fresh": i} for i, x in enumerate(h[2:])]
    got = found(feed(spark, {1: one, 2: two}))
    assert got == {
        (2, "renamed", "Hostname", "FQDN"), (2, "renamed", "Cores", "vcpu"), (2, "retyped", "Cores", "vcpu"), (2, "renamed", "RAM (MB)", "memory_gb"), (2, "removed", "old", ""), (2, "added", "", "fresh"),
    }


def test_no_change_from_order_nulls_and_resent_rows(spark):
    h = hosts(6)
    one = [{"Hostname": x["name"], "Cores": x["cpu"]} for x in h]
    two = [{"Cores": x["cpu"], "Hostname": x["name"]} if i else {"Hostname": x["name"], "Cores": None} for i, x in enumerate(h)]
    df = feed(spark, {1: one, 2: two})
    assert found(df.union(df)) == set()
    assert found(feed(spark, {1: one, 3: [{"a": 1}]})) == set()  # no file 2


def test_bad_payloads_and_empty_table(spark):
    df = feed(spark, {1: [None, "not json", "[1]", {"Hostname": "abc-web-01", "a": 1}], 2: [{"Hostname": "abc-web-01", "a": True}]})
    assert found(df) == {(2, "retyped", "a", "a")}
    assert found(df.limit(0)) == set()


def test_consistent_table_and_branches(spark):
    h = hosts(8)
    one = [{"Hostname": x["name"], "Cores": x["cpu"], "RAM (MB)": x["mem"] * 1024} for x in h]
    two = [{"VM": x["name"], "Cores": f"{x['cpu']} cores", "odd_name": x["mem"]} for x in h]
    df = feed(spark, {1: one, 2: two})
    rows = S.consistent_table(df).collect()
    assert len(rows) == 16
    by = {(r.file_seq, r.host): r for r in rows}
    for x in h:
        for seq in (1, 2):
            assert (by[seq, x["name"]].cores, by[seq, x["name"]].memory_gb) == (x["cpu"], float(x["mem"]))
    kinds = {(r.column, r.kind): (r.first_seq, r.appeared_later) for r in S.type_branches(df).collect()}
    assert kinds["Cores", "number"] == (1, False) and kinds["Cores", "text"] == (2, True)


def test_alternatives_are_kept_by_path(spark):
    one = [{"Hostname": "abc-web-01", "m": {"v": 1, "w": True}, "a": [1, "x"]}]
    two = [{"Hostname": "abc-web-01", "m": {"v": "1"}, "a": [[2]]}]
    three = [{"Hostname": "abc-web-01", "m": [1], "a": []}]
    got = {(r.column, r.kind): (r.first_seq, r.last_seq, r.n_rows, r.appeared_later) for r in S.type_branches(feed(spark, {1: one, 2: two, 3: three})).collect()}
    assert got == {
        ("Hostname", "text"): (1, 3, 3, False), ("m", "object"): (1, 2, 2, False), ("m", "array"): (3, 3, 1, True), ("m.v", "number"): (1, 1, 1, False), ("m.v", "text"): (2, 2, 1, True), ("m.w", "boolean"): (1, 1, 1, False),
        ("m[]", "number"): (3, 3, 1, False), ("a", "array"): (1, 3, 3, False), ("a[]", "number"): (1, 1, 1, False), ("a[]", "text"): (1, 1, 1, False), ("a[]", "array"): (2, 2, 1, True), ("a[][]", "number"): (2, 2, 1, False),
    }


def test_renames_are_followed_to_the_end(spark):
    h = [{"name": f"abc-web-{i:02}", "os": ["RHEL 8", "AIX 7", "SLES 15"][i % 3]} for i in range(9)]
    files = {k: [{"Hostname": x["name"], name: x["os"]} for x in h] for k, name in enumerate(("xq", "yq", "zq", "os"), 1)}
    df = feed(spark, files)
    assert {r.file_seq for r in S.consistent_table(df).where("os like '%8'").collect()} == {1, 2, 3, 4}


def test_lost_files_are_bridged_on_request(spark):
    h = hosts(6)
    files = {1: [{"Hostname": x["name"], "Cores": x["cpu"]} for x in h], 3: [{"Hostname": x["name"], "vcpu": x["cpu"]} for x in h]}
    df = feed(spark, files)
    assert found(df) == set()
    assert {tuple(r)[1:] for r in S.changes(df, over_gaps=True).collect()} == {(3, "renamed", "Cores", "vcpu")}


def test_agreement_equals_brute_force(spark):
    """Random feeds: the renamed pairs are those whose values agree on at least 0.6 of the common hosts."""
    rng = random.Random(11)
    h = [f"abc-web-{i:02}" for i in range(30)]
    a, b, c = ({x: rng.randrange(1, 10**6) for x in h} for _ in range(3))
    keep = {x: rng.random() < 0.75 for x in h}
    one = [{"Hostname": x, "left": a[x], "mid": b[x], "gone": c[x]} for x in h]
    two = [{"Hostname": x, "right": a[x] * 1024 if keep[x] else 7, "centre": b[x] if rng.random() < 0.3 else 3} for x in h[5:]]
    share = sum(keep[x] for x in h[5:]) / 25
    got = found(feed(spark, {1: one, 2: two}))
    assert ((2, "renamed", "left", "right") in got) == (share >= 0.6)
    assert {(2, "removed", "mid", ""), (2, "added", "", "centre"), (2, "removed", "gone", "")} <= got
