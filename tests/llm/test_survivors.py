from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from estateloom.llm import survivors as S

SCHEMA = (
    "assessment_id string, entity_type string, entity_key string, attribute string, claim_id string, ord bigint, value string, evidence_quote string, confidence double, "
    "source_document_id string, extracted_at timestamp"
)
T0 = datetime(2026, 1, 1, tzinfo=UTC)


def claims(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(id_, ord_, value="v", quote="q", conf=0.5, doc=None, days=0, key="h", attr="os", ts=True):
    return ("a", "server", key, attr, id_, ord_, value, quote, conf, doc, T0 + timedelta(days=days) if ts else None)


def docs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, precedence int, extra string").drop("extra")


def result(spark, rows, documents=(("d", 90, ""),)):
    df = S.survivors(claims(spark, rows), docs(spark, list(documents)))
    return {(r.entity_key, r.attribute): (r.value_claim_id, r.quote_claim_id, r.value) for r in df.collect()}


def test_ranking_field_by_field(spark):
    got = result(
        spark,
        [
            row("1", 1, "n/a", "said", doc="d", key=" H.corp "), row("2", 2, "x", " ", doc="d", key="h", attr="OS"), row("3", 3, "y", "later", doc="gone", conf=0.99),
            row("4", 4, "low", "q", conf=float("nan"), attr="tier"), row("5", 5, "null", "q", conf=None, attr="tier"), row("6", 6, "won", None, conf=0.1, attr="tier"),
            row("7", 7, "old", "q", attr="dc"), row("8", 8, "new", "q", attr="dc", days=1), row("9", 9, "new2", "q", attr="dc", days=1),
            row("10", 10, attr="single"), row("10", 10, attr="single"),
            row("11", 11, "-", None, attr="none"), row("12", 12, None, "", attr="none"),
        ],
    )
    assert got == {("h", "os"): ("2", "1", "x"), ("h", "tier"): ("6", "4", "won"), ("h", "dc"): ("8", "8", "new"), ("h", "none"): ("", "", None)}


def test_currency_decides_where_times_are_missing(spark):
    history = [row(f"{k}{i}", 10 * i + j, v, key=f"h{i}", days=40 * j) for i in range(5) for j, (k, v) in enumerate([("a", "RHEL 7"), ("b", "RHEL 8"), ("c", "RHEL 9")])]
    untimed = [row("x", 100, "RHEL 7", key="u", ts=False), row("y", 101, "RHEL 8", key="u", ts=False)]
    got = result(spark, history + untimed)
    assert got["u", "os"][0] == "y"  # the lower ord loses: RHEL 8 follows RHEL 7
    reversed_ = [row("x", 100, "RHEL 8", key="u", ts=False), row("y", 101, "RHEL 7", key="u", ts=False)]
    assert result(spark, history + reversed_)["u", "os"][0] == "x"


def test_untimed_values_meet_timed_ones_and_chains_close(spark):
    step = lambda a, b, n, tag: [row(f"{tag}{i}{j}", 1000 + 10 * i + j, v, key=f"{tag}{i}", days=40 * j) for i in range(n) for j, v in enumerate((a, b))]
    history = step("AIX 1", "AIX 2", 5, "a") + step("RHEL 7", "RHEL 8", 3, "b") + step("RHEL 8", "RHEL 9", 3, "c")
    pairs = [row("t", 1, "AIX 1", key="mixed", days=400), row("u", 2, "AIX 2", key="mixed", ts=False)]  # the untimed one is later
    pairs += [row("t2", 1, "AIX 2", key="timed"), row("u2", 2, "AIX 1", key="timed", ts=False)]  # the timed one is later
    pairs += [row("x", 1, "RHEL 7", key="chain", ts=False), row("y", 2, "RHEL 9", key="chain", ts=False)]  # only RHEL 8 links them
    pairs += [row("old", 1, "AIX 2", key="two", days=1), row("new", 2, "AIX 1", key="two", days=2), row("none", 3, "AIX 2", key="two", ts=False)]
    pairs += [row("p", 1, "new", key="free", days=3), row("q", 2, "other", key="free", ts=False)]  # nothing is learned of these
    got = result(spark, history + pairs)
    assert {k: got[k, "os"][0] for k in ("mixed", "timed", "chain", "two", "free")} == {"mixed": "u", "timed": "t2", "chain": "y", "two": "none", "free": "p"}
    assert got["mixed", "os"][1] == "u"  # quotes go by the same order


def strongest(links, a, b):
    """Brute force: over all simple paths the greatest least vote."""
    best, todo = 0, [(a, 10**9, {a})]
    while todo:
        at, w, seen = todo.pop()
        for (x, y), v in links.items():
            if x == at and y not in seen:
                if y == b:
                    best = max(best, min(w, v))
                else:
                    todo.append((y, min(w, v), seen | {y}))
    return best


def test_order_of_values_equals_brute_force_and_has_no_cycle(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        links = {}
        for a in range(7):
            for b in range(a):
                if rng.random() < 0.6:
                    links[(a, b) if rng.random() < 0.5 else (b, a)] = rng.randrange(1, 6)
        learned = spark.createDataFrame([(a, b, v) for (a, b), v in links.items()], "earlier bigint, later bigint, votes bigint")
        got = {(r.fact, r.later) for r in S.value_order(S.beatpaths(learned, spark.range(7).toDF("fact"))).collect()}
        want = {(a, b) for a in range(7) for b in range(7) if a != b and strongest(links, a, b) > strongest(links, b, a)}
        assert got == want
        assert all((a, d) in got for a, b in got for c, d in got if b == c)  # transitive, so free of cycles as no pair is in it both ways


def test_cycles_are_settled_by_majority(spark):
    learned = spark.createDataFrame([(7, 8, 5), (8, 9, 5), (9, 7, 1)], "earlier bigint, later bigint, votes bigint")
    got = {(r.fact, r.later): r.contradicted for r in S.value_order(S.beatpaths(learned, spark.range(10).toDF("fact"))).collect()}
    assert got == {(7, 8): True, (8, 9): True, (7, 9): True}


def test_learned_precedence_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [row(str(i), i, rng.choice("pqrs"), key=rng.choice("kl"), days=rng.randrange(60) / 4) for i in range(300)]
    keyed = S.keyed_claims(claims(spark, rows))
    code = {r.value: r.fact for r in keyed.select("value", "fact").distinct().collect()}
    net = {}
    for key in "kl":
        seq = [r[6] for r in sorted((r for r in rows if r[2] == key), key=lambda r: (r[10], r[5]))]
        for a, b in zip(seq, seq[1:], strict=False):
            if a != b:
                net[a, b] = net.get((a, b), 0) + 1
                net[b, a] = net.get((b, a), 0) - 1
    want = {(code[a], code[b]) for (a, b), n in net.items() if n > 0}
    assert {(r.earlier, r.later) for r in S.learned_precedence(keyed).collect()} == want


def test_empty_and_clashing_columns(spark):
    df = claims(spark, [row("1", 1), row("2", 2)])
    assert S.survivors(df.limit(0), docs(spark, [("d", 1, "")])).count() == 0
    clash = df.withColumn("precedence", F.lit(1)).withColumn("fact", F.lit("x"))
    assert S.survivors(clash, docs(spark, [("d", 1, "")]).limit(0), with_fields=False).count() == 1
