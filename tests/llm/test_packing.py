import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estateloom.llm import packing as P


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 6))
def test_constraints_hold_and_nothing_is_lost(sizes, rule, docs):
    s = np.array(sizes)
    bins = P.best_fit(s, 100, docs, 6000.0, rule)
    assert (bins >= 0).all()
    for b in set(bins):
        x = s[bins == b]
        assert len(x) == 1 or (x.sum() <= 100 and len(x) <= docs and (x.astype(float) ** 2).sum() <= 6000)


def test_near_the_bound():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 700, 3000)
    bins = P.best_fit(s, 2048, 64, 2048.0**2)
    assert len(set(bins)) <= np.ceil(s.sum() / 2048) * 1.01


def test_whole_texts(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(i, "some text here " * (i % 40)) for i in range(300)] + [(900, long), (901, None), (902, "")], "doc_id bigint, text string")
    rows = P.packed(df, capacity=256, shard_items=100).collect()
    sizes = {r.doc_id: 0 for r in rows}
    for r in rows:
        sizes[r.doc_id] += r.n_tokens
    want = {r.doc_id: r.n_tokens for r in P.sized(df, ["doc_id"]).collect()}
    assert sizes == want
    per = {}
    for r in rows:
        if r.container_id:
            per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
    assert max(per.values()) <= 256
    cut = [r for r in rows if r.piece_no > 0]
    assert {r.doc_id for r in cut} <= {d for d, n in want.items() if n > 256}
    assert {r.doc_id for r in rows if r.container_id is None} == {d for d, n in want.items() if n == 0}
    assert P.packed(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [64, 512])
def test_utilisation(spark, capacity):
    df = spark.createDataFrame([(i, "some text here " * (1 + i % 9)) for i in range(400)], "doc_id bigint, text string")
    u = P.utilisation(P.packed(df, capacity=capacity), capacity).first()
    assert u.containers <= u.least_containers * 1.1 + 1 and u.most_tokens <= capacity


def test_limits_that_bind_hold(spark):
    import random

    rng = random.Random(4)
    df = spark.createDataFrame([(i, "word " * rng.choice([3, 40, 200, 900, 1500, 5000])) for i in range(300)] + [(300, None), (301, "")], "doc_id bigint, text string")
    bounds = {"max_documents": 4, "max_attention": 2048**2 / 2}
    for rule in ("norm", "dot"):
        made = P.packed(df, rule=rule, weights=(1.0, 1.0, 1.0), **bounds)
        assert tuple(P.violations(made, df, **bounds).first()) == (302, 0, 0, 0, 0, 0)
        u = P.utilisation(made, **bounds).first()
        assert u.full_by_documents > 0 and u.full_by_attention > 0 and u.containers >= u.least_containers
    assert P.violations(P.packed(df), df, **bounds).first().over_attention + P.violations(P.packed(df), df, **bounds).first().over_documents > 0
