import math

import numpy as np
import pytest

from paysift.llm.pivots import top_products


def brute(rows, every=50, k=5):
    vectors = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in vectors:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in vectors if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def same(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, dims int, v string")
    assert sorted(tuple(r) for r in top_products(frame, **kw).collect()) == brute(rows)


@pytest.mark.parametrize("block", [32, 4096])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.1 * rng.normal(size=16)]) for i in range(400)]
    same(spark, rows, block=block, query_block=3, step=16)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (100, [1.0, 2.0, 3.0]), (8, [-1.5, 0.25])]
    same(spark, rows)


def test_ties_and_few(spark):
    same(spark, [(i, [0.5, 0.5]) for i in range(0, 200, 10)])
    same(spark, [(0, [1.0])])


def test_nothing(spark):
    assert top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pivots_spare_products(spark):
    """On vectors in clusters far fewer products are computed than there are pairs, and blocks with no chance are left out."""
    from paysift.llm.pivots import search

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.1 * rng.normal(size=16)]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    done = search(frame, block=128, query_block=4, step=16).groupBy("query_id").agg({"evaluated": "sum", "vec_id": "count"}).collect()
    assert len(done) == 60 and sum(r["sum(evaluated)"] for r in done) < 0.2 * 60 * 3000
    same(spark, rows, block=128, query_block=4, step=16)


def test_no_join_on_one_key(spark, monkeypatch):
    """Rows of one number of components meet by block; with broadcasts off the plan joins vectors on the block number too."""
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(300)]
    monkeypatch.setattr("paysift.llm.pivots.SAMPLE", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(spark, rows, block=16, query_block=2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
