"""Vectors and distances against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from paysift.operators import cases as C
from paysift.operators import drift as DR
from paysift.plans import inputs as I
from tests.conftest import SF


def test_embedding_counts_every_gram(spark):
    texts = ["", " ", "a", "abcd", "abcdabcd", "Large payment, decision block; first payment seen on this card", "ñandú ñandú"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.embed(F.col("t")).alias("v"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.trim("t")) - 3, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(F.lower(F.trim("t")), i, F.lit(4))), F.lit(384))).alias("b"))
    for r in frame.collect():
        counts = [0.0] * 384
        if r.t.strip():
            for b in r.b:
                counts[b] += 1
        norm = math.sqrt(sum(x * x for x in counts)) or 1.0
        assert len(r.v) == 384 and all(abs(x - c / norm) < 1e-12 for x, c in zip(r.v, counts))


def test_gaps_cross_buckets(spark, monkeypatch):
    """Distances don't depend on how values are dealt into buckets of neighbours."""
    rng = random.Random(1)
    rows = [("reference" if i % 3 else "current", float(rng.randrange(40)), rng.gauss(0, 1)) for i in range(300)]
    frame = spark.createDataFrame(rows, "part string, a double, b double")
    want = sorted(map(tuple, DR.numeric_distances(frame, ["a", "b"]).collect()))
    monkeypatch.setattr(DR, "BUCKET", 7)
    got = sorted(map(tuple, DR.numeric_distances(frame, ["a", "b"]).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(abs(x[5] - y[5]) < 1e-9 for x, y in zip(got, want))


def test_nearest_equals_all_pairs(spark, monkeypatch):
    """Blocks of any size give what all pairs give, ties, repeated vectors, zeros, nulls and other lengths included."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(120)] + [(200, None), (None, [1.0, 1.0, 1.0]), (201, [1.0, 2.0]), (202, [2.0, 4.0])]
    frame = spark.createDataFrame(rows, "transaction_id long, embedding array<double>")
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v]
    good = [(i, unit(v)) for i, v in rows if i is not None and v]
    want = []
    for i, v in good:
        near = sorted((-round(sum(x * y for x, y in zip(v, w)), 9), j) for j, w in good if j != i and len(w) == len(v))[:5]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
    for size in (7, 8192):
        monkeypatch.setattr(C, "BLOCK", size)
        got = sorted((r.query_id, r["rank"], r.transaction_id) for r in C.nearest(frame, frame).collect())
        assert got == sorted(want)


def test_an_index_over_all_given_vectors(spark):
    """Recall of every case's five neighbours, and how much is compared for it."""
    stored = I.cases(spark, SF)
    index = C.index_cases(stored)
    probes = C.probes_for(index, stored)
    got = {(r.query_id, r.transaction_id): r.similarity for r in C.nearest_by_index(stored, index, probes=probes).collect()}
    want = {(r.query_id, r.transaction_id): r.similarity for r in C.nearest(stored, stored).collect()}
    assert index.rows.count() == stored.count() and len(got) == len(want)
    assert len(got.keys() & want.keys()) >= 0.9 * len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys())
    every = C.nearest_by_index(stored, index, probes=len(index.centroids))
    assert {(r.query_id, r.transaction_id) for r in every.collect()} == want.keys()


def test_an_index_of_clusters_compares_little(spark, monkeypatch):
    """Cases in clusters, one of which has a third of all and more than a block: few cells give all neighbours."""
    monkeypatch.setattr(C, "BLOCK", 50)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[0 if i % 3 == 0 else i % 30]]) for i in range(900)] + [(2000, None), (None, centres[0]), (2001, [1.0, 2.0])]
    stored = spark.createDataFrame(rows, "transaction_id long, embedding array<double>")
    index = C.index_cases(stored, cells=30)
    probes = C.probes_for(index, stored)
    assert probes <= 6 and index.counts.agg(F.max("n")).first()[0] > 50
    found = {(r.query_id, r.transaction_id) for r in C.nearest_by_index(stored, index, probes=probes).collect()}
    want = {(r.query_id, r.transaction_id) for r in C.nearest(stored.where("size(embedding) = 16"), stored).collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_cells_are_compared_a_few_rows_at_once(spark, monkeypatch):
    """However many cells there are, a task holds SCORES similarities, and each row finds the same cells."""
    rng, sizes = np.random.default_rng(2), spark.sparkContext.accumulator(0)
    centroids, vectors = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist(), 8) for i, v in enumerate(vectors)], "k long, v array<double>, dims int").coalesce(1)
    monkeypatch.setattr(C, "SCORES", 1000)

    def batches(given):
        for batch in given:
            sizes.add(batch.num_rows > 25)
            yield batch

    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, kind, old=type(rows).mapInArrow: old(df, lambda given: batches(run(given)), kind))
    got = C._cells(rows, centroids, 3).collect()
    want = np.argsort(-np.round(vectors @ centroids.T, 9), axis=1, kind="stable")[:, :3]
    assert len(got) == 900 and all(want[r.k][r.place] == r.cell for r in got) and sizes.value == 0


def test_an_empty_index(spark):
    none = spark.createDataFrame([], "transaction_id long, embedding array<double>")
    index = C.index_cases(none)
    assert C.probes_for(index, none) == 1 and C.nearest_by_index(none, index).collect() == []


def test_sketches_of_days_add_up(spark):
    from paysift.operators import marts as M

    rows = spark.range(200_000).select(F.col("id").alias("transaction_id"), F.pmod(F.col("id") * 7, F.lit(30_000)).alias("card_key"), F.timestamp_seconds(F.pmod("id", F.lit(40)) * 86_400).alias("event_time"))
    days = M.daily_sketches(rows)
    whole = M.summary_of_days(days).first()
    assert days.count() == 40 and whole.rows == 200_000 and abs(whole.transactions / 200_000 - 1) < 0.05 and abs(whole.cards / 30_000 - 1) < 0.05
    assert M.summary_of_days(days.limit(0)).first().rows is None
