import random
import zlib

import numpy as np
import pytest

from paysift.llm import langid, quality, toxicity
from tests.llm.conftest import ODD


def syllables(rng, pool, n):
    return " ".join("".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) for _ in range(n))


POOLS = {"aa": "the ing er on st nd".split(), "bb": "sch ung keit en der".split(), "cc": "eau tion qu è le".split()}
LABELS = "doc_id long, toxic int, quality int, extra string"


def test_languages(spark):
    rng = random.Random(4)
    rows = [(i, syllables(rng, POOLS[lang], rng.randrange(20, 200)), lang, "s", 1) for i, lang in enumerate(rng.choice(list(POOLS)) for _ in range(300))]
    rows += [(i, t, None, "s", 1) for i, t in ODD] + [(999, "12 34 !!", "aa", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, v int")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 10}
    held = [(by[i].lang_pred, lang) for i, _, lang, *_ in rows if i is not None and 10 <= i < 300 and by[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.98
    assert by[999].lang_pred == "und" and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} >= {"und"}


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.fit(docs)).first().lang_pred == "und"
    assert langid.predict(docs.where("false"), langid.fit(docs.where("false"))).count() == 0


def slow_segments(scores):
    """All maximal segments: the best one, then those left and right of it."""

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] + 1e-12 or abs(total - best[2]) <= 1e-12 and j + 1 - i < best[1] - best[0]):
                    best = (i, j + 1, total)
        return [] if best is None else within(a, best[0]) + [best] + within(best[1], b)

    return within(0, len(scores))


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(60):
        scores = np.round(rng.normal(-0.2, 1, rng.integers(1, 30)), 3)
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in slow_segments(list(scores))]


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(10, 700):
        words = syllables(rng, POOLS["aa"], rng.randrange(15, 150)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "badword", "nastier" + rng.choice(["s", "ly", "er"])])
        rows.append((i, " ".join(words), "en", 1))
        labels.append((i, int(toxic), 1, "x"))
    truth = {i: t for i, t, *_ in labels}
    odd = [(i, t, "en", 1) for i, t in ODD]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, segments string, label int")
    table = spark.createDataFrame([*labels, (None, 1, 1, "x"), (5, None, None, "x"), (4, 0, 0, "x"), (4, 0, 1, "x")], LABELS)
    got = toxicity.score(docs, toxicity.fit(docs, table)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.predicted for r in got if r.doc_id in (1, 2, 3)} == {0}


@pytest.mark.parametrize("labels", [[], [(5, 0, 0, "x"), (6, 0, 0, "x")]])
def test_no_labels_to_learn(spark, docs, labels):
    table = spark.createDataFrame(labels, LABELS)
    frame = docs(*ODD)
    assert {r.predicted for r in toxicity.score(frame, toxicity.fit(frame, table)).collect()} == {0}
    assert len(quality.score(frame, quality.fit(frame, table)).collect()) == len(ODD)
    empty = frame.where("false")
    assert toxicity.score(empty, toxicity.fit(empty, table)).count() == quality.score(empty, quality.fit(empty, table)).count() == 0


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(10, 500):
        text = ". ".join(syllables(rng, POOLS[rng.choice(list(POOLS))], rng.randrange(5, 40)).capitalize() for _ in range(rng.randrange(1, 12)))
        good = rng.random() < 0.8
        if not good:
            junk = rng.randrange(3)
            text = text.upper().replace(" ", "!! ") if junk == 0 else " ".join(w + "###" for w in text.split()) if junk == 1 else " ".join(w for w in text.split() for _ in range(20))
        rows.append((i, text, 1.0))
        labels.append((i, 0, int(good), "x"))
    truth = {i: q for i, _, q, _ in labels}
    docs = spark.createDataFrame(rows + [(i, t, 1.0) for i, t in ODD], "doc_id long, text string, x double")
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    x = np.array([quality.statistics(t.encode()) for _, t, _ in rows[:50]])
    z = (x - model.centre) / model.scale
    logs = []
    for offset, mean, factor in model.classes:  # scores against densities with the covariance itself
        cov = np.linalg.inv(factor.T @ factor)
        d = z - mean
        logs.append(offset - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T))
    assert np.allclose(model.probability(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500))), atol=1e-6)
