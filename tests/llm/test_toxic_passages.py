from paysift.llm import toxicity


def model():
    odds = {toxicity._feature(w): 4.0 for w in (b"vile", b"bad", b"nasty")}
    m = toxicity.ToxicityModel(odds, 0.1, 1.0, 1.0, 0.0, 1.0)
    return m, toxicity._Scores(m.table, m.drift)


def test_repeated_passages_count_in_full():
    m, scores = model()
    clean = [f"w{i}" for i in range(150)]
    _, found = m.evidence(" ".join([*clean, "vile bad nasty"] * 10).encode(), scores)
    assert [(a, b) for a, b, _ in found] == [(150 + 153 * i, 153 + 153 * i) for i in range(10)]
    assert {round(s, 6) for *_, s in found} == {12.0}


def test_an_earlier_word_takes_nothing_from_a_passage():
    m, scores = model()
    clean = " ".join(f"w{i}" for i in range(100))
    first = m.evidence(f"{clean} {clean} vile bad nasty".encode(), scores)[1]
    later = m.evidence(f"vile {clean} {clean} vile bad nasty".encode(), scores)[1]
    assert [s for *_, s in first] == [s for *_, s in later] == [12.0]


def test_evidence_grows_beyond_five_segments():
    odds = {toxicity._feature(b"x%d" % i): 9.0 for i in range(12)}
    m = toxicity.ToxicityModel(odds, 0.1, 1.0, 1.0, 0.0, 1.0)
    scores = toxicity._Scores(m.table, m.drift)
    text = lambda n: " ".join(f"x{i} " + "w " * 100 if i < n else "w " * 101 for i in range(12)).encode()
    got = [m.evidence(text(n), scores)[0] for n in (5, 6, 8)]
    assert got[0] < got[1] < got[2]


def test_scan_is_linear():
    """Hundreds of thousands of segments that all start lower than those before, or higher, or join."""
    import time

    import numpy as np

    for step in (-0.1, -0.04, -0.05):
        began = time.perf_counter()
        found = toxicity.segments(np.tile([1.5] + 30 * [step], 100_000))
        assert time.perf_counter() - began < 10
        assert len(found) == (1 if step > -0.05 else 100_000)


def test_log_odds_follow_their_stems():
    counts = [("4_abcd", 40, 0), ("0_abcdx", 1, 0), ("0_wxyz", 1, 0), ("0_each", 10, 90), ("6_üüüüüü", 0, 50), ("0_üüüüüüx", 0, 2)]
    found = toxicity.log_odds(iter(counts), 0.1, 10.0)
    assert found["0_abcdx"] > found["4_abcd"] > 2 > found["0_wxyz"] > 0 > found["6_üüüüüü"] > found["0_üüüüüüx"]
    assert abs(found["0_each"]) < 1e-9


def test_stems_are_whole_characters():
    assert toxicity._names("ñandúes".encode()) == ["0_ñandúes", "6_ñandúe", "4_ñand"]


def test_equal_texts_have_the_greatest_label(spark):
    from paysift.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(i, "same text") for i in (2, 3, 4, 6)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0), (3, 1), (4, 0), (6, 0)], "doc_id long, toxic int")
    assert [tuple(r) for r in labelled_sample(docs, labels, "toxic", 100, fold=1000, held=-1).collect()] == [(2, "same text", 1)]


def test_score_equals_plain_evaluation(spark):
    """What the query gives is what a plain reading of the model gives: quadratic segments, all of them, one text at a time."""
    import math
    from collections import Counter

    from tests.llm.test_models import slow_segments

    m, scores = model()
    m = toxicity.ToxicityModel(m.table, 0.1, 0.7, 0.6, -1.0, 0.5)
    texts = ["vile bad words here", "calm words only", "bad bad bad " + "calm " * 30 + "nasty", "", None, "vile " + "x " * 60 + "nasty vile"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(frame, m).collect():
        words = toxicity.tokens((texts[r.doc_id] or "").encode())
        times, each = Counter(), []
        for w in words:
            s = 4.0 if w in (b"vile", b"bad", b"nasty") else -0.1
            times[w] += 1
            each.append(s / times[w] if s > 0 else s)
        best = sorted((s for *_, s in slow_segments(each)), reverse=True)
        sums = [sum(0.6 * s - math.log(len(words) + 1) for s in best[:n]) + sum(math.log(i) for i in range(1, n + 1)) for n in range(1, len(best) + 1)]
        evidence = min(50.0, max(-20.0, max(sums))) if sums else -20.0
        assert math.isclose(r.score, 1 / (1 + math.exp(1.0 - 0.5 * evidence)), rel_tol=1e-9)
