"""Very long texts and clashing names where the other modules don't have them."""

import pytest

from paysift.llm.common import table
from paysift.llm.decontaminate import proximity_matches
from paysift.llm.simhash import links
from tests.conftest import SF
from tests.llm.conftest import PROSE

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_keeps_a_very_long_text(spark, docs):
    long = " ".join(f"word{i % 9973} of{i}" for i in range(200_000))
    frame = docs((1, long), (2, PROSE), (3, PROSE), (None, PROSE), (4, None), (5, ""))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
    kept = {r.doc_id: r.text for r in frame.collect()}
    assert kept[1] == long and 3 not in kept and {2, 4} <= kept.keys()
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    assert next(r for r in last if r.doc_id == 1).size == 400_000 and all(r.taken > 0 and r.text for r in last)


def test_the_last_stage_returns_each_row_once(spark, docs):
    frame = docs((1, "a b"), (1, "a b"), (1, "c d e"), (None, "f"), (None, "f"), (None, None))
    got = sorted((str(r.doc_id), r.text, r.taken) for r in corpus_pipeline.mix_sources(spark, frame, SF).collect())
    assert [g[:2] for g in got] == [("1", "a b"), ("1", "c d e"), ("None", "f")] and sum(g[2] for g in got) == 13


def test_clashing_names(spark, docs):
    items = spark.createDataFrame([(1, PROSE, "x", 3)], "item_id long, text string, term string, _did int")
    assert {r.id for r in proximity_matches(docs((1, PROSE), (2, "none"), (1, PROSE)), items).collect()} == {1}
    prints = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 1, 1), (0x7F7F7F7F7F7F7F70, 1, 1, 1)], "fp long, t int, key int, n int")
    assert [tuple(sorted(r)) for r in links(prints).collect()] == [(0, 1)]


def test_toxicity_of_a_very_long_text(spark, docs):
    from paysift.llm import toxicity

    labels = table(spark, SF, "labels")
    model = toxicity.fit(table(spark, SF, "documents"), labels)
    frame = docs((1, "calm words of no kind " * 200_000), (2, "calm"))
    assert {r.doc_id: r.predicted for r in toxicity.score(frame, model).collect()} == {1: 0, 2: 0}
