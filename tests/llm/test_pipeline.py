import hashlib

import pytest

from paysift.llm import toxicity
from paysift.llm.common import table
from tests.conftest import SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import fill
from tests.llm.test_simhash import plain, smallest
from tests.llm.test_substring import brute as cuts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_hand(spark, docs):
    """The rows of run(), by plain loops; the classifier's decisions are its own."""
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, table(spark, SF, "labels"))).where("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in rejected]
    groups = smallest([r.doc_id for r in rows], [plain(r.text) for r in rows])
    rows = [r for r, g in zip(rows, groups) if r.doc_id == g]
    kept = [(r.doc_id, text if gone else r.text, r.source) for r, (text, gone) in zip(rows, cuts([(r.doc_id, r.text) for r in rows]))]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {i for i, _, hit, _ in leaks([(i, t) for i, t, _ in kept], items) if hit}
    kept = [(i, len((t or "").encode().split()), s) for i, t, s in kept if str(i) not in dirty]
    sizes = {}
    for _, n, s in kept:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = fill(sizes), {}
    for source, size in sizes.items():
        budget = int(goal[source] + 1e-9)
        epochs, left = divmod(budget, size) if size else (0, 0)
        for i, n in sorted(((i, n) for i, n, s in kept if s == source), key=lambda x: hashlib.md5(f"mix:{x[0]}".encode()).hexdigest()):
            part = max(0, min(n, left))
            left -= part
            out[i] = epochs * n + part
    return {i: t for i, t in out.items() if t}, len(rejected)


def test_run_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
    want, rejected = by_hand(spark, docs)
    assert got.keys() == want.keys() and rejected
    assert all(abs(got[i] - want[i]) <= 1 for i in want)  # a target just below a whole number may round down


def test_stages_keep_columns(spark, docs):
    frame = docs((1, "a b c"), (1, "a b c"), (None, None), (3, ""), (4, "plain words here"), (4, "another text of this id"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns[:5] == COLUMNS and len(frame.columns) == 16
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() >= 1


def test_columns_of_any_name_stay(spark, docs):
    frame = docs((1, "a b c"), (1, "d e f"), (None, "g h i"), (4, "plain words here"))
    for name in ("_row", "_", "__", "component_id ", "n_hit", "key", "count", "kept_text", "predicted"):
        frame = frame.withColumn(name, frame.score)
    want = frame.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == want and {tuple(r)[-9:] for r in frame.collect()} == {("x",) * 9}
    assert frame.count() == 3


def test_stages_take_nothing(spark, docs):
    frame = docs((1, "a")).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() == 0
