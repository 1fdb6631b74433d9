import re

import pytest

from paysift.llm.mixing import mix, targets
from tests.llm.conftest import ODD


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight, the excess over a source's most shared again."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = share * sum(sizes.values()), dict(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        for s in over:
            open_.pop(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 900, "c": 40, None: 60}, {"a": 0, "b": 10}, {"b": 1}, {"x": 0}, {f"s{i}": (i * 37) % 101 for i in range(25)}, {"é": 4, "z": 4, "A": 4, None: 4}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(rows).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys()
    for s in sizes:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_budgets(spark):
    rows = [(i, "w " * (i % 23), ["a", "b", "b", "b", None, "c"][i % 6]) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(frame).collect()
    assert len(got) == 600
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r["_source"] == source]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 1.000001
        partly = [r for r in mine if r.taken not in (0, r["size"], 2 * r["size"])]
        assert len(partly) <= 1
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = {r.id: r.taken for r in mix(frame.repartition(7)).collect()}
    assert again == {r.id: r.taken for r in got}


def test_odd_rows(docs):
    got = mix(docs(*ODD)).collect()
    sizes = sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in ODD)
    assert sorted((str(r.id), r["size"]) for r in got) == sizes
    assert abs(sum(r.taken for r in got) - got[0].target) < 1.000001


def test_nothing(docs):
    assert mix(docs((1, "a")).where("false")).count() == 0
    assert [r.taken for r in mix(docs((1, None), (2, ""))).collect()] == [0, 0]


def test_no_python(docs):
    plan = mix(docs((1, "a b")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
