"""Boosted trees against plain loops, their early stop, and their reasons against all subsets."""

import itertools
import math
import random

import numpy as np
import pytest

from paysift.operators import boosting as BO
from paysift.operators import evaluate as E

NAMES = ["a", "b", "c", "d"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b double, c double, d double, is_fraud int")


def planted(seed, n=500, noise=0.1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.choice([None, *range(6)]), rng.gauss(0, 1), rng.random(), rng.choice([0, 1])]
        fraud = (x[1] > 0.4 and x[3] == 1) or (x[0] is None and x[2] > 0.5)
        rows.append((*[None if v is None else float(v) for v in x], int(fraud != (rng.random() < noise))))
    return rows


def plain_tree(bins, y, w, margin, s):
    """A tree as nested lists, all splits of all nodes tried one by one."""
    p = [1 / (1 + math.exp(-m)) for m in margin]
    g = [round(wi * (pi - yi) * 2**20) / 2**20 for wi, pi, yi in zip(w, p, y)]
    h = [round(wi * pi * (1 - pi) * 2**20) / 2**20 for wi, pi in zip(w, p)]
    score = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + s.smoothing)

    def node(rows, depth):
        value = -s.rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + s.smoothing)
        best = (1e-9, None)
        if depth < s.depth:
            for f in range(len(bins[0])):
                for b in range(s.bins):
                    left, right = [i for i in rows if bins[i][f] <= b], [i for i in rows if bins[i][f] > b]
                    if sum(h[i] for i in left) < s.least or sum(h[i] for i in right) < s.least:
                        continue
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, b, left, right))
        if best[1] is None:
            return value
        f, b, left, right = best[1]
        return f, b, node(left, depth + 1), node(right, depth + 1)

    return node(range(len(y)), 0)


def value_of(tree, row):
    while isinstance(tree, tuple):
        f, b, left, right = tree
        tree = left if row[f] <= b else right
    return tree


def test_trees_equal_plain_loops(spark):
    rows = planted(1)
    s = BO.Settings(rounds=3, depth=2, bins=12, rate=0.3)
    model, _ = BO.fit(frame(spark, rows).repartition(5), frame(spark, rows[:100]), s, names=NAMES)
    bins = BO.binned(np.array([[math.nan if v is None else v for v in r[:4]] for r in rows]), model.edges)
    y = [r[4] for r in rows]
    weight = (len(y) - sum(y)) / sum(y)
    w = [weight if v else 1.0 for v in y]
    assert abs(model.base) < 1e-9
    margin = [0.0] * len(y)
    for _ in model.trees:
        tree = plain_tree(bins.tolist(), y, w, margin, s)
        margin = [m + value_of(tree, b) for m, b in zip(margin, bins.tolist())]
    assert len(model.trees) >= 1 and np.allclose(model.margins(bins), margin, atol=1e-9)


def test_it_stops_once_validation_gets_no_better(spark):
    """Labels are mostly noise: further trees learn the training rows by heart."""
    rows = planted(2, 400, noise=0.4)
    s = BO.Settings(rounds=20, depth=3, bins=16, rate=0.9, least=0.1, patience=2)
    model, figures = BO.fit(frame(spark, rows), frame(spark, planted(3, 300, noise=0.4)), s, names=NAMES)
    best = int(np.argmax(figures)) + 1
    assert len(figures) < 20 and len(figures) == best + 2 and len(model.trees) == best
    again, other = BO.fit(frame(spark, rows).repartition(7), frame(spark, planted(3, 300, noise=0.4)), s, names=NAMES)
    assert other == figures and all((a.value == b.value).all() for a, b in zip(model.trees, again.trees))


def expectation(tree, row, known, node=0):
    """The tree's value if only the known features are: other splits are averaged by their training rows."""
    f = int(tree.feature[node])
    if f < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return expectation(tree, row, known, left if row[f] <= tree.bin[node] else right)
    return (tree.n[left] * expectation(tree, row, known, left) + tree.n[right] * expectation(tree, row, known, right)) / tree.n[node]


def test_reasons_equal_all_subsets(spark):
    rows = planted(4)
    model, _ = BO.fit(frame(spark, rows), frame(spark, rows), BO.Settings(rounds=4, depth=4, bins=16, rate=0.5, least=0.2), names=NAMES)
    bins = BO.binned(np.array([[math.nan if v is None else v for v in r[:4]] for r in rows[:40]]), model.edges)
    got = model.attributions(bins)
    assert np.allclose(got.sum(axis=1) + model.expected(), model.margins(bins), atol=1e-9)
    for row, parts in zip(bins.tolist(), got):
        for f in range(4):
            others, want = [k for k in range(4) if k != f], 0.0
            for size in range(4):
                for known in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += weight * sum(expectation(t, row, {*known, f}) - expectation(t, row, set(known)) for t in model.trees)
            assert abs(parts[f] - want) < 1e-9


def test_scores_and_reasons_of_a_table(spark):
    rows = planted(5)
    data = frame(spark, rows)
    model, figures = BO.fit(data, data, BO.Settings(rounds=12, depth=3, bins=16, rate=0.4), names=NAMES)
    scored = model.contributions(model.score(data))
    bins = BO.binned(np.array([[math.nan if v is None else v for v in r[:4]] for r in rows]), model.edges)
    for r in scored.collect():
        assert abs(sum(r.contributions.values()) + model.expected() - math.log(r.model_score / (1 - r.model_score))) < 1e-6
    assert sorted(r.model_score for r in scored.collect()) == pytest.approx(sorted(1 / (1 + np.exp(-model.margins(bins)))), abs=1e-12)
    assert figures[-1] > 0.8 and {r.feature for r in E.mean_contributions(scored, 2).collect()} <= {"b", "d", "a", "c"}
    assert model.score(data.limit(0)).collect() == []


def test_it_refuses_one_class(spark):
    with pytest.raises(ValueError, match="both classes"):
        BO.fit(frame(spark, [(1.0, 1.0, 1.0, 1.0, 0)] * 5), frame(spark, planted(1, 20)), names=NAMES)
    with pytest.raises(ValueError, match="bins"):
        BO.fit(frame(spark, planted(1, 20)), frame(spark, planted(1, 20)), BO.Settings(bins=2), names=NAMES)


def test_a_pass_follows_few_trees_over_the_inputs_that_vary(spark, monkeypatch):
    """Trees that the stored margins have are not followed again, inputs with one value are not counted, and the model is the same."""
    rows = [(*r[:3], 1.0, r[4]) for r in planted(6)]
    data, s, grow, found = frame(spark, rows), BO.Settings(rounds=5, depth=2, bins=8, patience=9), BO.grow, []
    for carry in (2, 100):
        passes = []
        monkeypatch.setattr(BO, "CARRY", carry)
        monkeypatch.setattr(BO, "grow", lambda rows, model, s: passes.append((len(model.trees), model.names)) or grow(rows, model, s))
        found.append(BO.fit(data, data, s, names=NAMES))
        assert [t for t, _ in passes] == ([0, 1, 0, 1, 0] if carry == 2 else [0, 1, 2, 3, 4]) and all(n == ["a", "b", "c"] for _, n in passes)
    (one, figures), (two, others) = found
    assert figures == others and len(one.trees) == len(two.trees) > 0 and one.names == NAMES
    assert all((a.value == b.value).all() and (a.feature == b.feature).all() for a, b in zip(one.trees, two.trees))


def test_fits_go_over_stored_rows(spark, monkeypatch):
    """No pass of a fit computes the windows over all payments again."""
    from paysift.operators import model as MO
    from paysift.plans import queries as B
    from tests.conftest import SF

    class Seen(Exception):
        pass

    def look(matrix, *_, **__):
        raise Seen("Window" in matrix._jdf.queryExecution().toString())

    monkeypatch.setattr(MO, "fit", look)
    monkeypatch.setattr(BO, "fit", look)
    for query in (B.explained_decisions, B.trained_model, B.boosted_model, B.boosted_reasons):
        with pytest.raises(Seen) as told:
            query(spark, SF)
        assert told.value.args == (False,)
