import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from paysift.llm.queries import queries
from paysift.llm.runs import collapse_runs, periodic_runs, planted_period
from tests.conftest import SF
from tests.llm.conftest import ODD


def brute(words, shortest=6, repeats=4):
    """Every stretch of every period that can't be extended; the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {p for start, length, q in runs for p in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def sequences(seed, n=400):
    rng = random.Random(seed)
    for _ in range(n):
        letters, size, out = rng.choice([1, 2, 3, 6]), rng.randrange(0, 90), []
        while len(out) < size:
            out += [rng.randrange(letters) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 8)
        yield out[:size]


@pytest.mark.parametrize("shortest, repeats", [(6, 4), (4, 2), (2, 2), (5, 3), (12, 3), (2, 5)])
def test_runs_equal_brute_force(shortest, repeats):
    total = 0
    for numbers in sequences(shortest * 10 + repeats):
        want = brute(numbers, shortest, repeats)
        assert periodic_runs(np.array(numbers, np.int64), shortest, repeats) == want
        total += len(want)
    assert total > 100


def test_query_equals_brute_force(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, runs_found, planted = {}, 0, 0
    for doc_id, text in texts:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        runs_found += len(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[doc_id] = (doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(kept(words, runs)))
    got = queries()["op13_periodic_runs"](spark, SF).collect()
    assert runs_found > 10 and planted > 5
    assert {r.doc_id: tuple(r) for r in got} == want and len(got) == len(texts)


def test_planting_follows_the_contract():
    for doc_id in range(300):
        words = [b"%d" % i for i in range(doc_id % 37)]
        h = zlib.crc32(str(doc_id).encode())
        out = planted_period(words, doc_id)
        if h % 10 or not words:
            assert out == words
            continue
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert out == [words[i if i < a else a + (i - a) % p] for i in range(n)]
    assert planted_period([b"a"], None) == [b"a"]


def test_odd_rows(docs):
    rows = ODD + [(20, "a b a b a b a b"), (20, "a b a b a b a b"), (21, "z z z z z z"), (22, "z z z z z"), (23, "x " + "p q r " * 4 + "s " + "t " * 9)]
    got = collapse_runs(docs(*rows), carry=["doc_id", "score", "c_0"]).collect()
    assert len(got) == len(rows)
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        runs = [(0, 50_000, 1)] if i == 8 else brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0]), default=None)
        want.append((str(i), len(words), runs, best, (kept(words, runs) if i != 8 else b"word").decode()))
    named = lambda r: r and (r.start, r.length, r.period)
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, [named(x) for x in r.runs], named(r.strongest), r.collapsed_text)) for r in got)
    assert {(r.score, r.c_0) for r in got} == {("x", "x")}


def test_ties_take_the_first_run(docs):
    (row,) = collapse_runs(docs((1, "a a a a a a x b b b b b b"))).collect()
    assert (row.strongest.start, row.strongest.period, len(row.runs)) == (0, 1, 2)
    assert row.collapsed_text == "a x b"


def test_no_rows(docs, spark):
    assert collapse_runs(docs().limit(0), carry=["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        collapse_runs(docs((1, "a")), repeats=1)


def test_a_long_text_of_long_periods(docs):
    rng = random.Random(3)
    part = ["w%d" % rng.randrange(500) for _ in range(3000)]
    (row,) = collapse_runs(docs((1, " ".join(["start"] + part * 5 + ["end"])))).collect()
    assert (row.strongest.start, row.strongest.length, row.strongest.period) == (1, 15_000, 3000)
    assert row.collapsed_text == " ".join(["start"] + part + ["end"])
