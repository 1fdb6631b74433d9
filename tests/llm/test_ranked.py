import math
import random
import re
from collections import Counter

import pytest

from paysift.llm import ranked
from paysift.llm.ranked import document_bags, query_terms, search
from tests.llm.conftest import ODD, PROSE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, each in wanted.items():
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in each if t in b)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "item_id string, text string")


def same(docs, items, rows, asked, **kw):
    got = sorted(map(tuple, search(docs(*rows), items(*asked), **kw).collect()), key=str)
    assert got == brute(rows, asked, kw.get("top", 50))
    return got


def corpus(seed, n=250):
    rng = random.Random(seed)
    word = lambda: "w%d" % min(int(rng.paretovariate(0.7)), 300)
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(n)]
    rows += [(1000 + i, rng.choice(rows[:6])[1]) for i in range(n)]
    asked = [(f"q{i}", " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    return rng.sample(rows, len(rows)), asked


def test_equals_brute_force(docs, items):
    for seed in range(2):
        assert len(same(docs, items, *corpus(seed))) > 300


def test_few_places_and_large_classes(docs, items):
    rows, asked = corpus(5)
    rows += [(5000 - i, "W1 w2, W3 unknown") for i in range(300)]
    got = same(docs, items, rows, [*asked, ("all", "w1 w2 w3")], top=7)
    assert max(r[1] for r in got) == 7


def test_blocks_of_items(docs, items, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(ranked, "_CELLS", 64)
    same(docs, items, *corpus(7, 80))


def test_a_filter_that_lets_much_pass(docs, items, monkeypatch):
    monkeypatch.setattr(ranked.document_bags, "__defaults__", (*document_bags.__defaults__[:-1], 6))
    monkeypatch.setattr(ranked, "FILTER_BITS", 6)
    same(docs, items, *corpus(8, 60))


def test_odd_rows(docs, items):
    asked = [("a", PROSE), ("a", "other text"), ("b", None), ("c", " .,; "), ("d", "WORD ñandú 漢字 One two"), (None, "lazy dog"), ("e", "nowhere")]
    rows = ODD + [(30, "Word-word WORD"), (30, "Word-word WORD"), (None, "lazy")]
    got = same(docs, items, rows, asked)
    assert {r[0] for r in got} == {"a", "d", None}


def test_ties_go_to_smaller_ids(docs, items):
    rows = [(i, "same text here") for i in range(90, 0, -1)] + [(500 + i, f"filler {i}") for i in range(200)]
    got = search(docs(*rows), items(("q", "here same"))).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 51)) and len({r.score for r in got}) == 1


def test_integer_item_ids_and_empty_tables(docs, items, spark):
    numbered = spark.createDataFrame([(3, "lazy dog")], "item_id long, text string")
    got = search(docs((1, PROSE), (2, "cat"), (3, "hen")), numbered)
    assert got.schema["item_id"].dataType.simpleString() == "bigint" and got.collect()[0].item_id == 3
    assert search(docs().limit(0), items(("q", "a"))).collect() == []
    assert search(docs((1, "a")), items(("q", "a")).limit(0)).collect() == []
    assert search(docs((1, None), (2, " ")), items(("q", "a"))).collect() == []


def test_bags_hold_item_terms_only(docs, items):
    wanted = query_terms(items(("q", "fox dog")))
    (row,) = document_bags(docs((1, PROSE + " fox")), wanted).collect()
    assert row.n == len(PROSE.split()) + 1 and len(row.bag) == 2 * ranked._POSTING.itemsize
