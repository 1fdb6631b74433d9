import random
import re

import pytest

from paysift.llm.decontaminate import matches, proximity_matches
from tests.llm.conftest import ODD, PROSE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            if item is None or not x:
                continue
            n = min(window, len(x))
            grams = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    found.add(str(item))
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def same(spark, frame, rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((str(r.id), r.n_words, r.n_hit, list(r["items"])) for r in matches(frame, table).collect()), key=str)
    assert got == brute(rows, items)
    return sum(g[2] for g in got)


def test_equals_brute_force(spark, docs):
    for seed in range(3):
        rng = random.Random(seed)
        vocabulary = [f"w{i}" for i in range(30)]
        items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
        rows = []
        for i in range(40):
            part = words(rng.choice(items)[1])
            a = rng.randrange(len(part))
            text = [rng.choice(vocabulary) for _ in range(rng.randrange(30))] + part[a : a + 18] + [rng.choice(vocabulary) for _ in range(rng.randrange(5))]
            rows.append((i, ", ".join(text).upper() if i % 3 else " ".join(text)))
        assert same(spark, docs(*rows), rows, items) > 0


def test_odd_rows_and_items(spark, docs):
    items = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "!!"), (5, "Two; WORDS"), (6, "word " * 12), (10, "ñandú çÉ")]
    assert same(spark, docs(*ODD), ODD, items) > 0


def test_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in matches(docs(*ODD), none).collect()} == {0}
    assert matches(docs((1, "a")).where("false"), spark.createDataFrame([(1, PROSE)], "item_id long, text string")).count() == 0


def test_proximity(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    filler = " ".join(["alpha beta gamma delta zeta eta iota kappa"] * 3)
    rows = [(1, "alpha beta gamma delta epsilon zeta so eta theta iota kappa " + filler), (2, "epsilon " + filler + " theta"), (3, filler)]
    found = {r.id for r in proximity_matches(docs(*rows), items, slop=2).collect()}
    assert found == {1}
    assert matches(docs(*rows), items).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("text", ["ABC-def_1", "É É", "a\x00b"])
def test_words(text):
    from paysift.llm.words import text_hashes

    assert len(text_hashes(text.encode(), folded=True)) == len(words(text))


def test_one_text_repeats_a_passage(spark):
    """A passage stands 100,000 times in one text; nothing is gathered by text."""
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.range(1).selectExpr("1L AS doc_id", f"repeat('{passage} x ', 100000) AS text")
    items = spark.createDataFrame([(1, passage), (2, "zero " + passage)], "item_id long, text string")
    (found,) = matches(docs, items).collect()
    assert (found.n_words, found.n_hit, found["items"]) == (1_200_000, 1_100_000, ["1", "2"])


def test_phrases(spark, docs):
    from paysift.llm.decontaminate import build_index, phrases

    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x y")], "item_id long, text string")
    index = build_index(docs((1, "0 A b c d e f g h i j k a b"), (2, "x y x y"), (3, "a b c")))
    assert sorted(tuple(r) for r in phrases(index, items).collect()) == [(1, "1", 1, 11), (1, "1", 2, 12), (2, "2", 0, 2), (2, "2", 2, 4)]


def test_proximity_finds_edited_copies(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item), (2, item.replace("alpha", "unseen"))], "item_id long, text string")
    rows = [(1, item.replace("epsilon", "other")), (2, item.replace("theta", "more words")), (3, "kappa iota theta eta"), (4, "alpha " + "pad " * 30 + item[6:30]), (None, None), (5, "")]
    found = {(r.id, r.item) for r in proximity_matches(docs(*rows), items, slop=2).collect()}
    assert found == {(1, "1"), (1, "2"), (2, "1"), (2, "2")}
    assert proximity_matches(docs(*rows), items.where("false")).count() == 0


@pytest.mark.parametrize("shards", [1, 60])
def test_shards_make_no_difference(spark, docs, monkeypatch, shards):
    monkeypatch.setattr("paysift.llm.decontaminate.SHARD_WORDS", shards)
    rows = [(i, " ".join(f"w{(i * 7 + j) % 23}" for j in range(40))) for i in range(12)]
    assert same(spark, docs(*rows), rows, [(1, rows[3][1]), (2, "w1 w2"), (3, rows[5][1][:60])]) > 0
