import random

from paysift.llm.substring import dedup_substrings, repeated_spans
from tests.llm.conftest import ODD


def brute(rows, k=13):
    """kept words, removed count of every row."""
    first, out = {}, []
    words = [(t or "").encode().split() for _, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, rank(i)), rank(i))
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < rank(i):
                gone.update(range(s, s + k))
        out.append((b" ".join(x for p, x in enumerate(w) if p not in gone).decode(), len(gone)))
    return out


def same(frame, rows, **kw):
    got = sorted((str(r.doc_id), r.kept_text, r.n_removed, r.n_words) for r in dedup_substrings(frame, carry=["doc_id"], **kw).collect())
    want = sorted((str(i), kept, gone, len((t or "").encode().split())) for (i, t), (kept, gone) in zip(rows, brute(rows)))
    assert got == want
    return sum(g[2] for g in got)


def passages(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv".split()) + str(rng.randrange(4))
    shared = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [word() for _ in range(rng.randrange(0, 20))]
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            text += part[a : a + rng.randrange(1, 40)]
        rows.append((i, " ".join(text)))
    return rows


def test_equals_brute_force(docs):
    for seed in range(3):
        rows = passages(seed)
        assert same(docs(*rows), rows) > 0


def test_many_copies(docs):
    """No switch for groups of many rows is left: all edges take the same way."""
    rows = passages(9) + [(100 + i, t) for i, (_, t) in enumerate(passages(9)[:5] * 8)]
    same(docs(*rows), rows)


def test_one_text_repeats_a_line(docs):
    """A line stands 20,000 times in one text and once in a smaller and a larger document."""
    line = "the same line of thirteen words stands here again and again and again "
    rows = [(1, "first " + line), (2, line * 20_000), (3, "x " + line * 2), (4, "nothing of the kind")]
    assert same(docs(*rows), rows) > 200_000


def test_equal_hashes_of_different_words(docs):
    """Edges of 6 bits collide all the time; the proof at the source coordinate finds it out and the result stays exact."""
    for seed in (11, 12):
        rows = passages(seed)
        assert same(docs(*rows), rows, edge_bits=6) > 0


def test_full_filter(docs):
    rows = passages(10)
    same(docs(*rows), rows, filter_bits=6)


def test_odd_rows(docs):
    same(docs(*ODD), ODD)


def test_spans_name_their_source(docs):
    text = " ".join(f"w{i}" for i in range(40))
    spans = repeated_spans(docs((1, "x y " + text), (2, text + " z"))).collect()
    assert [(s.did, s.at, s.length, s.source_did, s.source_at) for s in spans] == [(2, 0, 28, 1, 2)]


def test_no_documents(docs):
    assert dedup_substrings(docs((1, "a")).where("false"), carry=["doc_id"]).count() == 0


def test_many_rows_of_one_id(docs, spark):
    """A row without an id, and one of an id that many rows have, repeat a passage; no other row of theirs loses a word."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(20))
    many = spark.range(50_000).select(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(16)]).alias("text"))
    rows = many.select(F.lit(None).cast("long").alias("doc_id"), "text").union(many.select(F.lit(7).cast("long"), F.concat(F.lit("z "), "text")))
    planted = spark.createDataFrame([(1, passage), (None, f"a {passage} b"), (7, f"c {passage} d")], "doc_id long, text string")
    got = dedup_substrings(rows.union(planted), carry=["doc_id"]).where("n_removed > 0").collect()
    # the words of a row of id 7 stand in a row without an id, which comes after it
    assert sorted((str(r.doc_id), r.n_removed) for r in got if r.n_removed == 20) == [("7", 20), ("None", 20)]
    assert sum(r.n_removed == 16 and r.doc_id is None for r in got) == 50_000 and len(got) == 50_002


def test_two_texts_of_one_id_are_two_sources(docs):
    text = lambda a, n: " ".join(f"t{i}" for i in range(a, a + n))
    rows = [(3, text(0, 30)), (3, text(100, 30)), (3, text(200, 5)), (9, text(0, 30) + " " + text(100, 30)), (None, text(110, 15)), (None, "other words")]
    assert same(docs(*rows), rows) == 75
