"""Hyperdimensional profiles against plain loops, and in other scripts."""

import math
import random

import numpy as np
import pytest

from paysift.llm import langid


def plain_bundle(text, dims, seed):
    """Sum over the trigrams of each word, edges as letter 0, of rotated letter vectors multiplied."""
    out = [0] * dims
    vector = lambda c: langid._letter(ord(c) if c else 0, dims, seed).tolist()
    letter = lambda c: __import__("unicodedata").category(c)[0] in "LM"
    word = []
    for c in [*text.lower(), " "]:
        if letter(c):
            word.append(c)
            continue
        padded = ["", *word, ""]
        for a, b, c3 in zip(padded, padded[1:], padded[2:]):
            x, y, z = vector(a), vector(b), vector(c3)
            for i in range(dims):
                out[i] += x[(i - 2) % dims] * y[(i - 1) % dims] * z[i]
        word = []
    return out


@pytest.mark.parametrize("text", ["a", "ab", "the cat sat", "Über-Größe 12 ño", "да нет", "一二 三", "नमस्ते दुनिया", "x" * 50, "\U00010400\U00010428 a"])
def test_binding_and_bundling(text):
    got = langid.bundles([langid.trigram_counts(text.encode()), langid.trigram_counts(b"other words")], 64, 3)[0]
    assert got.tolist() == plain_bundle(text, 64, 3)


def test_cosine(spark):
    """Predictions and scores of the query's way against prototypes and cosines by plain loops."""
    texts = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the house and the tree", "en"), (4, "der baum und das haus", "de"), (5, "the end", "en"), (6, "und", "de"), (7, "und der", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.fit(docs, dims=128)
    fold = lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    prototypes = {}
    for i, text, lang in texts:
        if lang and not fold(i):
            part = unit(plain_bundle(text, 128, model.seed))
            prototypes[lang] = [a + b for a, b in zip(prototypes.get(lang, [0.0] * 128), part)]
    for r in langid.predict(docs, model).collect():
        own = unit(plain_bundle(texts[r.doc_id - 1][1], 128, model.seed))
        cosines = {lang: sum(a * b for a, b in zip(own, unit(p))) for lang, p in prototypes.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r.lang_pred == best and math.isclose(r.score, max(0.0, cosines[best]), abs_tol=1e-5)


def test_scripts(spark):
    """Languages of one script each and two of one script; every letter has a vector of its own."""
    pools = {"ru": "при вет как дела что это ни".split(), "bg": "здра вей щъ ът тази жъ".split(), "el": "καλη μερα το και ει ναι".split(), "hi": "नम स्ते है और की में".split(), "zh": "你 好 的 是 不 我 在".split(), "ja": "です ます の は が に を".split()}
    rng = random.Random(2)
    rows = []
    for i, lang in enumerate(rng.choice(list(pools)) for _ in range(240)):
        rows.append((i, " ".join("".join(rng.choice(pools[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(10, 60))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect() if r.held_out}
    assert len(got) > 50 and all(got[i].lang_pred == rows[i][2] for i in got)
    a, b = (langid._letter(ord(c), 2048, 7).astype(int) for c in "жш")
    assert abs(np.dot(a, b)) < 250


def test_a_letter_is_needed(docs):
    from paysift.llm.langid import fit, predict

    model = fit(docs(*[(i, "the words of a text in english") for i in range(1, 9)]))
    texts = ["́́́ ⃝", "123 ⃝ !", "ःा", "", None, "1 a", "漢"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs(*enumerate(texts)), model).collect()}
    assert [got[i] for i in range(5)] == [("und", 0.0)] * 5 and got[5][0] == "en" and got[6][0] == "en"


def test_a_rare_language_keeps_its_prototype(docs, spark):
    from pyspark.sql import functions as F

    from paysift.llm.langid import fit

    common = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words of number "), "id").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(200_000, 200_010).select(F.col("id").alias("doc_id"), F.lit("ñandú çÉ").alias("text"), F.lit("xx").alias("lang"))
    assert fit(common.union(rare), bound=50).languages == ("en", "xx")
