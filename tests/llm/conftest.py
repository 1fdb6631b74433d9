import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, component_id string, _key string, did long, h int, c_0 string, label int, id string, c int, q int"
PROSE = "the quick brown fox jumps over a lazy dog while seven old wizards quietly mix strange potions near the river bank at dawn every single day"


@pytest.fixture
def docs(spark):
    """Makes documents with other columns of names that operators use inside."""

    def make(*rows, lang="en", source="s"):
        full = [(i, t, lang, source, None if t is None else len(t), "x", "x", "x", "x", 1, 1, "x", 1, "x", 1, 1) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "two words"), (None, None), (5, PROSE), (6, PROSE), (5, "other text of one id"), (7, "ñandú çÉ 漢字 \U0001f600 " * 40), (8, "word " * 50_000), (9, "x" * 300_000)]
