import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paysift.llm import token_files
from paysift.llm.queries import queries
from paysift.llm.token_files import Encoding, read_tokens, train_dictionary, write_tokens
from tests.conftest import SF
from tests.llm.conftest import ODD, PROSE

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    return Encoding.from_file(WORDS, end_id=1, by_words=True)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def plain(tokenizer, text, end=1):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def ids(row):
    return np.frombuffer(row.ids, "<u4").tolist()


def test_query_equals_encoding_every_text(spark, tokenizer):
    texts = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for doc_id, text in texts:
        found = plain(tokenizer, text)
        want.append((doc_id, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    got = queries()["op12_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_round_trip_of_odd_rows(docs, encoding, tokenizer):
    rows = ODD + [(10, "it's <|endoftext|> A.b, C., d. \x7f 'LL X\x0by\x0cz"), (11, "\x7f"), (12, "Éa. É, ẹ́. Σ. 漢. end")]
    files = write_tokens(docs(*rows), encoding)
    got = read_tokens(files).collect()
    assert sorted((str(r.doc_id), ids(r)) for r in got) == sorted((str(i), plain(tokenizer, t)) for i, t in rows)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0] + [r.n_tokens for r in in_order[:-1]]).tolist()
    known = [r.doc_id for r in in_order if r.doc_id is not None]
    assert known == sorted(known) and all(r.doc_id is None for r in in_order[len(known) :])
    assert sum(f.tokens for f in files.collect()) == sum(r.n_tokens for r in got)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aA.,'s \t\n\x0b\x7f<|>eé̂ßİ")), max_size=80))
def test_word_by_word_equals_whole_text(encoding, tokenizer, text):
    got = token_files._Encoder(encoding).document(text.encode())
    assert np.frombuffer(got, "<u2").tolist() == plain(tokenizer, text)


def test_a_small_memory_gives_the_same(encoding, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 5)
    encoder = token_files._Encoder(encoding)
    for text in [PROSE, "Quick, quick. QUICK", PROSE]:
        assert np.frombuffer(encoder.document(text.encode()), "<u2").tolist() == plain(tokenizer, text)


def test_short_access_opens_only_what_it_needs(docs, encoding, tokenizer):
    rows = [(i, f"text number {i} " + PROSE[: i % 90]) for i in range(300)] + [(None, "no id"), (7, "again")]
    files = write_tokens(docs(*rows), encoding).cache()
    got = read_tokens(files, [7, 250, None, 999]).collect()
    assert sorted((str(r.doc_id), ids(r)) for r in got) == sorted((str(i), plain(tokenizer, t)) for i, t in rows if i in (7, 250, None))
    every = {(r.doc_id, r.start) for r in read_tokens(files).collect()}
    assert {(r.doc_id, r.start) for r in got} <= every


def test_the_dictionary_is_shared_and_checked(docs, encoding, tmp_path):
    rows = [(i, PROSE + f" {i}") for i in range(200)]
    files = write_tokens(docs(*rows), encoding, path=f"file://{tmp_path}")
    (found,) = [p for p in tmp_path.iterdir() if p.name.startswith("dictionary-")]
    assert hashlib.sha256(found.read_bytes()).hexdigest() == found.name.removeprefix("dictionary-")
    (part, *_) = sorted(p for p in tmp_path.iterdir() if p.suffix == ".tok")
    raw = part.read_bytes()
    assert raw[:8] == token_files.MAGIC == raw[-8:] and raw[8:40].hex() == found.name.removeprefix("dictionary-")
    frame = raw[struct.calcsize(token_files._HEAD) :]
    ids_of_first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found.read_bytes())).decompressobj().decompress(frame)
    assert len(frame) and len(ids_of_first) > 50
    found.write_bytes(found.read_bytes() + b"x")
    with pytest.raises(Exception, match="not the one"):
        read_tokens(files).collect()


def test_one_dictionary_shrinks_short_documents(spark, docs, encoding):
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    raw = train_dictionary(texts, encoding)
    assert raw == train_dictionary(texts, encoding) and len(raw) <= token_files.DICTIONARY_BYTES
    samples = [token_files._Encoder(encoding).document(r.text.encode()) for r in texts.where("text IS NOT NULL").collect()]
    size = lambda **kw: sum(len(zstandard.ZstdCompressor(**kw).compress(s)) for s in samples)
    assert size(dict_data=zstandard.ZstdCompressionDict(raw)) < 0.8 * size()


def test_whole_texts_of_a_byte_tokenizer(docs):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = [(1, "two  spaces\n\nand <|endoftext|>"), (2, None), (3, "ñandú 漢字")]
    for special, as_text in ((False, False), (True, True)):
        tokenizer.encode_special_tokens = as_text
        encoding = Encoding.from_file(BYTES, end_id=50256, special_tokens_are_text=special)
        got = read_tokens(write_tokens(docs(*rows), encoding)).collect()
        assert sorted((r.doc_id, ids(r)) for r in got) == [(i, plain(tokenizer, t, 50256)) for i, t in rows]


def test_no_rows(docs, encoding):
    files = write_tokens(docs().limit(0), encoding)
    assert files.collect() == [] and read_tokens(files).collect() == []


def test_one_id_in_many_files(docs, encoding, spark, tokenizer):
    rows = [(5, "same words")] * 40 + [(5, f"words {i % 7}") for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_tokens(docs(*rows).repartition(6), encoding)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1
    got = read_tokens(files).collect()
    assert sorted(ids(r) for r in got) == sorted(plain(tokenizer, t) for _, t in rows)
    assert len({r.start for r in got}) == len(rows)
