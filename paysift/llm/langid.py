"""Language identification by hyperdimensional letter-trigram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.common import crc_mod, pieces, raw_texts

UNKNOWN = "und"
#: Bits of a code point in a trigram's code; 0 is the edge of a word.
_BITS = 21
#: The ids of each language are dealt into so many parts, which are ranked one by one.
DEALS = 256


@cache
def _kind() -> np.ndarray:
    """For every code point: 2 for letters, 1 for the marks that go with them, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(cp))[0], 0) for cp in range(0x110000)], np.int8)


@lru_cache(maxsize=4096)
def _letter(point: int, dims: int, seed: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, every code point its own: drawn from seed and code point alone."""
    return np.random.default_rng((seed, point)).choice(np.array([-1, 1], np.int8), dims)


def _trigrams(text: str) -> tuple[np.ndarray, bool]:
    """Codes of the trigrams of letters and marks, and whether there is a letter among them."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = _kind()[points]
    points = np.concatenate(([0], np.where(kind > 0, points, 0), [0]))
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    codes = points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:]
    return codes[points[1:-1] != 0], bool((kind == 2).any())


def trigram_counts(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of letter trigrams, word edges counting as a letter, and their counts; empty without letters."""
    codes, counts, spoken = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for piece in pieces(raw or b""):
        found, letters = _trigrams(piece.decode("utf-8", "replace"))
        found, n = np.unique(found, return_counts=True)
        spoken |= letters
        if len(codes):
            found, where = np.unique(np.concatenate([codes, found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        codes, counts = found, n
    return (codes, counts) if spoken else (codes[:0], counts[:0])


def bundles(texts: list[tuple[np.ndarray, np.ndarray]], dims: int, seed: int) -> np.ndarray:
    """A vector for each (codes, counts): the sum of its trigrams' vectors, each bound from three permuted letters."""
    codes, where = np.unique(np.concatenate([c for c, _ in texts]), return_inverse=True)
    weights = np.zeros((len(texts), len(codes)), np.float32)
    at = 0
    for i, (own, n) in enumerate(texts):
        weights[i, where[at : at + len(own)]] = n
        at += len(own)
    parts = np.stack([codes >> 2 * _BITS, codes >> _BITS & (1 << _BITS) - 1, codes & (1 << _BITS) - 1])
    points, where = np.unique(parts, return_inverse=True)
    where = where.reshape(parts.shape)
    last = np.array([_letter(int(p), dims, seed) for p in points], np.int8).reshape(len(points), dims)
    middle, first = np.roll(last, 1, axis=1), np.roll(last, 2, axis=1)  # permuted once and twice, by their place
    out = np.zeros((len(texts), dims), np.float32)
    for lo in range(0, len(codes), 4096):
        at = slice(lo, lo + 4096)
        bound = first[where[0, at]] * middle[where[1, at]] * last[where[2, at]]
        out += weights[:, at] @ bound.astype(np.float32)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # unit vectors, a row a language
    dims: int
    seed: int


def fit(docs: DataFrame, bound: int = 20_000, dims: int = 2048, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Bundles the documents of each language, at most `bound` in all, outside the held-out fold.

    Languages take turns, each by hashes of its ids, so a rare one keeps its few documents. Each task sums a
    vector for each language; Spark adds them up.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = rows.where(crc_mod("id", 3) != 1).where("lang IS NOT NULL AND text IS NOT NULL")
    deal = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(DEALS))  # so that no task has all of a common language
    place = F.row_number().over(Window.partitionBy("lang", "deal").orderBy(F.xxhash64("id"), "id"))
    dealt = known.select("id", "lang").withColumn("deal", deal).withColumn("place", (place - 1) * DEALS + F.col("deal")).where(F.col("place") < bound + DEALS)
    turns = dealt.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("place")))  # at most bound + DEALS rows of a language
    drawn = turns.orderBy("turn", F.xxhash64("id"), "id").limit(bound).select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = bundles([trigram_counts(raw) for raw in raw_texts(part.column(1))], dims, seed)
                for lang, vector in zip(part.column(0).to_pylist(), found):
                    size = float(np.linalg.norm(vector))
                    sums[lang] = sums.get(lang, 0) + (vector / size if size else vector).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "v"])

    parts = known.join(F.broadcast(drawn), "id").select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    table = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x").orderBy("lang").collect()
    vectors = [np.array(r.x) for r in table]
    kept = [(r.lang, np.round(v / np.linalg.norm(v), 12)) for r, v in zip(table, vectors) if np.linalg.norm(v)]
    return LanguageModel(tuple(lang for lang, _ in kept), np.array([v for _, v in kept]).reshape(len(kept), dims), dims, seed)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, held_out, lang_pred, score (the cosine with that language's prototype, at least 0).

    Null texts and texts without a letter (category L; marks alone are none) are `und` with score 0; so is everything if nothing was learned. Ties go to the
    language that sorts first. Repeated rows have equal results; a null id is not held out. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.coalesce(crc_mod(id_col, 3) == 1, F.lit(False)).alias("held_out"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score = [], []
            for at in range(0, batch.num_rows, 64):
                found = bundles([trigram_counts(raw) for raw in raw_texts(batch.column(0).slice(at, 64))], m.dims, m.seed).astype(np.float64)
                size = np.linalg.norm(found, axis=1)
                cosine = found @ m.prototypes.T / np.maximum(size, 1e-9)[:, None] if m.languages else np.zeros((len(found), 1))
                best = cosine.argmax(axis=1)
                for i, j in enumerate(best.tolist()):
                    named = m.languages and size[i] > 0
                    lang.append(m.languages[j] if named else UNKNOWN)
                    score.append(float(min(1.0, max(0.0, cosine[i, j]))) if named else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)
