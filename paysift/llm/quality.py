"""Quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import crc_mod, raw_texts
from paysift.llm.labelled import labelled_sample
from paysift.llm.words import rolling, word_hashes, spaced_words

_KIND = np.zeros(256, np.int64)  # of bytes: 0 other, 1 space, 2 lower case, 3 upper case, 4 digit, 5 stop or comma, 6 other ASCII mark
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6
_KIND[[44, 46]] = 5
NAMES = ("words", "word_length", "upper", "digits", "marks", "stops", "distinct", "top_word", "same_as_last", "distinct_triples", "marked_words", "line_length", "distinct_lines", "word_spread")


def statistics(raw: bytes | None) -> np.ndarray:
    """Transformed statistics of a whole text: logarithms of sizes, roots of shares. Zeros for a text without words."""
    words = spaced_words(raw)
    if not words:
        return np.zeros(len(NAMES))
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7)
    letters, solid = max(1, kinds[2] + kinds[3]), max(1, len(raw) - kinds[1])
    hashes = word_hashes(words)
    ordered = np.sort(hashes)
    turns = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    triples = rolling(hashes, 3)
    lengths = np.fromiter(map(len, words), np.float64, n)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    lines = [line for line in raw.split(b"\n") if line]
    root = np.sqrt
    return np.array([
        np.log1p(n), np.log(lengths.mean()), root(kinds[3] / letters), root(kinds[4] / solid), root(kinds[6] / solid), root(kinds[5] / solid),
        root((len(turns) - 1) / n), root(np.diff(turns).max() / n), root((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0,
        root(len(np.unique(triples)) / len(triples)) if len(triples) else 1.0, root((_KIND[last] == 6).mean()),
        np.log1p(len(raw) / len(lines)), root(len(set(lines)) / len(lines)), np.log1p(lengths.std()),
    ])


@dataclass(frozen=True)
class QualityModel:
    """Per class: log prior minus half the log determinant, the mean, and the inverse Cholesky factor."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[float, np.ndarray, np.ndarray], ...]
    constant: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        low, high = (offset - 0.5 * (((z - mean) @ factor.T) ** 2).sum(axis=1) for offset, mean, factor in self.classes)
        return 1 / (1 + np.exp(-np.clip(high - low, -500, 500)))


def _shrunk(z: np.ndarray, pooled: np.ndarray, weight: float) -> np.ndarray:
    """The class covariance, drawn to the pooled one by `weight` rows, then to its own mean variance by the
    Ledoit-Wolf intensity."""
    n, p = z.shape
    middle = z - z.mean(axis=0)
    sample = middle.T @ middle / n
    mean = np.trace(sample) / p * np.eye(p)
    far = ((sample - mean) ** 2).sum()
    spread = (((middle**2).T @ (middle**2)) / n - sample**2).sum() / n
    intensity = min(1.0, spread / far) if far > 0 else 1.0
    own = (1 - intensity) * sample + intensity * mean
    return (n * own + weight * pooled) / (n + weight) + 1e-4 * np.eye(p)


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, pooled_rows: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits on the statistics of at most `bound` labelled documents outside the held-out fold, which come to the
    driver as a table of that many short rows. With one class only, every score is that class's label; without
    labels, 0.
    """
    rows = statistics_table(labelled_sample(docs, labels, "quality", bound, id_col=id_col, text_col=text_col)).orderBy("id").toArrow()
    y = rows.column("label").to_numpy() > 0
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), len(NAMES))
    if not 1 < y.sum() < len(y) - 1:
        return QualityModel(np.zeros(len(NAMES)), np.ones(len(NAMES)), (), float(y.mean() > 0.5) if len(y) else 0.0)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - centre) / scale
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (False, True)) / len(z)
    classes = []
    for c in (False, True):
        factor = np.linalg.cholesky(_shrunk(z[y == c], pooled, pooled_rows))
        classes.append((float(np.log((y == c).mean()) - np.log(np.diag(factor)).sum()), z[y == c].mean(axis=0), np.linalg.inv(factor)))
    return QualityModel(centre, scale, tuple(classes), 0.0)


def statistics_table(rows: DataFrame) -> DataFrame:
    """rows' other columns and x; rows has column text."""
    others = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in others], "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(raw) for raw in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*others, "x"])

    return rows.select("text", *others).mapInArrow(run, schema)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, held_out, score (that the label is 1), predicted.

    Null and empty texts have the statistics of a text without words; repeated rows have equal results; a null id is
    not held out. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False)).alias("held_out"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(raw) for raw in raw_texts(batch.column(0))]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.probability(x))], names=["id", "held_out", "score"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
