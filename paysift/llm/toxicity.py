"""Toxicity by maximum-scoring segments of token log-odds, calibrated by their extreme-value distribution."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import crc_mod, raw_texts, record_batch
from paysift.llm.labelled import labelled_sample
from paysift.llm.words import ALNUM

#: Leading characters that inflected and compound words share, longest first.
STEMS = (8, 6, 4)
_CACHE = 200_000
#: Scores are binned to this width where their distribution is counted.
_BIN = 0.05
_COUNTS = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def tokens(raw: bytes | None) -> list[bytes]:
    """Lower-case runs of letters and digits."""
    return (raw or b"").decode("utf-8", "replace").lower().encode().translate(ALNUM).split()


def _names(token: bytes) -> list[str]:
    """The word itself, then its stems of whole characters, each with its length; a word has length 0."""
    word = token.decode("utf-8", "replace")
    return [f"0_{word}", *[f"{n}_{word[:n]}" for n in STEMS if len(word) > n]]


def _hashed(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) - (1 << 63)


def _feature(token: bytes) -> int:
    return _hashed(_names(token)[0])


class _Scores(dict):
    """Token to score: that of the word, or of the longest stem that the table has, or -drift. Holds at most _CACHE tokens."""

    def __init__(self, table: dict[int, float], drift: float) -> None:
        super().__init__()
        self.table, self.drift = table, drift

    def __missing__(self, token: bytes) -> float:
        score = next((self.table[f] for f in map(_hashed, _names(token)) if f in self.table), -self.drift)
        if len(self) >= _CACHE:
            self.clear()
        self[token] = score
        return score


def token_scores(words: list[bytes], scores: _Scores) -> np.ndarray:
    """Scores in text order."""
    return np.fromiter(map(scores.__getitem__, words), np.float64, len(words))


def repeats_discounted(words: list[bytes], each: np.ndarray) -> np.ndarray:
    """The scores with the n-th time that a text repeats a token of positive score at an n-th."""
    found, times = each.copy(), Counter()
    for i in np.flatnonzero(found > 0).tolist():
        times[words[i]] += 1
        found[i] /= times[words[i]]
    return found


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time.

    A stack holds the segments so far. Each remembers the nearest one before it that starts from a lower sum, so looking
    for where a new segment can reach back jumps over all that can't matter again.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], scores > 0, [0])).astype(np.int8)))
    starts, ends, lows, highs, lower = [], [], [], [], []
    for start, end, low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), total[edge[::2]].tolist(), total[edge[1::2]].tolist()):
        while True:
            j = len(lows) - 1
            while j >= 0 and lows[j] >= low:
                j = lower[j]
            if j < 0 or highs[j] >= high:
                break
            start, low = starts[j], lows[j]
            for column in (starts, ends, lows, highs, lower):
                del column[j:]
        for column, value in zip((starts, ends, lows, highs, lower), (start, end, low, high, j)):
            column.append(value)
    return [(s, e, high - low) for s, e, low, high in zip(starts, ends, lows, highs)]


@dataclass(frozen=True)
class ToxicityModel:
    table: dict[int, float]  # feature hash to log-odds less drift
    drift: float  # what every token loses, so that segments of words without any leaning end
    decay: float  # lambda of the extreme-value distribution of maximal segment scores
    document_decay: float  # the same where repeats of a token count less
    intercept: float
    slope: float

    def evidence(self, raw: bytes | None, scores: _Scores) -> tuple[float, list[tuple[int, int, float]]]:
        """-log of the expected number of sets of segments as good as the best ones in a clean text of this length,
        and the segments of the text that are significant by themselves.

        Of segments found with repeats discounted the r best count with their sum of decay * score - log(length), plus
        log(r!); r is the one that tells most. -20 to 50. The significant segments have the full score of each token.
        """
        words = tokens(raw)
        each = token_scores(words, scores)
        if not (each > 0).any():
            return -20.0, []
        limit = (3 + math.log(len(words))) / self.decay  # about one such segment in twenty clean texts
        passages = [x for x in segments(each) if x[2] >= limit]
        best = np.sort([s for _, _, s in segments(repeats_discounted(words, each))])[::-1]
        sums = np.cumsum(self.document_decay * best - math.log(len(words) + 1) + np.log(np.arange(1, len(best) + 1)))
        return float(np.clip(sums.max(), -20, 50)), passages

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * evidence))))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of either class that hold the word or stem; summed in batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                toxic, clean = Counter(), Counter()
                for raw, y in zip(raw_texts(part.column(0)), part.column(1).to_pylist()):
                    (toxic if y > 0 else clean).update({f for t in set(tokens(raw)) for f in _names(t)})
                names = list(toxic.keys() | clean.keys())
                yield record_batch(_COUNTS, names, [toxic[n] for n in names], [clean[n] for n in names])

    counts = rows.select("text", "label").mapInArrow(run, "feature string, toxic long, clean long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(features: Iterator[tuple[str, int, int]], share: float, prior: float) -> dict[str, float]:
    """Log-odds of the toxic class for features (name, toxic, clean), against its share of all documents.

    The two classes of a feature have a Dirichlet prior of `prior` documents, divided as the posterior of its longest
    stem divides them, and for the shortest stems as all documents are. So a rare word leans as its stem does.
    """
    known: dict[str, float] = {}
    lengths = sorted(STEMS)
    for name, toxic, clean in sorted(features, key=lambda f: (int(f[0].partition("_")[0]) or 1 << 30, f[0])):
        word = name.partition("_")[2]
        size = int(name.partition("_")[0]) or len(word)
        above = (known.get(f"{n}_{word[:n]}") for n in reversed(lengths) if n < size)
        mean = next((p for p in above if p is not None), share)
        known[name] = (toxic + prior * mean) / (toxic + clean + prior)
    base = math.log(share / (1 - share))
    return {name: math.log(p / (1 - p)) - base for name, p in known.items()}


def _decay(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1, p the clean documents' share of score s."""
    p = weights / weights.sum()
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, prior: float = 10.0, least_documents: int = 2, drift: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits on at most `bound` labelled documents outside the held-out fold; three quarters give the log-odds of words and
    stems (log_odds()), the rest the score distribution of clean documents and the calibration. The table has every word and
    stem that at least least_documents of the sample hold, so the sample bounds it. Without both classes every score is 0.
    """
    sample = labelled_sample(docs, labels, "toxic", bound, id_col=id_col, text_col=text_col)
    part = F.pmod(F.xxhash64("text"), F.lit(4))
    learn, check = sample.where(part != 0), sample.where(part == 0)
    totals = learn.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    n_toxic, n_clean = totals[0], totals[1] - totals[0]
    if not n_toxic or not n_clean:
        return ToxicityModel({}, drift, 1.0, 1.0, -50.0, 0.0)
    counts = feature_counts(learn).where(F.col("toxic") + F.col("clean") >= least_documents).toArrow()
    odds = log_odds(zip(*[counts.column(c).to_pylist() for c in ("feature", "toxic", "clean")]), n_toxic / totals[1], prior)
    table = {_hashed(name): round(score - drift, 9) for name, score in odds.items()}
    model = ToxicityModel(table, drift, 1.0, 1.0, 0.0, 1.0)
    full, discounted = _score_spread(check.where("label = 0"), model)
    model = ToxicityModel(table, drift, _decay(*full), _decay(*discounted), 0.0, 1.0)
    found = _evidence(check, model).orderBy("id").select("evidence", "label").toArrow()
    x, y = found.column("evidence").to_numpy(), (found.column("label").to_numpy() > 0).astype(float)
    intercept, slope = _logistic(x, y) if 0 < y.sum() < len(y) else (0.0, 1.0)
    return ToxicityModel(table, drift, model.decay, model.document_decay, intercept, slope)


def _score_spread(rows: DataFrame, model: ToxicityModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """Binned scores and their token counts: of full scores, then with repeats discounted. One token more has the highest
    score of the table, so that a sample without toxic words has a distribution too."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value.table, shared.value.drift)
        for batch in batches:
            found: tuple[list[np.ndarray], list[np.ndarray]] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
            for raw in raw_texts(batch.column(0)):
                words = tokens(raw)
                full = token_scores(words, scores)
                for kind, s in enumerate((full, repeats_discounted(words, full))):
                    found[kind].append(np.round(s / _BIN).astype(np.int64))
            for kind in (0, 1):
                values, n = np.unique(np.concatenate(found[kind]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind)), pa.array(values), pa.array(n)], names=["kind", "value", "n"])

    rows = rows.select("text").mapInArrow(run, "kind long, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).orderBy("kind", "value").toArrow()
    kinds, values, n = (rows.column(c).to_numpy() for c in ("kind", "value", "n"))
    top = max(model.table.values(), default=0.0)
    return [(np.append(values[kinds == kind] * _BIN, top), np.append(n[kinds == kind], 1).astype(float)) for kind in (0, 1)]


def _evidence(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """rows' other columns, evidence, segments; rows has column text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "text"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in others], "evidence double, probability double, segments array<struct<start:bigint,end:bigint,score:double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = _Scores(m.table, m.drift)
        for batch in batches:
            evidence, passages = [], []
            for raw in raw_texts(batch.column(0)):
                e, found = m.evidence(raw, scores)
                evidence.append(e)
                passages.append([{"start": a, "end": b, "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(evidence, pa.float64()), pa.array([m.probability(e) for e in evidence], pa.float64()), pa.array(passages, kind)],
                names=[*others, "evidence", "probability", "segments"],
            )

    return rows.select("text", *others).mapInArrow(run, schema)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: the id, held_out, score, predicted, segments (start, end, score; in tokens), and the
    carried columns as c_0, c_1 and so on.

    Null and empty texts have no segments and the score of no evidence; repeated rows have equal results; a null id
    is not held out. Other columns are ignored; no rows give no rows.
    """
    names = [f"c_{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"),
        *[F.col(c).alias(n) for c, n in zip(carry, names)],
    )
    found = _evidence(rows, model)
    predicted = (F.col("probability") >= 0.5).cast("int").alias("predicted")
    return found.select(F.col("id").alias(id_col), "held_out", F.col("probability").alias("score"), predicted, "segments", *names)
