"""The model matrix, a distributed fraud classifier and the reasons behind its scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.operators import evaluate, ranking
from paysift.operators.features import FEATURES
from paysift.schemas import COUNTS, DELTAS
from paysift.storage import write_table

OTHER, MISSING = "other", "missing"
#: Category vocabularies.
DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "anonymous.com", "aol.com", "comcast.net",
    "icloud.com", "outlook.com", "msn.com", "att.net", "live.com", "verizon.net",
    "sbcglobal.net", "ymail.com", "bellsouth.net", "cox.net", "me.com", "optonline.net",
    "charter.net", "mail.com",
]
VOCABULARIES = {
    "product_cd": ["W", "C", "R", "H", "S"],
    "card4": ["visa", "mastercard", "american express", "discover"],
    "card6": ["debit", "credit", "charge card", "debit or credit"],
    "device_type": ["desktop", "mobile"],
    "p_emaildomain": DOMAINS,
    "r_emaildomain": DOMAINS,
}
RAW_NUMBERS = ["card3", "card5", "dist1", "dist2"]
NUMBERS = [*FEATURES, *RAW_NUMBERS, *COUNTS, *DELTAS]
COLUMNS = [*NUMBERS, *VOCABULARIES]


def encode(value: Column, vocabulary: Sequence[str]) -> Column:
    """The vocabulary's spelling, whatever the case; unknown values are `other`, null is `missing`."""
    known = F.create_map(*[F.lit(x) for v in vocabulary for x in (v.lower(), v)])
    return F.when(value.isNull(), MISSING).otherwise(F.coalesce(F.try_element_at(known, F.lower(value.cast("string"))), F.lit(OTHER)))


def category_index(value: Column, vocabulary: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in [*vocabulary, OTHER, MISSING]]), encode(value, vocabulary)) - 1).cast("double")


def number(value: Column) -> Column:
    return value.try_cast("double")


def model_matrix(rows: DataFrame, keep: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """keep and the COLUMNS in their order; absent columns are null, categories are text of fixed vocabularies."""
    have = set(rows.columns)
    out = []
    for c in NUMBERS:
        block = "counts" if c in COUNTS else "deltas" if c in DELTAS else None
        if c in have:
            out.append(number(F.col(c)).alias(c))
        elif block in have:
            out.append(F.try_element_at(F.col(block), F.lit(c)).cast("double").alias(c))
        else:
            out.append(F.lit(None).cast("double").alias(c))
    out += [encode(F.col(c) if c in have else F.lit(None).cast("string"), v).alias(c) for c, v in VOCABULARIES.items()]
    return rows.select(*[k for k in keep if k in have], *out)


def _inputs(matrix: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numbers with -1 for null, and a 0/1 column for every category but the last."""
    pairs = [(c, v) for c, words in VOCABULARIES.items() for v in [*words, OTHER]]
    flags = {f"_flag_{i}": (F.col(c) == v).cast("double") for i, (c, v) in enumerate(pairs)}
    filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(-1.0)) for c in NUMBERS}
    frame = matrix.withColumns(filled | flags)
    frame = VectorAssembler(inputCols=[*NUMBERS, *flags], outputCol="features_vector").transform(frame)
    return frame.drop(*flags), [*NUMBERS, *[f"{c}={v}" for c, v in pairs]]


def _input(name: str) -> Column:
    """An input of the model by its name: a number, -1 for null, or a category's 0/1 flag such as product_cd=W."""
    column, _, value = name.partition("=")
    if value:
        return (F.col(column) == value).cast("double")
    return F.coalesce(F.when(~F.isnan(column), F.col(column)), F.lit(-1.0))


class LinearModel:
    """A logistic model given by its terms, as column expressions: it scores and explains batches and streams alike."""

    def __init__(self, weights: Mapping[str, float], intercept: float = 0.0, means: Mapping[str, float] | None = None, version: str = "current") -> None:
        self.weights, self.intercept, self.means, self.version = dict(weights), intercept, dict(means or {}), version

    def score(self, matrix: DataFrame) -> DataFrame:
        logit = F.lit(float(self.intercept))
        for name, weight in self.weights.items():
            logit = logit + F.lit(float(weight)) * _input(name)
        return matrix.withColumn("model_score", 1 / (1 + F.exp(-logit)))

    def contributions(self, scored: DataFrame) -> DataFrame:
        """scored with a map of each input's part of the logit, against its mean."""
        parts = {n: F.lit(float(w)) * (_input(n) - F.lit(float(self.means.get(n, 0.0)))) for n, w in self.weights.items()}
        return scored.withColumn("contributions", F.map_from_arrays(F.array(*[F.lit(n) for n in parts]), F.array(*parts.values())))


class FraudModel:
    """A weighted logistic regression; its score is a probability and its terms add up to its logit."""

    def __init__(self, model: LogisticRegressionModel, names: list[str], means: list[float]) -> None:
        self.model, self.names, self.means = model, names, means

    def linear(self, version: str = "current") -> LinearModel:
        """The same model by its terms."""
        weights = dict(zip(self.names, map(float, self.model.coefficients.toArray())))
        return LinearModel(weights, float(self.model.intercept), dict(zip(self.names, self.means)), version)

    def score(self, matrix: DataFrame) -> DataFrame:
        frame, _ = _inputs(matrix)
        scored = self.model.transform(frame)
        return scored.withColumn("model_score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def contributions(self, scored: DataFrame) -> DataFrame:
        """scored with a map of each input's part of the logit, against its training mean."""
        parts = [((F.col("_x")[i] - F.lit(m)) * F.lit(float(w))) for i, (m, w) in enumerate(zip(self.means, self.model.coefficients.toArray()))]
        frame = scored.withColumn("_x", vector_to_array("features_vector"))
        return frame.withColumn("contributions", F.map_from_arrays(F.array(*[F.lit(n) for n in self.names]), F.array(*parts))).drop("_x")


def top_reasons(explained: DataFrame, n: int = 3, flagged: Column | None = None) -> DataFrame:
    """explained with the n strongest risk-raising reasons, of flagged rows only if a test is given."""
    entries = F.filter(F.map_entries("contributions"), lambda e: e["value"] > 0)
    ranked = F.slice(F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("feature"), e["value"].alias("x")))), 1, n)
    values = {c: F.col(c).cast("string") for c in explained.columns if c in COLUMNS}
    lookup = F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)]) if values else F.create_map().cast("map<string,string>")
    name = lambda e: F.substring_index(e["feature"], "=", 1)
    reasons = F.transform(ranked, lambda e: F.struct(
        name(e).alias("feature"), F.try_element_at(lookup, name(e)).alias("value"), F.round(e["x"], 4).alias("contribution"), F.when(e["x"] > 0, "increases risk").otherwise("reduces risk").alias("direction")
    ))
    return explained.withColumn("top_reasons", reasons if flagged is None else F.when(flagged, reasons).otherwise(F.slice(reasons, 1, 0)))


def fit(training: DataFrame, label: str = "is_fraud", regularisation: float = 0.01, rounds: int = 50) -> FraudModel:
    """Fits on a matrix with a label column; positives weigh as much as negatives together."""
    weight = evaluate.class_weight(training, label).first()["positive_weight"]
    frame, names = _inputs(training)
    frame = frame.withColumn("_weight", F.when(F.col(label) == 1, F.lit(weight)).otherwise(1.0)).withColumn("_label", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="features_vector", labelCol="_label", weightCol="_weight", regParam=regularisation, maxIter=rounds).fit(frame)
    means = frame.select(vector_to_array("features_vector").alias("x")).agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    return FraudModel(model, names, list(means))


def train_and_test(training: DataFrame, label: str = "is_fraud", time: str = "event_time", key: str = "transaction_id", train: float = 0.7, validation: float = 0.15) -> tuple[FraudModel, DataFrame, DataFrame]:
    """(model, thresholds, test figures): fitted on the oldest rows, thresholds tuned on the next, measured on the newest.

    Test rows take no part in fitting or tuning.
    """
    parts = write_table(ranking.time_split(training, train, validation, time, key), "parts")
    matrix = lambda name: model_matrix(parts.where(F.col("part") == name), keep=(key, time, label))
    model = fit(matrix("train"), label)
    chosen = evaluate.tune_thresholds(model.score(matrix("validation")), score="model_score", label=label)
    row = chosen.first()
    tested = evaluate.evaluate_model(model.score(matrix("test")), row["review_threshold"], row["block_threshold"], score="model_score", label=label)
    return model, chosen, tested
