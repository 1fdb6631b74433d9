"""Past cases: descriptions, vectors, nearest neighbours, upserts, reviews and their feedback."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from paysift.functions.payments import agreed, amount_band, let
from paysift.storage import write_table

DIMENSIONS, NGRAM = 384, 4
#: Cases in a block of a search.
BLOCK, QUERY_BLOCK = 8192, 256
#: Cells of an index at most.
CELLS = 4096
#: Similarities of cases and centroids that a task holds at once.
SCORES = 1 << 20
#: What an upsert of a case replaces; the rest keeps its old value.
CASE_UPDATES = ("decision", "is_fraud", "confirmed_at", "resolution", "description", "facts", "embedding", "embedder")
REVIEW_UPDATES = ("reviewed_at", "analyst", "verdict", "note")


def describe(features: Column, amount: Column, decision: Column, product: Column | None = None, device: Column | None = None) -> Column:
    """A sentence-like description of a payment from its feature map. The phrases."""
    f = lambda name: F.try_element_at(features, F.lit(name))
    yes = lambda name: F.coalesce(f(name), F.lit(0.0)) != 0
    filled = lambda c: F.when(F.length(c) > 0, c)
    day, ratio = F.coalesce(f("card_txn_count_24h"), F.lit(0.0)), f("amount_to_card_avg_ratio")
    busy = F.format_string("%d payments in 24 hours", day.cast("long"))
    return F.concat_ws(
        "; ", F.concat(amount_band(amount), F.lit(" payment, decision "), decision),
        F.concat(F.lit("product "), filled(product)) if product is not None else F.lit(None).cast("string"), F.concat(F.lit("on "), filled(device)) if device is not None else F.lit(None).cast("string"),
        F.when(yes("card_is_new"), "first payment seen on this card").when(day >= 10, F.concat(F.lit("high velocity, "), busy)).when(day > 1, busy),
        F.when(ratio >= 3, F.concat(F.lit("about "), F.bround(ratio).cast("long").cast("string"), F.lit(" times this card's usual amount"))),
        F.when(yes("card_new_device"), "device not seen on this card before"), F.when(yes("card_new_email_domain"), "new recipient email domain"), F.when(yes("is_night"), "made overnight"),
    )


def outcome(is_fraud: Column) -> Column:
    return F.when(is_fraud, "confirmed fraud").otherwise("confirmed legitimate")


def summary_line(occurred_at: Column, amount: Column, decision: Column, is_fraud: Column, resolution: Column) -> Column:
    day = F.coalesce(F.date_format(occurred_at, "yyyy-MM-dd"), F.lit("unknown date"))
    return F.format_string("%s: %.2f %s -> %s (%s)", day, amount, decision, outcome(is_fraud), resolution)


def embed(text: Column, dims: int = DIMENSIONS, n: int = NGRAM) -> Column:
    """A unit vector of hashed character n-grams of the lower-cased text; zeros for an empty one."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(t, i, F.lit(n))), F.lit(dims)).cast("int"))
    # sorted buckets with one more of each: a bucket's count is the distance of its places, less one; both steps are linear
    counted = lambda g: let(F.array_sort(F.concat(g, F.sequence(F.lit(0), F.lit(dims)))), lambda s: let(
        F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull()),
        lambda at: F.transform(F.slice(at, 1, dims), lambda a, i: (F.get(at, i + 1) - a - 1).cast("double")),
    ))
    vector = let(let(let(clean, grams), counted), unit)
    return F.when(F.length(clean) == 0, F.array_repeat(F.lit(0.0), dims)).otherwise(vector)


def unit(vector: Column) -> Column:
    """The vector at length 1; zeros stay zeros."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v, dims): keys and unit vectors of the rows that have both."""
    kept = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return kept.select(F.col(key).alias("k"), unit(F.col(vector)).alias("v"), F.size(vector).alias("dims"))


def _blocks(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """(dims, cell, block number, keys, vectors) of rows (k, v, dims, cell), dealt by a hash of the key into n blocks of each cell."""
    packed = rows.withColumn("b", F.pmod(F.xxhash64("k"), n).cast("int")).groupBy("dims", "cell", "b").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("rows"))
    return packed.select("dims", "cell", F.col("b").alias(name), F.col("rows.k").alias(f"{name}_keys"), F.flatten("rows.v").alias(f"{name}_v"))


def _best(pairs: DataFrame, k: int, key: str) -> DataFrame:
    """(query_id, rank, key, similarity) of pairs of a query block and a case block (q_keys, q_v, c_keys, c_v): one matrix product each,
    of which k cases a query are kept for the merge after it."""
    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("q_keys", "c_keys")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_keys, q_v, c_keys, c_v in zip(*[batch.column(i) for i in range(4)]):
                q_keys, c_keys = q_keys.values, c_keys.values
                q_k, c_k = q_keys.to_numpy(zero_copy_only=False), c_keys.to_numpy(zero_copy_only=False)
                scores = q_v.values.to_numpy().reshape(len(q_k), -1) @ c_v.values.to_numpy().reshape(len(c_k), -1).T
                np.round(scores, 9, out=scores)
                scores += 0.0
                scores[q_k[:, None] == c_k[None, :]] = -np.inf
                at = max(0, len(c_k) - k)
                row, column = np.nonzero(scores >= np.partition(scores, at, axis=1)[:, at, None])
                order = np.lexsort((column, -scores[row, column], row))  # keys are in order within a block
                row, column = row[order], column[order]
                keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(scores[row, column])
                row, column = row[keep], column[keep]
                yield pa.RecordBatch.from_arrays([q_keys.take(pa.array(row)), c_keys.take(pa.array(column)), pa.array(scores[row, column])], names=["query_id", "k", "similarity"])

    found = pairs.select("q_keys", "q_v", "c_keys", "c_v").mapInArrow(run, f"query_id {kinds[0]}, k {kinds[1]}, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("k"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("k").alias(key), "similarity")


def nearest(queries: DataFrame, cases: DataFrame, k: int = 5, key: str = "transaction_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(query_id, rank, key, similarity): the k most similar cases of every query but itself; ties to the smaller key.

    Queries are a stated set. Both sides are packed into blocks of bounded size, whose number grows with the rows; every query
    block meets every case block by its number. Rows without a key or a vector take no part, and vectors meet those of their own
    length.
    """
    n_cases = blocks or max(1, -(-cases.count() // BLOCK))
    n_queries = max(1, -(-queries.count() // QUERY_BLOCK))
    c = _blocks(_vectors(cases, key, vector).withColumn("cell", F.lit(0)), F.lit(n_cases), "c")
    q = _blocks(_vectors(queries, key, vector).withColumn("cell", F.lit(0)), F.lit(n_queries), "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_cases - 1))))
    return _best(q.join(c, ["dims", "cell", "c"]), k, key)


class CaseIndex:
    """Stored cases in cells around centroids. Only the centroids are held here; there are at most CELLS of them."""

    def __init__(self, centroids: np.ndarray, rows: DataFrame, counts: DataFrame) -> None:
        self.centroids, self.rows, self.counts = centroids, rows, counts


def _cells(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """rows (k, v, dims) with each of its n nearest cells. A task compares so many rows at once that it holds SCORES similarities,
    however many cells there are."""
    shared, at, step = rows.sparkSession.sparkContext.broadcast(centroids), rows.columns.index("v"), max(1, SCORES // len(centroids))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                scores = np.round(part.column(at).flatten().to_numpy().reshape(part.num_rows, -1) @ shared.value.T, 9)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32), best.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, "near"])

    found = rows.mapInArrow(near, StructType([*rows.schema, StructField("near", ArrayType(IntegerType()))]))
    return found.select(*rows.columns, F.posexplode("near").alias("place", "cell"))


def index_cases(cases: DataFrame, cells: int | None = None, sample: int = 20_000, turns: int = 10, key: str = "transaction_id", vector: str = "embedding") -> CaseIndex:
    """Deals every case with a key and a vector to its nearest cell and stores them, a row a case.

    Centroids come from `turns` turns of k-means over at most `sample` unit vectors, drawn by a hash of the key. There are as many cells as
    the square root of the cases says, CELLS at most. All vectors have one length, that of the first drawn; others are left out.
    """
    rows = _vectors(cases, key, vector)
    drawn = rows.orderBy(F.xxhash64("k"), "k").limit(sample).select("v").toArrow().column("v").to_pylist()
    drawn = np.array([v for v in drawn if len(v) == len(drawn[0])], float) if drawn else np.zeros((0, 1))
    n = min(len(drawn), cells or max(1, min(CELLS, int(cases.count() ** 0.5))))
    centroids = drawn[:n].copy()
    for _ in range(turns if n > 1 else 0):
        nearest_cell = (drawn @ centroids.T).argmax(axis=1)
        for i in range(n):
            total = drawn[nearest_cell == i].sum(axis=0)
            size = np.linalg.norm(total)
            centroids[i] = total / size if size else centroids[i]
    dealt = write_table(_cells(rows.where(F.col("dims") == drawn.shape[1]), centroids, 1).drop("place") if n else rows.withColumn("cell", F.lit(0)).limit(0), "cells")
    return CaseIndex(centroids, dealt, dealt.groupBy("cell").agg(F.count("*").alias("n")))


def probes_for(index: CaseIndex, cases: DataFrame, recall: float = 0.95, sample: int = 200, k: int = 5, key: str = "transaction_id", vector: str = "embedding") -> int:
    """How many cells a query has to look into so that it finds `recall` of its k nearest cases: measured for at most `sample` cases,
    drawn by a hash of the key, against all others. What is hard to tell apart by distance needs many cells."""
    drawn = write_table(cases.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).orderBy(F.xxhash64(key, F.lit(1)), key).limit(sample), "drawn")
    if not len(index.centroids):
        return 1
    wanted = _vectors(drawn, key, vector).where(F.col("dims") == index.centroids.shape[1])
    order = _cells(wanted, index.centroids, len(index.centroids)).select(F.col("k").alias("query_id"), "cell", "place")
    found = nearest(drawn, cases, k, key, vector).select("query_id", F.col(key).alias("k")).join(index.rows.select("k", "cell"), "k")
    places = sorted(r.place for r in found.join(order, ["query_id", "cell"]).select("place").collect())  # at most sample * k
    return places[max(0, math.ceil(recall * len(places)) - 1)] + 1 if places else 1


def nearest_by_index(queries: DataFrame, index: CaseIndex, k: int = 5, probes: int = 8, key: str = "transaction_id", vector: str = "embedding") -> DataFrame:
    """As nearest(), of the cases in the `probes` cells nearest to each query only: similarities are exact, a neighbour in another cell is missed.

    A cell's cases are packed into blocks of bounded size, and the queries that look into it meet each block, so a cell with very
    many cases is many tasks.
    """
    blocks = index.counts.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"))
    c = _blocks(index.rows.join(blocks, "cell"), F.col("n_blocks"), "c") if len(index.centroids) else _blocks(index.rows, F.lit(1), "c")
    wanted = _vectors(queries, key, vector).where(F.col("dims") == index.centroids.shape[1])
    probing = _cells(wanted, index.centroids, probes).drop("place") if len(index.centroids) else wanted.withColumn("cell", F.lit(0)).limit(0)
    n_queries = max(1, -(-queries.count() * probes // (QUERY_BLOCK * max(1, len(index.centroids)))))
    q = _blocks(probing, F.lit(n_queries), "q").join(blocks, "cell").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return _best(q.join(c, ["dims", "cell", "c"]), k, key)


def ingest_report(stored: DataFrame) -> DataFrame:
    """One row: how many cases there are after an ingest, of which outcome, and how many are from chargebacks."""
    return stored.agg(F.count("*").alias("cases"), F.count_if("is_fraud").alias("fraud"), F.count_if(~F.col("is_fraud")).alias("legitimate"), F.count_if(F.col("resolution") == "chargeback").alias("from_chargebacks"))


def stored_embedders(cases: DataFrame) -> DataFrame:
    return cases.select("embedder").distinct().orderBy("embedder")


def check_embedder(cases: DataFrame, name: str) -> None:
    """An error if vectors of another embedder are stored; `unknown` passes."""
    others = [r.embedder for r in stored_embedders(cases).where(~F.col("embedder").isin(name, "unknown")).limit(10).collect()]
    if others:
        raise ValueError(f"stored vectors come from {others}, queries from {name!r}")


def upsert(stored: DataFrame, new: DataFrame, key: str = "transaction_id", updates: Sequence[str] = CASE_UPDATES) -> DataFrame:
    """stored with new rows in: of keys on both sides, `updates` come from new and the rest stays as it was."""
    columns = stored.columns
    a, b = stored.alias("a"), new.select(*[c for c in columns if c in new.columns]).alias("b")
    isnew, old = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    pick = []
    for c in columns:
        if c not in new.columns:
            pick.append(F.col(f"a.{c}").alias(c))
        elif c == key:
            pick.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
        elif c in updates:
            pick.append(F.when(isnew, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            pick.append(F.when(old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*pick)


def upsert_reviews(stored: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(stored, new, updates=REVIEW_UPDATES)


def cases_from_reviews(reviews: DataFrame, facts: DataFrame) -> DataFrame:
    """Reviews as confirmed cases. facts: transaction_id, card_token, occurred_at, amount, features."""
    rows = reviews.join(facts, "transaction_id")
    text = describe(F.col("features"), F.col("amount"), F.col("platform_decision"))
    return rows.select(
        "transaction_id", "card_token", "occurred_at", "amount", F.col("platform_decision").alias("decision"), (F.col("verdict") == "fraud").alias("is_fraud"), F.col("reviewed_at").alias("confirmed_at"),
        F.lit("analyst_review").alias("resolution"), text.alias("description"), F.col("features").alias("facts"), embed(text).alias("embedding"), F.lit("hashed-ngrams").alias("embedder"),
    )


def cases_from_confirmed(confirmed: DataFrame) -> DataFrame:
    """Cases of decisions with known labels (confirmed_cases), ready for upsert."""
    amount = F.coalesce(F.try_element_at("features", F.lit("amount")), F.lit(0.0))
    optional = lambda c: F.col(c) if c in confirmed.columns else None
    text = describe(F.col("features"), amount, F.col("decision"), optional("product_cd"), optional("device_type"))
    return confirmed.select(
        "transaction_id", "card_token", F.col("decided_at").alias("occurred_at"), amount.alias("amount"), "decision", (F.col("is_fraud") == 1).alias("is_fraud"), F.col("label_available_at").alias("confirmed_at"),
        F.lit("chargeback").alias("resolution"), text.alias("description"), F.col("features").alias("facts"), embed(text).alias("embedding"), F.lit("hashed-ngrams").alias("embedder"),
    )


def recent_reviews(reviews: DataFrame, limit: int = 50) -> DataFrame:
    return reviews.orderBy(F.desc("reviewed_at"), "transaction_id").limit(limit)


def agreement_rate(reviews: DataFrame, newest: int = 1000) -> DataFrame:
    """One row: how often the newest reviews confirm the platform; null without reviews."""
    return recent_reviews(reviews, newest).agg(F.avg(agreed(F.col("platform_decision"), F.col("verdict")).cast("double")).alias("agreement_rate"))


def retrieval_precision(neighbours: DataFrame, outcomes: DataFrame, key: str = "transaction_id") -> DataFrame:
    """(query_id, retrieved, matching, precision); outcomes: key, is_fraud."""
    mine = outcomes.select(F.col(key).alias("query_id"), F.col("is_fraud").alias("_q"))
    rows = neighbours.join(mine, "query_id").join(outcomes.select(key, F.col("is_fraud").alias("_c")), key)
    out = rows.groupBy("query_id").agg(F.count("*").alias("retrieved"), F.count_if(F.col("_q") == F.col("_c")).alias("matching"))
    return out.withColumn("precision", F.col("matching") / F.col("retrieved"))
