"""Ranked lexical search by bag deduplication: documents equal in item terms and length factor are scored once, then expanded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.common import LAST_ID, ordered_id, raw_texts, write_table
from paysift.llm.decontaminate import _known, term_filter
from paysift.llm.words import text_hashes

TOP = 50
#: Bits of the filter of item terms, and of the filters of hits.
FILTER_BITS = 23
#: A block of items has about so many (item, term) pairs, or one item.
BLOCK_PAIRS = 1 << 18
_CELLS = 1 << 20
_POSTING = np.dtype([("term", "<i8"), ("tf", "<u4")])
_BAG = pa.schema([("did", pa.int64()), ("n", pa.int64()), ("bag", pa.binary())])
_HIT = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("class", pa.int64()), ("did", pa.int64()), ("size", pa.int64())])


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct word hashes of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.unique(text_hashes(raw, folded=True)).view(np.int64) for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, terms array<long>").select("item", F.explode("terms").alias("term")).distinct()


def document_bags(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """(did, n, bag) of every document with terms: how many it has, and its counts of the vocabulary (column term) as postings in
    the order of their terms, 12 bytes each.

    Terms are told by a filter of fixed size. What it lets pass besides the vocabulary makes classes finer and scores nothing.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(term_filter(vocabulary, bits))
    rows = docs.select(ordered_id(id_col).alias("did"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bags = [], []
            for raw in raw_texts(batch.column(1)):
                words = text_hashes(raw, folded=True)
                terms, counts = np.unique(words[_known(wanted.value, words)], return_counts=True)
                bag = np.empty(len(terms), _POSTING)
                bag["term"], bag["tf"] = terms.view(np.int64), counts
                sizes.append(len(words))
                bags.append(bag.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], schema=_BAG)

    return rows.mapInArrow(run, "did long, n long, bag binary").where("n > 0")


def _postings(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All postings of a column of bags, and how many each has."""
    _, offsets, data = bags.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(bags.type) else np.int32)[bags.offset : bags.offset + len(bags) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(_POSTING) if ends[-1] > ends[0] else np.zeros(0, _POSTING)
    return flat, np.diff(ends) // _POSTING.itemsize


def term_frequencies(classes: DataFrame) -> DataFrame:
    """(term, df): how many documents hold a term, counted by class and in each batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            postings, counts = _postings(batch.column(0))
            terms, of = np.unique(postings["term"], return_inverse=True)
            df = np.zeros(len(terms), np.int64)
            np.add.at(df, of, np.repeat(batch.column(1).to_numpy(), counts))
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df)], names=["term", "df"])

    return classes.select("bag", "size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class _Block:
    """Items of one block with their terms and weights, and the best classes that a task has met."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, top: int) -> None:
        order = np.lexsort((item, term))
        self.of, self.top, self.items = item[order], top, int(item.max()) + 1
        self.terms, first = np.unique(term[order], return_index=True)
        self.weight, self.bounds = weight[order][first], np.append(first, len(order))

    def scores(self, postings: np.ndarray, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The score of every class (column) for every item (row)."""
        at = np.minimum(np.searchsorted(self.terms, postings["term"]), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == postings["term"])
        at, of = at[found], np.repeat(np.arange(len(counts)), counts)[found]
        tf = postings["tf"][found].astype(np.int64)
        part = self.weight[at] * (1_000_000_000 * tf // (1000 * tf + 20 * m[of]))
        many = self.bounds[at + 1] - self.bounds[at]
        place = np.repeat(self.bounds[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out = np.zeros(self.items * len(counts), np.int64)
        np.add.at(out, self.of[place] * len(counts) + np.repeat(of, many), np.repeat(part, many))
        return out.reshape(self.items, len(counts))

    def cut(self, held: list[np.ndarray]) -> list[np.ndarray]:
        """Of rows (item, score, class, did, size) each item's best, by score, then smallest document."""
        order = np.lexsort((held[2], held[3], -held[1], held[0]))
        item = held[0][order]
        inside = np.arange(len(item)) - np.searchsorted(item, item)
        return [x[order[inside < self.top]] for x in held]

    def best(self, batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        held = [np.zeros(0, np.int64) for _ in range(5)]
        least = np.ones(self.items, np.int64)
        step = max(1, _CELLS // self.items)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                number, did, size, m = (part.column(i).to_numpy() for i in range(4))
                scores = self.scores(*_postings(part.column(4)), m)
                if len(m) > self.top:
                    ranked = np.partition(scores, len(m) - self.top, axis=1)[:, len(m) - self.top]
                else:
                    ranked = least
                item, at = np.nonzero(scores >= np.maximum(least, ranked)[:, None])
                held = self.cut([np.concatenate(x) for x in zip(held, (item, scores[item, at], number[at], did[at], size[at]))])
                full = np.bincount(held[0], minlength=self.items) >= self.top
                last = np.searchsorted(held[0], np.arange(self.items), side="right") - 1
                least[full] = np.maximum(1, held[1][last[full]])
        return held


def _passing(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of df whose key a filter of fixed size has that is made of the wanted keys; some others pass too."""
    bitmap = df.sparkSession.sparkContext.broadcast(term_filter(wanted.select(F.xxhash64(wanted_key).alias("term")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _known(bitmap.value, batch.column(0).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(hit)).select(batch.schema.names[1:])

    return df.select(F.xxhash64(key).alias("_hash"), *df.columns).mapInArrow(run, df.schema)


def _score(classes: DataFrame, weights: DataFrame, top: int) -> DataFrame:
    """(item, score, class, did, size): each item's best classes in every task, items block by block.

    A block's items are numbered in the order of their ids, so a task needs numbers only.
    """
    spark, weights = classes.sparkSession, write_table(weights, "weights")
    blocks, found = max(1, -(-weights.count() // BLOCK_PAIRS)), None
    for b in range(blocks):
        rows = weights.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").toArrow()
        if not rows.num_rows:
            continue
        names = rows.column("item").combine_chunks()
        changed = np.concatenate(([False], [x != y for x, y in zip(names.to_pylist()[1:], names.to_pylist())]))
        number = np.cumsum(changed)
        block = spark.sparkContext.broadcast(_Block(number, rows.column("term").to_numpy(), rows.column("w").to_numpy(), top))
        items = names.take(pa.array(np.flatnonzero(np.concatenate(([True], changed[1:]))))).to_pylist()

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held = block.value.best(batches)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held], schema=_HIT)

        part = classes.select("class", "did", "size", "m", "bag").mapInArrow(run, "item long, score long, class long, did long, size long")
        part = part.withColumn("item", F.get(F.lit(items).cast("array<string>"), F.col("item").cast("int")))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "item string, score long, class long, did long, size long")


def _first(rows: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's `top` documents of the highest scores above 0, equal scores by ascending id.

    Terms are runs of letters and digits (all of non-ASCII counts as letters), A-Z in small letters. Documents are cut to the
    terms that some item has. Those equal in the counts of these terms and in their length factor m are one class: they are dealt by a
    hash and compared as a whole, wherever they meet. A class is scored once for all items, whose best classes, by score and
    smallest id, hold their best documents; only those are expanded, by their `top` smallest ids.

    Each row of docs is a document, so repeated rows have ranks of their own and rows may share an id; a null id comes last.
    Null and empty texts are no documents. Rows of items that share an id, or have none, are one item with the terms of all; items
    without terms have no rows. Ties are settled by id; other columns are ignored; without documents or items there are no rows.
    """
    terms = write_table(query_terms(items, item_col, item_text_col), "terms")
    bags = write_table(document_bags(docs, terms, id_col, text_col), "bags")
    documents, total = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        documents = total = 1
    factor = 50 + F.expr(f"(50 * n * {documents}L) div {total}L")
    bags = bags.where("length(bag) > 0").select("did", factor.alias("m"), "bag")
    classes = bags.groupBy("m", "bag").agg(F.min("did").alias("did"), F.count("*").alias("size"))
    classes = write_table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    ratio = F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = terms.join(term_frequencies(classes), "term").select("item", "term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    hits = _first(_score(classes, weights, top), ["item"], [F.desc("score"), F.asc("did"), F.asc("class")], top).drop("rank")
    hits = write_table(hits, "hits")
    several = hits.where("size > 1").select("class").distinct()
    chosen = _passing(classes.select("class", "m", "bag"), F.col("class"), several, F.col("class")).join(several, "class", "left_semi")
    chosen = write_table(chosen, "chosen")
    code = F.xxhash64("m", "bag")
    members = _passing(bags, code, chosen, code).withColumn("code", code)
    members = _first(members, ["code", "m", "bag"], [F.asc("did")], top).select("code", "m", "bag", F.col("did").alias("member"))
    expanded = members.join(chosen.withColumn("code", code), ["code", "m", "bag"]).select("class", "member")
    alone = hits.where("size = 1").select("item", "score", F.col("did").alias("member"))
    every = hits.where("size > 1").join(expanded, "class").select("item", "score", "member").unionByName(alone)
    ranked = _first(every, ["item"], [F.desc("score"), F.asc("member")], top)
    return ranked.select(F.col("item").cast(items.schema[item_col].dataType).alias("item_id"), "rank", F.nullif("member", F.lit(LAST_ID)).alias("doc_id"), "score")
