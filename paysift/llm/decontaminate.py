"""Benchmark decontamination by a positional inverted index, intersected from the rarest test terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.llm.common import LAST_ID, ordered_id, raw_texts, record_batch, write_table
from paysift.llm.words import text_hashes

WINDOW = 10
SALTS = 16
#: A shard of the index has about so many words at most, but whole texts.
SHARD_WORDS = 1 << 20
_COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
_POSTINGS = pa.schema([("_did", pa.int64()), ("_key", pa.int64()), ("term", pa.int64()), ("pos", pa.int64())])
_SHARD = pa.schema([*[(n, pa.list_(pa.int64())) for n in ("dids", "keys", "n_words")], ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key: what tells a row's text from others of the same id; rows equal in both have equal results."""
    text = F.col(text_col).cast("string")
    return docs.select(ordered_id(id_col).alias("_did"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"), text.alias("_text"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms): the word hashes of every item with words; repeated items once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [text_hashes(raw, folded=True).view(np.int64) for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.where("item IS NOT NULL AND text IS NOT NULL").distinct().mapInArrow(run, "item string, terms array<long>").where("size(terms) > 0")


def term_filter(terms: DataFrame, bits: int = 20) -> np.ndarray:
    """A bitmap of 2**bits bits of column term. Its size is fixed; false hits end in the joins that follow."""
    slot = F.col("term").bitwiseAND(F.lit((1 << bits) - 1))
    words = terms.groupBy(F.shiftright(slot, 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("i").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint64)


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes a bitmap may have."""
    slot = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of all words of all texts; it knows no benchmark and serves any.

    A row is a shard of whole texts: their ids, keys and word counts, every term of the shard (word hashes in order), how
    many postings each has, and the postings by term: places of words in the shard, in which texts follow each other.
    """
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dids, keys, held, size = [], [], [], 0
        for batch in batches:
            for did, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
                words = text_hashes(raw, folded=True)
                dids.append(did)
                keys.append(key)
                held.append(words)
                size += len(words)
                if size >= SHARD_WORDS or len(held) >= 1 << 14:
                    yield shard(dids, keys, held)
                    dids, keys, held, size = [], [], [], 0
        if held:
            yield shard(dids, keys, held)

    def shard(dids: list[int], keys: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(held)
        order = np.argsort(words, kind="stable")
        ordered = words[order]
        first = np.flatnonzero(np.concatenate(([True] * bool(len(ordered)), ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(ordered)))
        parts = (ordered[first], counts.astype(np.uint32), order.astype(np.uint32))
        return record_batch(_SHARD, [dids], [keys], [[len(w) for w in held]], *[[x.tobytes()] for x in parts])

    return write_table(rows.mapInArrow(run, "dids array<long>, keys array<long>, n_words array<long>, terms binary, counts binary, places binary"), "index")


def _numbers(batch: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[0].as_buffer(), kind)


def term_counts(index: DataFrame, wanted: Broadcast) -> DataFrame:
    """(term, n): corpus counts of the terms in the filter, from the index alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.slice(r, 1)
                terms, counts = _numbers(part, "terms", np.uint64), _numbers(part, "counts", np.uint32)
                found = _known(wanted.value, terms)
                yield record_batch(_COUNTS, pa.array(terms[found].view(np.int64)), pa.array(counts[found].astype(np.int64)))

    return index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(index: DataFrame, wanted: Broadcast, texts: Broadcast | None = None) -> DataFrame:
    """(_did, _key, term, pos) of the terms in the filter, in all texts or in those whose keys the filter texts may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.slice(r, 1)
                terms, counts, places = _numbers(part, "terms", np.uint64), _numbers(part, "counts", np.uint32), _numbers(part, "places", np.uint32)
                dids, keys, sizes = (part.column(n)[0].values.to_numpy() for n in ("dids", "keys", "n_words"))
                ends = np.cumsum(sizes)
                take = np.flatnonzero(_known(wanted.value, terms))
                counts = counts.astype(np.int64)
                first = np.cumsum(counts) - counts
                n = counts[take]
                at = places[np.repeat(first[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
                found = np.repeat(terms[take], n)
                text = np.searchsorted(ends, at, side="right")
                if texts is not None:
                    keep = _known(texts.value, keys.view(np.uint64))[text]
                    at, found, text = at[keep], found[keep], text[keep]
                pos = at - (ends - sizes)[text]
                for lo in range(0, len(at), 1 << 18):
                    cut = slice(lo, lo + (1 << 18))
                    yield record_batch(_POSTINGS, *[pa.array(x[cut]) for x in (dids[text], keys[text], found.view(np.int64), pos)])

    return index.select("dids", "keys", "n_words", "terms", "counts", "places").mapInArrow(run, "_did long, _key long, term long, pos long")


def _windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, start, size, r): every window of an item, with its terms that the corpus has as (n, q, term), rarest first."""
    terms = items.select("item", F.size("terms").alias("len"), F.posexplode("terms").alias("q", "term"))
    length = F.least(F.lit(window), F.col("len"))
    first, last = F.greatest(F.lit(0), F.col("q") - length + 1), F.least(F.col("q"), F.col("len") - length)
    inside = terms.join(counts, "term", "left").select("item", "term", "q", "n", F.explode(F.sequence(first, last)).alias("start"))
    known = F.when(F.col("n").isNotNull(), F.struct("n", "q", "term"))
    return inside.groupBy("item", "start").agg(F.array_sort(F.collect_list(known)).alias("r"), F.count("*").alias("size"))


def window_anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, start, q1, t1, q2, t2): the two rarest terms of every window of an item, by corpus count.

    A term that the corpus lacks has no postings: its windows are left out. A window of one word has t2 null.
    """
    r = F.col("r")
    second = F.get(r, F.lit(1))
    return _windows(items, counts, window).where("size(r) = size").select("item", "start", r[0].q.alias("q1"), r[0].term.alias("t1"), second.q.alias("q2"), second.term.alias("t2"))


def _salt() -> Column:
    """What deals an item that many documents hold over SALTS keys of a join."""
    return F.pmod(F.xxhash64("_did", "_key"), F.lit(SALTS)).cast("int")


def _salted(items: DataFrame) -> DataFrame:
    return items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def candidates(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """(_did, _key, item, shift): offsets at which both of a window's rarest terms stand where the item has them; found are
    the postings of those terms."""
    places = anchors.select("item", F.explode(F.array(F.struct(F.col("q1").alias("q"), F.col("t1").alias("term")), F.struct(F.col("q2").alias("q"), F.col("t2").alias("term")))).alias("a")).select("item", "a.*").where("term IS NOT NULL").distinct()
    seen = found.join(places, "term").groupBy("_did", "_key", "item", (F.col("pos") - F.col("q")).alias("shift")).agg(F.collect_set("q").alias("qs"))
    pairs = _salted(anchors.groupBy("item").agg(F.collect_set(F.struct("q1", "q2")).alias("pairs")))
    both = F.exists("pairs", lambda p: F.array_contains("qs", p.q1) & (p.q2.isNull() | F.coalesce(F.array_contains("qs", p.q2), F.lit(False))))
    return seen.withColumn("salt", _salt()).join(pairs, ["item", "salt"]).where(both).select("_did", "_key", "item", "shift")


def _filter_of(spark: SparkSession, terms: DataFrame) -> Broadcast:
    return spark.sparkContext.broadcast(term_filter(terms))


class _Query:
    """Benchmark items against an index: their terms, filters and corpus counts."""

    def __init__(self, index: DataFrame, items: DataFrame, item_col: str, item_text_col: str) -> None:
        self.index, self.spark = index, index.sparkSession
        self.items = write_table(item_terms(items, item_col, item_text_col), "items")
        each = self.items.select(F.explode("terms").alias("term"))
        self.wanted = _filter_of(self.spark, each)
        self.counts = term_counts(index, self.wanted).join(each.distinct(), "term", "left_semi")

    def lists(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms in column term, and of others that the filter lets pass."""
        return postings(self.index, _filter_of(self.spark, terms.where("term IS NOT NULL")))

    def lists_of_texts(self, keys: DataFrame) -> DataFrame:
        """Postings of all item terms in the texts of column _key."""
        return postings(self.index, self.wanted, _filter_of(self.spark, keys.select(F.col("_key").alias("term"))))


def phrase_runs(index: DataFrame, items: DataFrame, window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(_did, _key, item, shift, starts, size): the item words `starts` from which size words stand in the text at shift + start.

    Lists are intersected from the rarest terms: postings of the two rarest terms of every window that agree on an offset
    give candidates, and only texts with a candidate have the lists of the other terms read and joined, each posting by its
    place less the offset. All equality comes from the index; no text is read again.
    """
    query = _Query(index, items, item_col, item_text_col)
    anchors = write_table(window_anchors(query.items, query.counts, window), "anchors")
    found = write_table(candidates(query.lists(anchors.select(F.explode(F.array("t1", "t2")).alias("term"))), anchors), "candidates")
    words = _salted(query.items.select("item", F.least(F.lit(window), F.size("terms")).alias("size"), F.posexplode("terms").alias("q", "term")))
    expected = found.withColumn("salt", _salt()).join(words, ["item", "salt"]).withColumn("pos", F.col("shift") + F.col("q")).where("pos >= 0")
    matched = expected.join(query.lists_of_texts(found), ["_did", "_key", "pos", "term"])
    aligned = matched.groupBy("_did", "_key", "item", "shift", "size").agg(F.sort_array(F.collect_set("q")).alias("qs"))
    starts = F.filter("qs", lambda q, i: F.get("qs", i + F.col("size") - 1) == q + F.col("size") - 1)
    return aligned.select("_did", "_key", "item", "shift", "size", starts.alias("starts")).where("size(starts) > 0")


def phrases(index: DataFrame, items: DataFrame, window: int = WINDOW, **columns: str) -> DataFrame:
    """(id, item, start, end): every occurrence of an item's window in a text, in text words; end is not included."""
    runs = phrase_runs(index, items, window, **columns).select("_did", "item", "size", "shift", F.explode("starts").alias("s")).withColumn("start", F.col("s") + F.col("shift"))
    return runs.select(F.nullif("_did", F.lit(LAST_ID)).alias("id"), "item", "start", (F.col("start") + F.col("size")).alias("end")).distinct()


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, key (xxhash64 of the text), n_words, n_hit, items (sorted ids).

    Builds the index of docs and finds the exact phrases of items in it. A word is hit if a window of `window` item words, or
    the whole of a shorter item, stands over it. Null and empty texts have no words and no hits; so have all texts if there
    are no items. Items that are null, have a null id or no words are left out; items that share an id count as one.
    Repeated rows get equal results; other columns are ignored; no rows give no rows. No row holds more than the
    item's own words for an offset, so a text may repeat a passage as often as it likes.
    """
    index = build_index(docs, id_col, text_col)
    runs = write_table(phrase_runs(index, items, window, item_col, item_text_col), "runs")
    over = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1))))
    words = runs.select("_did", "_key", F.explode(over).alias("q"), "shift").select("_did", "_key", (F.col("q") + F.col("shift")).alias("pos")).distinct()
    n_hit = words.groupBy("_did", "_key").agg(F.count("*").alias("n_hit"))
    hit = n_hit.join(runs.groupBy("_did", "_key").agg(F.sort_array(F.collect_set("item")).alias("items")), ["_did", "_key"])
    every = index.select(F.explode(F.arrays_zip("dids", "keys", "n_words")).alias("t")).select(F.col("t.dids").alias("_did"), F.col("t.keys").alias("_key"), "t.n_words")
    return every.join(hit, ["_did", "_key"], "left").select(
        F.nullif("_did", F.lit(LAST_ID)).alias("id"), F.col("_key").alias("key"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def proximity_matches(
    docs: DataFrame, items: DataFrame, slop: int = 5, window: int = WINDOW, share: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item, start): item windows of which at least `share` of the words stand in the text, none more than slop words off
    another's place. Edited copies are found too: words that the corpus lacks are passed over, and any two of a window's three rarest
    words that stand within slop words of their distance in the item start a comparison. Repeated rows, nulls and empty tables are as in matches().
    """
    query = _Query(build_index(docs, id_col, text_col), items, item_col, item_text_col)
    least = F.ceil(F.col("size") * share)
    windows = write_table(_windows(query.items, query.counts, window).withColumn("r", F.filter("r", lambda x: x.isNotNull())).where(F.size("r") >= least), "windows")
    rarest = windows.select("item", "start", "size", F.posexplode(F.slice("r", 1, 3)).alias("rank", "a")).select("item", "start", "size", "rank", "a.q", "a.term")
    seen = query.lists(rarest.select("term")).join(rarest, "term").select("_did", "_key", "item", "start", "size", "rank", (F.col("pos") - F.col("q")).alias("shift"))
    # offsets within slop of each other fall into one of two overlapping bands
    width, by = max(1, 2 * slop), ["_did", "_key", "item", "start", "size", "band"]
    banded = seen.withColumn("band", F.explode(F.array(F.floor(F.col("shift") / width) * 2, F.floor((F.col("shift") + slop) / width) * 2 + 1)))
    other = banded.select(*by, F.col("rank").alias("rank2"), F.col("shift").alias("shift2"))
    both = banded.join(other, by).where((F.col("rank") < F.col("rank2")) & (F.abs(F.col("shift") - F.col("shift2")) <= slop))
    near = both.select(*by[:-1], F.least("shift", "shift2").alias("low"), F.greatest("shift", "shift2").alias("high"))
    alone = seen.where("size = 1").select(*by[:-1], F.col("shift").alias("low"), F.col("shift").alias("high"))
    found = write_table(near.unionByName(alone).distinct(), "near")
    words = windows.select("item", "start", F.explode("r").alias("a")).select("item", "start", "a.q", "a.term")
    expected = found.withColumn("salt", _salt()).join(_salted(words), ["item", "start", "salt"]).drop("salt")
    lists = query.lists_of_texts(found)
    place = F.col("pos") - F.col("q")
    met = expected.join(lists, ["_did", "_key", "term"]).where((place >= F.col("high") - slop) & (place <= F.col("low") + slop))
    counted = met.groupBy("_did", "_key", "item", "start", "size", "low", "high").agg(F.count_distinct("q").alias("n")).where(F.col("n") >= least)
    return counted.select(F.nullif("_did", F.lit(LAST_ID)).alias("id"), "item", "start").distinct()
