"""Substring dedup: repeated token k-mers as de Bruijn edges, compacted by joins into spans with compared source coordinates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.common import ordered_id, raw_texts, record_batch, write_table
from paysift.llm.words import FACTOR, paired_hashes, rolling, sliding_min, spaced_words

_SEED = pa.schema([("h", pa.int64()), ("did", pa.int64())])
_RUN = pa.schema([(n, pa.int64()) for n in ("h", "key", "proof", "did", "text_key", "at", "length")])
_EDGE = pa.schema([(n, pa.int64()) for n in ("key", "proof", "did", "text_key", "at", "length")])


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """A row is named by its id and a 64-bit hash of its text, so rows that share an id but not a text keep their own coordinates."""
    text = F.col(text_col).cast("string")
    return docs.select(ordered_id(id_col).alias("_did"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_key"), text.alias("_text"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)])


def _windows(raw: bytes | None, k: int, seed: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of every word, and for every window of k words the least hash of the seed-word runs in it
    (its minimizer)."""
    hashes, proofs = paired_hashes(raw, salt)
    if len(hashes) < k:
        return hashes, proofs, np.zeros(0, np.uint64)
    return hashes, proofs, sliding_min(rolling(hashes, seed), k - seed + 1)


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of column h. Its size is fixed whatever the corpus; false hits cost work, never results."""
    slot = F.shiftright(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int")
    words = values.groupBy(slot.alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("i").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint64)


def seed_filter(rows: DataFrame, k: int, seed: int, bits: int, salt: int) -> np.ndarray:
    """A bitmap of the minimizers in at least two documents. Equal windows have equal minimizers, so a window whose minimizer
    is in one document only can't recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for did, raw in zip(batch.column(0).to_numpy(), raw_texts(batch.column(1))):
                least = np.unique(_windows(raw, k, seed, salt)[2])
                found.append(least)
                of.append(np.full(len(least), did, np.int64))
            yield record_batch(_SEED, pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(of)))

    seeds = rows.select("_did", "_text").mapInArrow(run, "h long, did long")
    return bitmap(seeds.groupBy("h").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi"), bits)


def _in_filter(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _mixed(edges: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of edges, in their order."""
    inside = np.arange(len(edges)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), FACTOR, np.uint64))
    return rolling(np.add.reduceat(edges * powers[inside], first) + lengths.astype(np.uint64), 1)


def edge_runs(rows: DataFrame, repeated: Broadcast, k: int, seed: int, salt: int, bits: int, wanted: Broadcast | None = None) -> DataFrame:
    """(h, key, proof, did, text_key, at, length): consecutive windows of a document with one repeated minimizer h.

    A window is an edge of the de Bruijn graph and a run a first stretch of a path. key, of so many bits, is a hash of its words
    and names it; proof is another hash of the same words, independent of it. With a filter `wanted` of key xor did, the
    edges of the runs that it has are given one by one, as runs of length 1 with the edge's own key and without h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            size = 0
            for did, text_key, raw in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw_texts(batch.column(2))):
                found = runs(raw, did, text_key)
                if found is not None:
                    out.append(found)
                    size += len(found[0])
                if size > 1 << 17:
                    yield record_batch(schema, *[pa.array(np.concatenate(x)) for x in zip(*out)])
                    out, size = [], 0
            if out:
                yield record_batch(schema, *[pa.array(np.concatenate(x)) for x in zip(*out)])

    def runs(raw: bytes | None, did: int, text_key: int) -> tuple[np.ndarray, ...] | None:
        hashes, proofs, least = _windows(raw, k, seed, salt)
        at = np.flatnonzero(_in_filter(repeated.value, least)) if len(least) else least
        if not len(at):
            return None
        h = least[at]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (h[1:] != h[:-1]))))
        lengths = np.diff(np.append(first, len(at)))
        edges, proved = rolling(hashes, k)[at], rolling(proofs, k)[at]
        key = _mixed(edges, first, lengths) >> np.uint64(64 - bits)
        if wanted is None:
            columns = h[first], key, _mixed(proved, first, lengths), np.full(len(first), did), np.full(len(first), text_key), at[first], lengths
        else:
            take = np.repeat(_in_filter(wanted.value, key ^ np.uint64(np.int64(did).view(np.uint64))), lengths)
            n = int(take.sum())
            columns = edges[take] >> np.uint64(64 - bits), proved[take], np.full(n, did), np.full(n, text_key), at[take], np.ones(n, np.int64)
        return tuple(x.astype(np.uint64, copy=False).view(np.int64) if x.dtype == np.uint64 else x for x in columns)

    schema = _RUN if wanted is None else _EDGE
    return rows.select("_did", "_text_key", "_text").mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def _steps(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(did, text_key, at, length, source_did, source_key, shift, odd): runs that a smaller document holds too, joined to their
    sources; odd counts those whose words are not those at the source coordinate."""
    return runs.join(sources.where("last > source.did").select("key", "source"), "key").where("did > source.did").select(
        "did", "text_key", "at", "length", F.col("source.did").alias("source_did"), F.col("source.text_key").alias("source_key"),
        (F.col("at") - F.col("source.at")).alias("shift"), (F.col("proof") != F.col("source.proof")).cast("long").alias("odd"),
    )


def _sources(runs: DataFrame) -> DataFrame:
    """(key, h of any, source, last): the first coordinate that holds a run, the smallest document, its text, then position."""
    extra = [F.min("h").alias("h")] if "h" in runs.columns else []
    return runs.groupBy("key").agg(F.min(F.struct("did", "text_key", "at", "proof")).alias("source"), F.max("did").alias("last"), *extra)


def _compacted(steps: DataFrame) -> DataFrame:
    """(did, text_key, at, length, source_did, source_key, source_at, odd): steps that follow each other, in the document and in
    its source, as one unbranched path."""
    of = ["did", "text_key", "source_did", "source_key", "shift"]
    line = Window.partitionBy(*of).orderBy("at", "length")
    starts = (F.lag(F.col("at") + F.col("length")).over(line) != F.col("at")).cast("int")
    paths = steps.withColumn("path", F.sum(F.coalesce(starts, F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return paths.groupBy(*of, "path").agg(F.min("at").alias("at"), F.sum("length").alias("length"), F.sum("odd").alias("odd")).select(
        "did", "text_key", "at", "length", "source_did", "source_key", (F.col("at") - F.col("shift")).alias("source_at"), "odd"
    )


def repeated_spans(
    docs: DataFrame, k: int = 13, seed: int = 5, filter_bits: int = 26, edge_bits: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(did, text_key, at, length, source_did, source_key, source_at): unbranched paths of repeated k-word windows, each of length + k - 1
    words, that a smaller document holds too at the source coordinate.

    Paths compact in two joins. First, runs of windows that are equal as a whole: all but those of the smallest document
    are repeats of it. What is left, one run of each kind, can still share windows with a run of another kind, but only if
    both have the same minimizer; their windows are joined one by one. Sources are found before the shuffle as far as a task
    can, and the joins split what very many documents share. Then steps that follow each other become one path.

    A path is unbranched in that its windows have their sources one after the other in one document; degrees of nodes are not
    counted. The words at both coordinates are compared by a second, independent 64-bit hash. If two runs or windows share a key without sharing their
    words, all is done again under another salt with keys of 64 bits, until every span is proved.
    """
    rows = _rows(docs, id_col, text_col)
    context = rows.sparkSession.sparkContext
    for salt in range(16):
        bits = 64 if salt else edge_bits
        repeated = context.broadcast(seed_filter(rows, k, seed, filter_bits, salt))
        runs = write_table(edge_runs(rows, repeated, k, seed, salt, bits), "runs")
        sources = write_table(_sources(runs), "sources")
        mixed = sources.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
        names = sources.join(mixed, "h").select(F.col("key").bitwiseXOR(F.col("source.did")).alias("h"))
        edges = write_table(edge_runs(rows, repeated, k, seed, salt, bits, context.broadcast(bitmap(names, filter_bits))), "edges")
        # written, so that either join has shuffles of its own, which adaptive execution can split
        shared = write_table(_sources(edges).where("last > source.did"), "edge-sources")
        steps = _steps(runs, sources).unionByName(_steps(edges, shared))
        spans = write_table(_compacted(steps), "spans")
        if spans.where("odd > 0").isEmpty():
            return spans.drop("odd")
    raise RuntimeError("different words share their hashes under every salt")


def dedup_substrings(
    docs: DataFrame, k: int = 13, seed: int = 5, filter_bits: int = 26, edge_bits: int = 64,
    id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs: the carried columns, then kept_text, n_words, n_removed.

    A word goes if a window of k words that covers it also starts in a document with a smaller id. Windows are
    judged on the input. Null texts have no words and give an empty kept_text; texts of under k words lose nothing.
    A null id counts as the largest. Rows that share an id don't remove each other's words; repeated rows get
    equal results. Other columns than those named are ignored. An empty table gives an empty result. kept_text
    holds the kept words joined by one space.
    """
    spans = repeated_spans(docs, k, seed, filter_bits, edge_bits, id_col, text_col)
    cuts = spans.groupBy("did", "text_key").agg(F.collect_list("at").alias("_at"), F.collect_list("length").alias("_length"))
    rows = _rows(docs, id_col, text_col, carry)
    joined = rows.join(cuts, (rows._did == cuts.did) & (rows._text_key == cuts.text_key), "left")
    names = [f"c_{i}" for i in range(len(carry))]
    joined = joined.select("_text", "_at", "_length", *names)
    schema = ", ".join([*[f"{n} {joined.schema[n].dataType.simpleString()}" for n in names], "kept_text string, n_words long, n_removed long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, n_words, n_removed = [], [], []
                for raw, starts, lengths in zip(raw_texts(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = spaced_words(raw)
                    gone = 0
                    n_words.append(len(words))
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        starts, ends = np.array(starts), np.array(starts) + np.array(lengths) + k - 1
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, ends, -1)
                        hit = np.cumsum(edge[:-1]) > 0
                        gone = int(hit.sum())
                        words = [w for w, x in zip(words, hit.tolist()) if not x]
                    n_removed.append(gone)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[3:], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                    names=[*names, "kept_text", "n_words", "n_removed"],
                )

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "kept_text", "n_words", "n_removed")
