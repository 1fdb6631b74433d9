"""SimHash near-duplicate linking with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import pieces, raw_texts, record_batch, write_table
from paysift.llm.graph import components

SEGMENTS, SEGMENT_BITS, SEED = 8, 8, 42
_FP = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    """SimHash (unsigned) of lower-cased size-word shingles; 0 for a text without words."""
    digest = xxhash.xxh64_intdigest
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for piece in pieces((raw or b"").lower()):
        words = tail + piece.split()
        tail = words[max(0, len(words) - size + 1) :]
        if len(words) < size:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -size] + 1)).tolist()
        ends = ends[size - 1 :].tolist()
        for at in range(0, len(starts), 1 << 16):
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
            counts += _bit_counts(hashes)
            total += len(hashes)
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return sum(1 << b for b in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp) of every row of docs; fp is the 64-bit SimHash as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(raw, shingle_words) for raw in raw_texts(batch.column(1))]
            yield record_batch(_FP, batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def ring_masks(distance: int) -> list[tuple[int, int]]:
    """(first segment, bit mask) of every index table.

    Pigeonring: if two words differ in at most `distance` bits over SEGMENTS segments on a ring, some start has
    every prefix of l segments differ in at most floor(l * distance / SEGMENTS) bits. For distance 3 the first two
    segments are equal and the next three hold at most one difference, so two of those three are equal too.
    """
    budget = [length * distance // SEGMENTS for length in range(1, SEGMENTS + 1)]
    equal = sum(b == 0 for b in budget)
    once = sum(b == 1 for b in budget)
    masks = {}
    for start in range(SEGMENTS):
        chain = [(start + i) % SEGMENTS for i in range(equal + once)]
        for left_out in chain[equal:] or [None]:
            mask = sum(0xFF << (SEGMENT_BITS * s) for s in chain if s != left_out)
            masks.setdefault(mask, start)
    return [(start, mask) for mask, start in masks.items()]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _linked(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of fps within distance, by the ring's chains from start and then the whole count."""
    turn = np.uint64(SEGMENT_BITS * start)
    ring = (fps >> turn) | (fps << np.uint64((64 - int(turn)) % 64)) if start else fps
    chains = [(length * distance // SEGMENTS, np.uint64((1 << (SEGMENT_BITS * length)) - 1)) for length in range(1, SEGMENTS)]
    chains = [c for i, c in enumerate(chains) if i + 1 == len(chains) or chains[i + 1][0] > c[0]]
    left, right = [], []
    for at in range(0, len(ring), 256):
        differ = ring[at : at + 256, None] ^ ring[None, :]
        a, b = np.nonzero(np.triu(np.ones(differ.shape, bool), at + 1))
        differ = differ[a, b]
        for most, mask in [*chains, (distance, np.uint64(2**64 - 1))]:
            keep = np.bitwise_count(differ & mask) <= most
            a, b, differ = a[keep], b[keep], differ[keep]
        left.append(a + at)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to its local group's first: one fewer than the group's size, not all pairs."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(distinct: DataFrame, distance: int = 3, block: int = 1024) -> DataFrame:
    """(u, v) links that join all distinct fingerprints (column fp) within distance, transitively.

    Each fingerprint goes into one bucket of each index table. A bucket of over `block` members is dealt into
    blocks, and every pair of blocks is a unit of its own, so no task gets a whole large bucket. Units give
    spanning forests, so rows out stay below members in.
    """
    masks = ring_masks(distance)
    starts = [start for start, _ in masks]
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for _, m in masks])).alias("t", "key")
    )
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    units = (
        keyed.join(sizes, ["t", "key"])
        .select("t", "key", "fp", blocks.alias("n"), mine.alias("own"))
        .select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    by: list[Column] = [F.col(c) for c in ("t", "key", "i", "j")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: np.ndarray) -> pa.RecordBatch:
            """rows: whole units, sorted."""
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            u, v = [], []
            for part in np.split(rows, cuts):
                if len(part) > 1:
                    fps = part[:, 4].view(np.uint64)
                    x, y = _forest(fps, *_linked(fps, starts[int(part[0, 0])], distance))
                    u.append(x)
                    v.append(y)
            none = np.zeros(0, np.uint64)
            return record_batch(_EDGE, *[pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (u, v)])

        rest = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([rest, np.ascontiguousarray(rows)])
            last = (rows[:, :4] == rows[-1, :4]).all(axis=1).argmax() if len(rows) else 0
            rest = rows[last:]
            if last:
                yield edges(rows[:last])
        if len(rest):
            yield edges(rest)

    return units.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle_words: int = 3
) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most `distance` bits. Null and empty texts and
    texts without words have fingerprint zero and link like any other. Repeated rows come back as often as they
    went in. A null id takes no part in the minimum; a group of null ids only has component_id null. Other
    columns are ignored, an empty table gives an empty result.
    """
    prints = write_table(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(classes.select("fp"), distance))
    grouped = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    grouped = write_table(grouped, "simhash-roots")
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return (
        prints.join(grouped.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp")
        .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )
