"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.common import write_table

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("evaluated", pa.int64())])
#: Rows that pivots are chosen from; the only vectors that come to the driver.
SAMPLE = 2048


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256) -> DataFrame:
    """(id, v, dims): floor(scale * x) of every component; empty vectors and rows with a null or non-finite part are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(~bad)
    return rows.where("size(v) > 0").select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("dims"))


def choose_pivots(rows: DataFrame, most: float, n_pivots: int) -> dict[int, np.ndarray]:
    """Pivots for each number of components, from a sample of SAMPLE rows: each the row farthest from those before it.

    Rows are lifted: with |c|^2 <= most, a candidate c gets the further component sqrt(most - |c|^2) and a query q gets 0.
    Then the squared distance of both is |q|^2 + most - 2 q.c, so the least distance is the greatest product.
    """
    found: dict[int, list[list[float]]] = {}
    for v in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).to_pylist():
        found.setdefault(len(v), []).append(v)
    pivots = {}
    for dims, vectors in found.items():
        lifted = _lifted(np.array(vectors), most)
        chosen = [int((lifted[:, :-1] ** 2).sum(axis=1).argmax())]
        near = np.full(len(lifted), np.inf)
        while len(chosen) < min(n_pivots, len(lifted)):
            near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(near.argmax()))
        pivots[dims] = lifted[chosen]
    return pivots


def _lifted(v: np.ndarray, most: float | None) -> np.ndarray:
    """most is None for queries."""
    return np.column_stack([v, np.zeros(len(v)) if most is None else np.sqrt(np.maximum(most - (v**2).sum(axis=1), 0))])


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray], most: float | None, n_pivots: int) -> DataFrame:
    """rows with d, the distances to every pivot (0 for pivots that are missing), and cell, the nearest of them."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sizes = part.column(2).to_numpy()
                d, cell = np.zeros((len(sizes), n_pivots)), np.zeros(len(sizes), np.int32)
                for size in np.unique(sizes).tolist():
                    if size in shared.value:
                        rows = np.flatnonzero(sizes == size)
                        v = _lifted(part.column(1).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1), most)
                        p = shared.value[size]
                        square = (v**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * v @ p.T
                        d[rows, : len(p)] = np.sqrt(np.maximum(square, 0))
                        cell[rows] = square.argmin(axis=1)
                offsets = pa.array(np.arange(0, d.size + 1, n_pivots, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel())), pa.array(cell)], names=["id", "v", "dims", "d", "cell"])

    return rows.select("id", "v", "dims").mapInArrow(run, "id long, v array<double>, dims int, d array<double>, cell int")


def _numbered(rows: DataFrame, block: int) -> DataFrame:
    """(dims, cell, blocks, first): how many blocks a cell's rows fill, and the number of its first one within dims."""
    before = Window.partitionBy("dims").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return blocks.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"))


def _packed(rows: DataFrame, cells: DataFrame, no: str, n_pivots: int) -> DataFrame:
    """A row for each block: dims, its number, its cell, ids, v, d (flat) and square; lo and hi, the least and greatest
    distance to every pivot; longest, the greatest squared norm."""
    dealt = rows.join(cells, ["dims", "cell"]).withColumn(no, F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    ends: dict[str, Column] = {name: F.array(*[f(F.get("d", F.lit(i))) for i in range(n_pivots)]) for name, f in (("lo", F.min), ("hi", F.max))}
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    found = dealt.groupBy("dims", no).agg(
        F.sort_array(F.collect_list(F.struct("id", "v", "d"))).alias("rows"), F.first("cell").alias("cell"), F.max(square).alias("longest"), *[c.alias(n) for n, c in ends.items()]
    )
    return found.select("dims", no, "cell", "longest", "lo", "hi", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("v"), F.flatten("rows.d").alias("d"))


def _bound(square: Column, gap: Column, most: float) -> Column:
    return F.floor((square + most - F.pow(F.greatest(F.lit(0.0), gap - 1e-6 * (1 + gap)), F.lit(2.0))) / 2 + 1e-6)


def _search(q: np.ndarray, q_ids: np.ndarray, q_d: np.ndarray, seeds: np.ndarray, c: np.ndarray, ids: np.ndarray, c_d: np.ndarray, most: float, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids, evaluated) of the k best of a block for each query, worst possible where there are fewer.

    |d(q, p) - d(c, p)| over all pivots p bounds a candidate's distance from below, so its product from above. All queries
    take their candidates in the order of the bounds, in growing steps; one stops when no bound left reaches its k-th best
    score, which its seed, a k-th best score found elsewhere, may be instead. When a step would be a quarter of the block, all
    that may still enter is computed as one product.
    """
    low = np.zeros((len(q), len(c)))
    for j in range(c_d.shape[1]):
        np.maximum(low, np.abs(q_d[:, j, None] - c_d[None, :, j]), out=low)
    bound = np.floor(((q**2).sum(axis=1)[:, None] + most - np.maximum(low - 1e-6 * (1 + low), 0) ** 2) / 2 + 1e-6)
    best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    evaluated = np.zeros(len(q), np.int64)
    active = np.flatnonzero(bound.max(axis=1) >= seeds)
    while len(active):
        left = bound[active]
        all_left = 4 * step >= len(c)
        if all_left:
            needed = left >= np.maximum(seeds, best_s[:, k - 1])[active, None]
            needed &= left > -np.inf
            columns = np.flatnonzero(needed.any(axis=0))
            s = np.where(needed[:, columns], q[active] @ c[columns].T, -np.inf)
            i = np.broadcast_to(ids[columns], s.shape)
        else:
            columns = np.argpartition(-left, step - 1, axis=1)[:, :step]
            s, i = np.einsum("qd,qsd->qs", q[active], c[columns]), ids[columns]
            np.put_along_axis(left, columns, -np.inf, axis=1)
            bound[active] = left
        evaluated[active] += s.shape[1]
        s[i == q_ids[active, None]] = -np.inf
        best_s[active], best_i[active] = _best(np.concatenate([best_s[active], s], axis=1), np.concatenate([best_i[active], i], axis=1), k)
        if all_left:
            break
        step *= 4
        active = active[bound[active].max(axis=1) >= np.maximum(seeds, best_s[:, k - 1])[active]]
    return best_s, best_i, evaluated


def _best(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row, ties to smaller ids: only what reaches the k-th greatest is sorted."""
    row, column = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    order = np.lexsort((i[row, column], -s[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[rank < k], column[rank < k]
    return s[row, column].reshape(-1, k), i[row, column].reshape(-1, k)


def _arrays(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    for r in range(batch.num_rows):
        yield [batch.column(n)[r].values.to_numpy() for n in names]


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256, n_pivots: int = 16, block: int = 2048, query_block: int = 256, step: int = 128,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, vec_id, score, evaluated: up to k rows a query and pair of blocks, among them the k best; evaluated is the
    number of products computed for the query and block, given with the first of their rows. See top_products()."""
    rows = write_table(integer_vectors(vectors, id_col, vector_col, scale).distinct(), "vectors")
    most = rows.agg(F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))).first()[0]
    pivots = choose_pivots(rows, most, n_pivots)
    table = write_table(pivot_table(rows, pivots, most, n_pivots), "pivot-table")
    cells = write_table(_numbered(table, block), "cells")
    blocks = write_table(_packed(table, cells, "no", n_pivots), "blocks")
    asked = write_table(pivot_table(rows.where(F.col("id") % every == 0), pivots, None, n_pivots), "queries")
    packed = write_table(_packed(asked, _numbered(asked, query_block), "qno", n_pivots), "query-blocks")
    queries = packed.select("dims", "qno", "cell", *[F.col(n).alias(f"q_{n}") for n in ("longest", "lo", "hi", "ids", "v", "d")])

    def blockwise(seeded: bool):
        names = ("q_ids", "q_v", "q_d", "ids", "v", "d", *["seeds"] * seeded)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, (q_ids, q_v, q_d, ids, v, d, *given) in enumerate(_arrays(batch, names)):
                    n, m = len(q_ids), len(ids)
                    seeds = given[0] if seeded else np.full(n, -np.inf)
                    s, i, evaluated = _search(q_v.reshape(n, -1), q_ids, q_d.reshape(n, -1), seeds, v.reshape(m, -1), ids, d.reshape(m, -1), most, k, step)
                    if not seeded:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([s[:, k - 1]], pa.list_(pa.float64()))], names=["dims", "qno", "seeds"])
                        continue
                    keep = np.isfinite(s) & (s >= seeds[:, None])
                    first = np.zeros(keep.shape, bool)
                    first[np.arange(n), keep.argmax(axis=1)] = True
                    work = np.where(first, evaluated[:, None], 0)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q_ids, keep.sum(axis=1)), i[keep], s[keep].astype(np.int64), work)], schema=_OUT)

        return run

    # a query's first bound on what it needs: the k-th best score of one block of its own cell
    home = queries.join(cells, ["dims", "cell"]).join(blocks.select("dims", F.col("no").alias("first"), "ids", "v", "d"), ["dims", "first"])
    seeds = home.select("dims", "qno", "q_ids", "q_v", "q_d", "ids", "v", "d").mapInArrow(blockwise(False), "dims int, qno int, seeds array<double>")
    none = F.transform("q_ids", lambda i: F.lit(float("-inf")))
    seeded = write_table(queries.join(seeds, ["dims", "qno"], "left").withColumn("seeds", F.coalesce("seeds", none)), "seeded")
    heads = seeded.select("dims", "qno", "q_longest", "q_lo", "q_hi", F.array_min("seeds").alias("least"))
    numbers = cells.groupBy("dims").agg(F.sum("blocks").cast("int").alias("n"))
    met = heads.join(numbers, "dims").withColumn("no", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(blocks.select("dims", "no", "lo", "hi"), ["dims", "no"])
    gap = F.aggregate(F.arrays_zip("q_lo", "q_hi", "lo", "hi"), F.lit(0.0), lambda g, x: F.greatest(g, x.q_lo - x.hi, x.lo - x.q_hi))
    pairs = met.where(_bound(F.col("q_longest"), gap, most) >= F.col("least")).select("dims", "qno", "no")
    both = pairs.join(seeded.select("dims", "qno", "q_ids", "q_v", "q_d", "seeds"), ["dims", "qno"]).repartition("dims", "no")
    full = both.join(blocks.select("dims", "no", "ids", "v", "d"), ["dims", "no"])
    return full.mapInArrow(blockwise(True), "query_id long, vec_id long, score long, evaluated long")


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of every query, ties to smaller ids.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the query's own id.
    Rows with a null id, a null or empty vector or a null or non-finite component take no part. A query meets
    candidates of its own number of components only. Repeated rows count once. Other columns are ignored; no rows
    give no rows.

    Distances of every row to a few pivots are stored once. Rows lie in blocks by their nearest pivot; a block knows the
    range of its distances to each pivot. Queries get a first k-th best score in a block of their cell, pairs of blocks
    whose ranges rule out as good a score are left out, and in the others candidates are taken in the order of their
    bounds until none can enter. sizes are n_pivots, block, query_block and step of search().
    """
    found = search(vectors, every, k, scale, id_col=id_col, vector_col=vector_col, **sizes)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
