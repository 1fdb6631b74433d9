"""Periodic runs of words: suffix classes united by decreasing LCP, whose newly adjacent positions seed the runs."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import raw_texts
from paysift.llm.words import rolling, spaced_words

#: A run has at least so many words, and so many periods.
SHORTEST, REPEATS = 6, 4
Run = tuple[int, int, int]
Rewrite = Callable[[list[bytes], int | None], list[bytes]]


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for every word, equal for equal words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _starts(same: np.ndarray) -> np.ndarray:
    """For sorted entries, of which same says whether each equals the one before, the place of the first equal one."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))


def _repeats(numbers: np.ndarray, size: int) -> bool:
    """Whether some run of size numbers may stand at two places: its hash does."""
    size = min(size, 64)
    hashes = np.sort(rolling(rolling(numbers.astype(np.uint64) + np.uint64(1), 1), size))
    return bool((hashes[1:] == hashes[:-1]).any())


class Suffixes:
    """Suffixes of a sequence of numbers, in classes by their first 1, 2, 4, ... of them.

    ranks[k][i] is the place of suffix i's class by its first 2**k numbers in the order of all suffixes. Only classes of
    more than one suffix are sorted again for the next power. near has the suffixes that can be part of a run.
    """

    def __init__(self, numbers: np.ndarray, repeats: int) -> None:
        n = self.n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = _starts(np.concatenate(([False], np.diff(numbers[order]) == 0)))
        self.ranks, self._near, self._repeats = [rank], np.zeros(n, bool), repeats
        active, span = self._shared(order, rank[order], 1), 1
        while len(active):
            after = np.full(len(active), -1, np.int64)
            inside = active + span < n
            after[inside] = rank[active[inside] + span]
            key = rank[active] * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")  # positions of one class stay in their order
            active, key = active[order], key[order]
            old = rank[active]
            fresh = old + _starts(np.concatenate(([False], np.diff(key) == 0))) - _starts(np.concatenate(([False], np.diff(old) == 0)))
            rank = rank.copy()
            rank[active] = fresh
            self.ranks.append(rank)
            span *= 2
            active = self._shared(active, fresh, span)
        self.near = np.flatnonzero(self._near)

    def _shared(self, places: np.ndarray, rank: np.ndarray, span: int) -> np.ndarray:
        """Of suffixes in order of class and place, those in classes of more than one; marks the near ones.

        A run whose first suffix agrees with the one a period later on l numbers, span <= l < 2 * span, has a period of at most
        l / (repeats - 1), so some suffix of the class is that close.
        """
        pair = rank[1:] == rank[:-1]
        close = np.flatnonzero(pair & ((self._repeats - 1) * (places[1:] - places[:-1]) < 2 * span))
        self._near[places[close]] = self._near[places[close + 1]] = True
        many = np.zeros(len(places), bool)
        many[1:] |= pair
        many[:-1] |= pair
        return np.sort(places[many])

    def lcp(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes at left and right share."""
        out = np.zeros(len(left), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = left + out, right + out
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[self.ranks[k][a[inside]] == self.ranks[k][b[inside]]]
            out[same] += 1 << k
        return out


def periodic_runs(numbers: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[Run]:
    """(start, length, period) of every run, by start and period.

    Neighbours in suffix order are edges weighted by their LCP. Taken by decreasing weight, as Kruskal does, they unite classes
    of suffixes that share so many words; a class is its positions in order. When positions i < j become neighbours in a
    class whose suffixes share l words, words j - i apart are identical from i to j + l, and no smaller period does, as its
    position would stand between them. So a pair with j - i within l seeds a run, if no word before i extends it.
    Every run of two periods or more is seeded by its first word and the one a period later. Positions that no pair within
    reach can come from (Suffixes.near) take no part.
    """
    least = max(1, shortest - shortest // repeats)  # words that the two suffixes of a seed share at least
    if len(numbers) < shortest or not _repeats(numbers, least):
        return []
    suffixes = Suffixes(numbers, repeats)
    last = suffixes.ranks[-1]
    order = suffixes.near[np.argsort(last[suffixes.near], kind="stable")]
    if len(order) < 2:
        return []
    weight = suffixes.lcp(order[:-1], order[1:])
    edges = np.flatnonzero(weight >= least)
    edges = edges[np.argsort(-weight[edges], kind="stable")]
    of, members = {}, {}
    runs: list[Run] = []
    fresh: list[tuple[int, int]] = []

    def find(x: int) -> int:
        root = x
        while of.setdefault(root, root) != root:
            root = of[root]
        while of[x] != root:
            of[x], x = root, of[x]
        return root

    def close(level: int) -> None:
        """Neighbours of the level that no position came between."""
        for i, j in set(fresh):
            places = members[find(i)]
            if places[bisect_left(places, i) + 1] == j:
                runs.append((i, level + j - i, j - i))
        fresh.clear()

    def seed(i: int, j: int, level: int) -> None:
        d = j - i
        if level + d >= max(shortest, repeats * d) and (i == 0 or numbers[i - 1] != numbers[j - 1]):
            fresh.append((i, j))

    level = -1
    for a, b, shared in zip(order[edges].tolist(), order[edges + 1].tolist(), weight[edges].tolist()):
        if shared != level:
            close(level)
            level = shared
        a, b = find(a), find(b)
        large, small = members.setdefault(a, [a]), members.setdefault(b, [b])
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        # neighbours within the smaller class are not new
        of[b] = a
        del members[b]
        moved = set(small)
        for x in small:
            at = bisect_left(large, x)
            large.insert(at, x)
            if at and large[at - 1] not in moved:
                seed(large[at - 1], x, level)
            if at + 1 < len(large) and large[at + 1] not in moved:
                seed(x, large[at + 1], level)
    close(level)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge).tolist()) if not gone]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, then the smallest start, then the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's contract: one document in ten, by the checksum of its id, gets a periodic tail."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def collapse_runs(
    docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs: the carried columns, then n_words, runs (start, length, period), strongest and collapsed_text.

    A run is a stretch of words between white space in which words `period` apart are identical, at least `shortest`
    words and `repeats` periods long, that no neighbouring word extends; period is its smallest. collapsed_text has
    the words that no run holds after its first period, joined by one space. strongest is null where there is no run.
    repeats is at least 2. With rewrite, the words of each row go through it first. Null and empty texts have no words and no
    runs. Rows are judged one by one, so repeated rows get equal results and ids may be null or repeated; other columns
    are ignored; no rows give no rows. A text is one task's work, in memory of its words by the logarithm of their number.
    """
    if repeats < 2 or shortest < 2:
        raise ValueError("a run has at least two words and two periods")
    names = [f"c_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("_did"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    named = lambda r: dict(zip(("start", "length", "period"), r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, found, best, kept = [], [], [], []
                for did, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                    words = spaced_words(raw)
                    if rewrite is not None:
                        words = rewrite(words, did)
                    runs = periodic_runs(_numbered(words), shortest, repeats)
                    top = strongest(runs)
                    sizes.append(len(words))
                    found.append([named(r) for r in runs])
                    best.append(top and named(top))
                    kept.append(b" ".join(collapsed(words, runs) if runs else words))
                columns = [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(run_type)), pa.array(best, run_type), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *columns], names=[*names, "n_words", "runs", "strongest", "collapsed_text"])

    of_run = "start: bigint, length: bigint, period: bigint"
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    out = rows.mapInArrow(run, ", ".join([*kinds, f"n_words bigint, runs array<struct<{of_run}>>, strongest struct<{of_run}>, collapsed_text string"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "n_words", "runs", "strongest", "collapsed_text")
