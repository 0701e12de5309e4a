"""Periodic runs of words, by maximal pairs.

Two places of a text whose following words agree for `lcp` words, and neither one more nor one before, are a maximal pair. A
pair whose distance is at most `lcp` is a periodic stretch that nothing extends, and each such stretch is such a pair, so runs
are read off the pairs without extending anything. The pairs come from the LCP-interval tree over the suffixes of a text, taken
bottom-up: a node holds its places in order, and by the word on their left; where two subtrees join at depth d, each place of the smaller one
looks among the other's places at a distance of d or less for those with another word on the left.

A run of `least` words or more has a pair with lcp of half of them or more, so only texts in which a window of so many words occurs
twice get a tree, and only the part of it below that depth is walked.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import packed, place_of, unpacked

#: Bytes of text whose words are held at once (a single longer text is held whole).
GROUP_BYTES = 2 << 20
#: Words whose numbers are kept from one group of texts to the next, at most about.
KEPT = 200_000


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of x in order, by prefix doubling over those still tied, and the rank of each place by its first 1, 2, 4, .. values.

    Every text in x ends with a value that occurs once, so ties end within their text.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0])
    sizes = np.diff(np.r_[begins, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begins, sizes)
    tied = order[np.repeat(sizes > 1, sizes)]
    levels, h = [rank.astype(np.int32)], 1
    while len(tied):
        a, b = rank[tied], rank[tied + h]
        by = np.argsort(a * n + b)
        tied, a, b = tied[by], a[by], b[by]
        new = np.r_[True, np.diff(a) != 0]  # where a group of the level before begins
        part = new | np.r_[True, np.diff(b) != 0]
        at = np.arange(len(tied))
        parts = np.flatnonzero(part)
        sizes = np.diff(np.r_[parts, len(tied)])
        first = np.repeat(parts, sizes)
        rank[tied] = a + first - np.maximum.accumulate(np.where(new, at, 0))
        tied = tied[np.repeat(sizes > 1, sizes)]
        levels.append(rank.astype(np.int32))
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many values each suffix has in common with the next in order."""
    a, b = order[:-1], order[1:]
    length = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        u, v = a[open_] + length[open_], b[open_] + length[open_]
        same = levels[k][u] == levels[k][v]
        length[open_[same]] += 1 << k
    return length


class Places:
    """The places of a subtree, in order and by the word on their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all, self.by_left = [place], {left: [place]}

    def add(self, place: int, left: int) -> None:
        insort(self.all, place)
        found = self.by_left.get(left)
        if found is None:
            self.by_left[left] = [place]
        else:
            insort(found, place)

    def near(self, place: int, left: int, reach: int) -> list[int]:
        """Places at a distance of reach or less with another word on the left; time goes by their number and its logarithm."""
        lo, hi = bisect_left(self.all, place - reach), bisect_right(self.all, place + reach)
        if lo == hi:
            return []
        same = self.by_left.get(left)
        if same is None:
            return self.all[lo:hi]
        found, todo = [], [(lo, hi, bisect_left(same, place - reach), bisect_right(same, place + reach))]
        while todo:
            lo, hi, a, b = todo.pop()
            if b - a == hi - lo:
                continue
            if b == a:
                found += self.all[lo:hi]
                continue
            mid = (lo + hi) // 2
            cut = bisect_left(same, self.all[mid], a, b)
            todo += [(lo, mid, a, cut), (mid, hi, cut, b)]
        return found


def maximal_pairs(order: list[int], lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, lcp) of the maximal pairs with distance <= lcp and distance + lcp >= least, from suffixes in order."""

    def join(one: Places, two: Places, depth: int) -> Iterator[tuple[int, int, int]]:
        if len(one.all) < len(two.all):
            one, two = two, one
        for p in two.all:
            for q in one.near(p, left[p], depth):
                if abs(p - q) + depth >= least:
                    yield min(p, q), abs(p - q), depth
        for p in two.all:
            one.add(p, left[p])
        joined.append(one)

    joined: list[Places] = []
    open_: list[tuple[int, Places]] = []
    now = Places(order[0], left[order[0]])
    for p, depth in zip(order[1:], lcp, strict=True):
        while open_ and open_[-1][0] >= depth:
            d, node = open_.pop()
            yield from join(node, now, d)
            now = joined.pop()
        open_.append((depth, now))
        now = Places(p, left[p])
    while open_:
        d, node = open_.pop()
        yield from join(node, now, d)
        now = joined.pop()


def runs_of(texts: list[np.ndarray], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and then period. Texts are arrays of word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    depth = (least + 1) // 2
    long = [i for i, t in enumerate(texts) if len(t) > depth]
    if not long:
        return out
    x = np.concatenate([texts[i] for i in long]).astype(np.uint64)
    sizes = np.array([len(texts[i]) for i in long])
    of = np.repeat(np.arange(len(long)), sizes)
    key = of[: len(x) - depth + 1].astype(np.uint64)
    for j in range(depth):  # equal windows of one text have equal hashes; which are equal is settled by the tree
        key = (key ^ x[j : len(x) - depth + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    place = np.flatnonzero(of[: len(key)] == of[depth - 1 :])
    key = key[place]
    by = np.argsort(key)
    again = np.flatnonzero(np.diff(key[by]) == 0)
    texts_again = np.unique(of[place[by[again]]])
    if not len(texts_again):
        return out
    chosen = [long[i] for i in texts_again]
    width = int(x.max()) + 2
    marked = [np.r_[texts[i].astype(np.int64) + 1, 0] + k * width for k, i in enumerate(chosen)]
    starts = np.cumsum([0, *(len(m) for m in marked)])
    x = np.concatenate(marked)
    order, levels = suffix_order(x)
    lcp = common_prefixes(order, levels)
    del levels
    left = np.r_[-1, x[:-1]].tolist()
    for s in starts[:-1]:
        left[s] = -1
    deep = np.flatnonzero(lcp >= depth)
    chains = np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []
    periods: dict[tuple[int, int], int] = {}
    for c in chains:
        a, b = int(c[0]), int(c[-1]) + 2
        for start, period, depth_ in maximal_pairs(order[a:b].tolist(), lcp[a : b - 1].tolist(), left, least):
            stretch = (start, period + depth_)
            if period < periods.get(stretch, period + 1):
                periods[stretch] = period  # multiples of a period give the same stretch
    for (start, length), period in sorted(periods.items(), key=lambda r: (r[0][0], r[1])):
        k = int(bisect_right(starts, start)) - 1
        out[chosen[k]].append((start - int(starts[k]), length, period))
    return out


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(place: int, least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}

        def answer(rows: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
            if len(numbers) > KEPT:
                numbers.clear()
            words, coded = [], []
            for text in texts:
                w = text.split() if text else []  # bytes: white space is 0x20 and 0x09 to 0x0D
                for t in set(w).difference(numbers):
                    numbers[t] = len(numbers)
                words.append(w)
                coded.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
            runs = runs_of(coded, least)
            collapsed = []
            for w, r in zip(words, runs, strict=True):
                if r:
                    w = [t for t, stays in zip(w, _kept(len(w), r).tolist(), strict=True) if stays]
                collapsed.append(b" ".join(w))
            found = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            return pa.RecordBatch.from_arrays([rows, pa.array(found, RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], ["row", *MADE])

        for batch in batches:
            rows = batch.column(0)
            texts = rows.field(place).cast(pa.binary())
            at, held, group = 0, 0, []
            for i in range(len(rows)):
                group.append(texts[i].as_py())
                held += len(group[-1] or b"")
                if held >= GROUP_BYTES:
                    yield answer(rows.slice(at, len(group)), group)
                    at, held, group = i + 1, 0, []
            if group or not len(rows):
                yield answer(rows.slice(at, len(group)), group)

    return find


MADE = ["runs", "collapsed"]


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """docs with runs (array of start, length, period, by start and then period) and collapsed (the words that stay, one space between them).

    A run is a stretch of consecutive words (between white space 0x20, 0x09 to 0x0D) with smallest period q and a length of
    max(least, 2 * q) or more that no neighbouring word extends keeping the period; words are numbered from 0. A word goes from
    `collapsed` if any run holds it after that run's first q words. Null, empty and blank texts have no runs and an empty `collapsed`.
    Every row is answered by itself, so repeated rows and ids are answered alike; columns named runs or collapsed, in whatever case, are
    replaced; an empty table gives an empty result. A task holds one Arrow batch, and words of GROUP_BYTES of text or of one longer text.
    """
    made = StructType.fromDDL("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    schema = StructType([*packed(docs).schema, *made])
    return unpacked(packed(docs).mapInArrow(_finder(place_of(docs, "text"), least), schema), *MADE)
