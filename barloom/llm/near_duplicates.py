"""MinHash near-duplicates by a multi-index Hamming join.

Signatures of k b-bit MinHash values (b = 16) are split into chunks of four. By the pigeonhole principle two signatures
that differ in at most 2 * chunks - 1 values have a chunk with at most one error, so the four ways to leave out one value
of each chunk give a key that both share: every pair under the signature distance meets. Documents that meet are compared
on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, packed, small, stage, unpacked
from .graph import components

CHUNK = 4
#: Documents and shingles that one cell of a group's pair matrix holds at most, about.
CELL_DOCS, CELL_SHINGLES = 512, 1 << 20
U = np.uint64


def chunks_for(similarity: float, lost: float = 1e-5, most: int = 40) -> int:
    """The fewest chunks for which a pair at the similarity exceeds the guaranteed distance with a probability below lost."""
    p = 1 - similarity
    for m in range(2, most):
        k, reach = m * CHUNK, 2 * m - 1
        if sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(reach + 1, k + 1)) < lost:
            return m
    return most


class Shingles:
    """Texts to sorted arrays of distinct 64-bit shingle hashes. Keeps the hashes of words it has met, up to a bound."""

    def __init__(self, width: int, kept: int = 200_000):
        import xxhash

        self.width, self.kept, self.seen, self.hash = width, kept, {}, xxhash.xxh64_intdigest

    def __call__(self, text: bytes | None) -> np.ndarray:
        tokens = text.translate(LOWER_AZ).split() if text else []
        if not tokens:
            return np.empty(0, U)
        seen = self.seen
        if len(seen) > self.kept:
            seen.clear()
        for t in set(tokens).difference(seen):
            seen[t] = self.hash(t)
        h = np.fromiter(map(seen.__getitem__, tokens), U, len(tokens))
        width = min(self.width, len(h))
        s = np.full(len(h) - width + 1, width, U)  # a short text's only shingle differs from any longer one
        for i in range(width):
            s = s * U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
            s ^= s >> U(29)
        s *= U(0xBF58476D1CE4E5B9)
        s ^= s >> U(32)
        return np.unique(s)


def _signer(width: int, chunks: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        k = chunks * CHUNK
        mul, add = rng.integers(1, 2**63, k, dtype=U) * U(2) + U(1), rng.integers(1, 2**63, k, dtype=U)
        shingles = Shingles(width)
        for batch in batches:
            n, h1, h2, keys, ends = [], [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text)
                n.append(len(s))
                h1.append(s.sum(dtype=U))
                h2.append(((s >> U(7)) * U(0x94D049BB133111EB) ^ s).sum(dtype=U))
                if len(s):
                    low = np.empty(k, U)
                    for j in range(k):
                        low[j] = ((s ^ add[j]) * mul[j]).min()
                    low = (low * U(0x9E3779B97F4A7C15)) >> U(48)  # b = 16 bits
                    c = low.reshape(chunks, CHUNK)
                    for leave in range(CHUNK):
                        key = np.arange(chunks, dtype=U) * U(CHUNK) + U(leave + 1)
                        for j in range(CHUNK):
                            if j != leave:
                                key = key * U(0x9E3779B97F4A7C15) ^ c[:, j]
                                key ^= key >> U(31)
                        keys.append(key)
                ends.append(ends[-1] + (k if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, U)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, U).view(np.int64)), pa.array(np.array(h2, U).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))],
                ["doc_id", "n_shingles", "h1", "h2", "keys"],
            )

    return sign


def signatures(docs: DataFrame, width: int, chunks: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, keys): set size, 128-bit digest of the set, and the multi-index keys."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signer(width, chunks), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def _forest(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links among the sets, as a spanning forest: as many as connect what the links connect."""
    m = len(ids)
    n = np.array([len(s) for s in sets])
    if m < 2:
        return []
    if m <= 16:
        group, out = list(range(m)), []
        for j in range(1, m):
            for i in range(j):
                if group[i] != group[j] and den * min(n[i], n[j]) >= num * max(n[i], n[j]):
                    a, b = (sets[i], sets[j]) if n[i] <= n[j] else (sets[j], sets[i])
                    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    if den * both >= num * (n[i] + n[j] - both):
                        out.append((ids[i], ids[j]))
                        old, new = group[j], group[i]
                        group = [new if g == old else g for g in group]
        return out
    owner = np.repeat(np.arange(m), n)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[col]
    owner, col = owner[use], place[col[use]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both, step, width = np.zeros((m, m), np.float32), 8192, int(shared.sum())
    for at in range(0, width, step):
        lo, hi = np.searchsorted(col, [at, at + step])
        part = np.zeros((m, min(step, width - at)), np.float32)
        part[owner[lo:hi], col[lo:hi] - at] = 1
        both += part @ part.T
    linked = den * both.astype(np.int64) >= num * (n[:, None] + n[None, :] - both.astype(np.int64))
    left, out = np.ones(m, bool), []
    for start in range(m):
        if left[start]:
            left[start], todo = False, [start]
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(linked[i] & left):
                    left[j] = False
                    out.append((ids[i], ids[j]))
                    todo.append(j)
    return out


def _linker(width: int, num: int, den: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, now, ids, sets = Shingles(width), None, [], []

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

        for batch in batches:
            found = []
            for cell, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if cell != now:
                    found += _forest(ids, sets, num, den)
                    now, ids, sets = cell, [], []
                ids.append(i)
                sets.append(shingles(text))
            yield out(found)
        yield out(_forest(ids, sets, num, den))

    return link


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, chunks: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Texts link if den * |intersection| >= num * |union| of their sets of distinct `width`-word shingles (A-Z lower-cased,
    words between white space; a shorter text is one shingle). Null, empty and blank texts have an empty set and link
    with nothing. Equal sets are collapsed first, so a large group of copies is one entry. doc_id has to name one text: rows that
    repeat it with the same text are one document (deduplicate() takes tables in which it doesn't). A null doc_id links with nothing and has a null component_id. Other columns are ignored. An empty table
    gives an empty result.

    Small groups of documents that share a key are a cell each, in which every pair is compared, and equal groups under several
    keys are compared once. Groups too large for a cell are merged where they share documents, so that a document stands in one
    of them, and are compared by _hot_links().
    """
    chunks = chunks or chunks_for(num / den)
    signed = stage(signatures(docs, width, chunks), "signatures")
    sets = ["n_shingles", "h1", "h2"]
    reps = stage(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    keyed = reps.select("rep", "n_shingles", F.explode("keys").alias("key"))
    groups = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("c"), F.sum("n_shingles").alias("all"), F.bit_xor(F.xxhash64("rep")).alias("g1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("g2"))
        .where("c > 1")
        .groupBy("c", "all", "g1", "g2")
        .agg(F.min("key").alias("key"))
        .select("key", (_slots(F.col("c"), F.col("all")) > 1).alias("hot"))
    )
    members = stage(keyed.join(small(stage(groups, "groups")), "key").select("key", "rep", "n_shingles", "hot"), "members")
    cells = members.where("not hot").select(F.xxhash64("key", F.lit(0)).alias("cell"), F.col("rep").alias("doc_id"))

    def links(cells: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(stage(cells, "cells")), "doc_id").select("cell", "doc_id", "text")
        return texts.repartition("cell").sortWithinPartitions("cell", "doc_id").mapInArrow(_linker(width, num, den), "u long, v long")

    merged = stage(_merged(members.where("hot")), "merged")
    if merged.isEmpty():
        found = components(links(cells))
    else:
        found = _hot_links(merged, cells, links)
    classes = reps.select(*sets, "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*sets, F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", *sets).join(classes, sets, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _slots(docs: Column, shingles: Column) -> Column:
    """Cells' worth of so many documents and shingles."""
    return F.greatest(F.ceil(docs / CELL_DOCS), F.ceil(shingles / CELL_SHINGLES)).cast("long")


def _merged(members: DataFrame) -> DataFrame:
    """(rep, g, n_shingles): the members of large groups, once each; groups with a member in common are one, g."""
    each = stage(members.groupBy("rep").agg(F.first("n_shingles").alias("n_shingles"), F.collect_set("key").alias("keys")), "hot")  # a set's keys: 4 a chunk at most
    same = components(each.select(F.explode("keys").alias("u"), F.array_min("keys").alias("v")))
    return each.select("rep", "n_shingles", F.array_min("keys").alias("id")).join(small(stage(same, "same")), "id", "left").select("rep", F.coalesce("component", "id").alias("g"), "n_shingles")


def _hot_links(merged: DataFrame, cells: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components over all links, in two rounds.

    First a large group is dealt into slots, each a cell together with the group's smallest document: as many rows as members. This joins
    nearly all copies of one text. Then only pairs whose components differ are left: the members outside the group's largest
    component are dealt into slots of their own and meet one another and the slots of that component, so the rows of this round are
    those members times their slots and the largest component's, plus that component times their slots. A pair within the largest component is linked already, so no link that
    matters is lost.
    """
    sizes = merged.groupBy("g").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("all"), F.min("rep").alias("pivot"))
    sizes = small(stage(sizes.select("g", "pivot", _slots(F.col("c"), F.col("all")).alias("b")), "sizes"))
    slot = lambda n: F.pmod(F.xxhash64("rep", "g"), n)
    dealt = merged.join(sizes, "g").select("g", slot(F.col("b")).alias("slot"), F.col("rep").alias("doc_id"))
    pivots = sizes.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("slot"), F.col("pivot").alias("doc_id"))
    first = dealt.unionByName(pivots).distinct().select(F.xxhash64("g", F.lit(1), "slot").alias("cell"), "doc_id")
    found = stage(components(links(cells.unionByName(first))), "linked")
    named = merged.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("g", "rep", "n_shingles", F.coalesce("component", "rep").alias("of"))
    named = stage(named, "named")
    by_component = named.groupBy("g", "of").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("all"))
    top = by_component.groupBy("g").agg(F.sum("c").alias("n"), F.sum("all").alias("n_all"), F.max(F.struct("c", "all", "of")).alias("top"))
    top = top.where("n > top.c").select("g", F.col("top.of").alias("largest"), _slots(F.col("n") - F.col("top.c"), F.col("n_all") - F.col("top.all")).alias("p"), _slots(F.col("top.c"), F.col("top.all")).alias("q"))
    left = named.join(small(stage(top, "open")), "g").select("g", "rep", "p", "q", (F.col("of") == F.col("largest")).alias("inside"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.when(F.col("inside"), slot(F.col("q"))).otherwise(slot(F.col("p")))
    cross = F.when(F.col("inside"), F.transform(upto(F.col("p")), lambda i: F.xxhash64("g", F.lit(2), i, own))).otherwise(F.transform(upto(F.col("q")), lambda j: F.xxhash64("g", F.lit(2), own, j)))
    among = F.filter(upto(F.col("p")), lambda i: ~F.col("inside") & (i != own))
    among = F.transform(among, lambda i: F.xxhash64("g", F.lit(3), F.least(i, own), F.greatest(i, own)))
    second = stage(left.select(F.explode(F.concat(cross, among)).alias("cell"), F.col("rep").alias("doc_id")), "open-cells")
    if second.isEmpty():
        return found
    return components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(links(second)))


def deduplicate(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id. Columns as given.

    Rows are told apart by themselves, not by doc_id: of rows that share a doc_id only those with near-duplicate texts, or with
    one text, are duplicates. Rows with a null doc_id stay.
    """
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        found = near_duplicates(docs, width, num, den)
        dropped = small(stage(found.where("not kept").select(F.col("doc_id").alias("id")), "dropped"))
        rows = packed(docs, id=F.col("doc_id").cast("long"))
        return unpacked(rows.join(dropped, "id", "left_anti"))
    rows = stage(packed(docs, id=F.col("doc_id"), text=F.col("text")).withColumn("at", F.monotonically_increasing_id()), "rows")
    named = F.when(F.col("id").isNotNull(), F.col("at"))
    found = near_duplicates(rows.select(named.alias("doc_id"), "text"), width, num, den).where("doc_id is not null")
    found = found.select(F.col("doc_id").alias("at"), F.col("component_id").alias("of"), "n_shingles").join(rows.select("at", "id"), "at")
    linked = stage(found, "near")
    best = linked.where("n_shingles > 0").groupBy("of").agg(F.min_by("at", F.struct("id", "at")).alias("best"), F.count("*").alias("n")).where("n > 1")
    dropped = linked.join(best, "of").where("at <> best").select("at")
    # texts without words link with nothing: they are one row only where doc_id and text are equal
    bare = rows.select("at", "text").join(linked.where("n_shingles = 0").select("at", "id"), "at")
    first = bare.groupBy("id", "text").agg(F.min("at").alias("at"))
    dropped = dropped.unionByName(bare.select("at").join(first, "at", "left_anti"))
    dropped = small(stage(dropped, "dropped"))
    return unpacked(rows.join(dropped, "at", "left_anti"))
