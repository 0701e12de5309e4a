"""Exact top-k search by tiled matrix products.

Vectors are packed into tiles, a few thousand in one row. The query vectors are packed into tiles of their own, which every shard
of candidate tiles gets; a task multiplies the two matrices, selects the best of each query within the tile, and keeps one list
for each query and shard. The lists of a query are then merged as a tree, FAN of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Vectors and bytes of a tile at most; queries of a query tile; candidate tiles of a shard, about; lists that one step merges.
TILE, TILE_BYTES, QUERY_TILE, SHARD_TILES, FAN = 4096, 8 << 20, 1024, 4, 16
LONG = 2**63 - 1

PACKED = "n int, dim int, item int, norm double, ids binary, vectors binary"
QUERIES = "qtile long, homes binary, places binary, " + PACKED


def _narrowed(v: np.ndarray) -> np.ndarray:
    """v in the smallest integers that hold it."""
    most = max(int(v.max()), -int(v.min())) if v.size else 0
    return v.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _tile(ids: np.ndarray, v: np.ndarray) -> list:
    """The columns of PACKED."""
    low = _narrowed(v)
    norm = float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max())) if v.size else 0.0
    return [len(ids), v.shape[1], low.dtype.itemsize, norm, ids.astype(np.int64).tobytes(), low.tobytes()]


def _matrix(n: int, dim: int, item: int, vectors: bytes) -> np.ndarray:
    return np.frombuffer(vectors, {2: np.int16, 4: np.int32, 8: np.int64}[item]).reshape(n, dim)


def products(q: np.ndarray, c: np.ndarray, reach: float) -> np.ndarray:
    """Inner products of the rows of q and c, exact. No sum of any of their terms exceeds reach, by the norms (Cauchy-Schwarz), which picks the arithmetic."""
    if q.shape[1] != c.shape[1]:  # a shorter vector counts as ending in zeros
        width = max(q.shape[1], c.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    for bound, kind in ((2**24, np.float32), (2**53, np.float64)):
        if reach * 1.01 < bound:
            return q.astype(kind) @ c.astype(kind).T
    if reach * 1.01 < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return np.clip(q.astype(object) @ c.astype(object).T, -LONG, LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, id) of the k highest allowed scores of each row, ties to the smaller id, by row and then rank.

    ids are of the columns, or a matrix like scores."""
    n = scores.shape[1]
    if n > k:
        least = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
        seen = np.where(allowed, scores, least)
        allowed = allowed & (seen >= np.partition(seen, n - k, axis=1)[:, n - k, None])
    row, col = np.nonzero(allowed)
    score = scores[row, col].astype(np.int64)
    of = ids[row, col] if ids.ndim == 2 else ids[col]
    by = np.lexsort((of, -score, row))
    row, score, of = row[by], score[by], of[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], score[rank < k], of[rank < k]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, is_query, vector) to tiles: tile, queries (the places of the query rows), and PACKED."""
    serial, held, bytes_ = TaskContext.get().partitionId() << 32, [], 0

    def tile() -> pa.RecordBatch:
        nonlocal serial
        ids = np.array([h[0] for h in held], np.int64)
        v = np.zeros((len(held), max(len(h[2]) for h in held)), np.int64)
        for i, h in enumerate(held):
            v[i, : len(h[2])] = h[2]
        queries = np.flatnonzero([h[1] for h in held]).astype(np.int32)
        row = [serial, len(queries), queries.tobytes(), *_tile(ids, v)]
        serial += 1
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TILE_TYPES, strict=True)], TILE_NAMES)

    for batch in batches:
        for i, is_query, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if not x.is_valid or x.values.null_count:
                continue
            x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            x = np.floor(1024 * x)
            held.append((i, is_query, np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64) + np.where(x >= 2.0**63, LONG, 0) - np.where(x <= -(2.0**63), LONG, 0)))
            bytes_ += 8 * len(x)
            if len(held) == TILE or bytes_ >= TILE_BYTES:
                yield tile()
                bytes_ = 0
    if held:
        yield tile()


TILE_NAMES = ["tile", "n_queries", "queries", "n", "dim", "item", "norm", "ids", "vectors"]
TILE_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
TILES = "tile long, n_queries long, queries binary, " + PACKED


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query vectors of tiles, one in a row."""
    for batch in batches:
        for t in batch.to_pylist():
            at, ids, v = np.frombuffer(t["queries"], np.int32), np.frombuffer(t["ids"], np.int64), _matrix(t["n"], t["dim"], t["item"], t["vectors"])
            arrays = [pa.array(np.full(len(at), t["tile"])), pa.array(at), pa.array(ids[at]), pa.array([v[i].astype(np.int64).tobytes() for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["home", "place", "id", "vector"])


def _query_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial, held = TaskContext.get().partitionId() << 32, []

    def tile() -> pa.RecordBatch:
        nonlocal serial
        homes, places, ids = (np.array([h[j] for h in held], np.int64) for j in range(3))
        v = [np.frombuffer(h[3], np.int64) for h in held]
        m = np.zeros((len(v), max(map(len, v))), np.int64)
        for i, x in enumerate(v):
            m[i, : len(x)] = x
        row = [serial, homes.tobytes(), places.tobytes(), *_tile(ids, m)]
        serial += 1
        held.clear()
        types = [pa.int64(), pa.binary(), pa.binary(), *TILE_TYPES[3:]]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["qtile", "homes", "places", *TILE_NAMES[3:]])

    for batch in batches:
        for row in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
            held.append(row)
            if len(held) == QUERY_TILE:
                yield tile()
    if held:
        yield tile()


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = query = lists = None

        def out() -> pa.RecordBatch:
            row, score, of = lists
            homes, places, ids, _ = query
            ends = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
            top = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(-score), pa.array(of)], ["cost", "vec_id"]))
            return pa.RecordBatch.from_arrays([pa.array(homes), pa.array(places), pa.array(ids), pa.array(np.full(len(ids), now[0])), top], ["home", "place", "query_id", "shard", "top"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["shard"], r["qtile"]) != now:
                    if lists is not None:
                        yield out()
                    now, lists = (r["shard"], r["qtile"]), None
                    homes, places, ids = (np.frombuffer(r[c], np.int64) for c in ("homes", "places", "q_ids"))
                    query = homes, places, ids, _matrix(r["q_n"], r["q_dim"], r["q_item"], r["q_vectors"])
                homes, places, _, q = query
                scores = products(q, _matrix(r["n"], r["dim"], r["item"], r["vectors"]), r["norm"] * r["q_norm"])
                allowed = np.ones(scores.shape, bool)
                own = np.flatnonzero(homes == r["tile"])
                allowed[own, places[own]] = False
                found = best(scores, np.frombuffer(r["ids"], np.int64), allowed, k)
                if lists is not None:
                    row, score, of = (np.concatenate(p) for p in zip(lists, found, strict=True))
                    by = np.lexsort((of, -score, row))
                    row, score, of = row[by], score[by], of[by]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    found = row[rank < k], score[rank < k], of[rank < k]
                lists = found
        if lists is not None:
            yield out()

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id long, rank int from 1, vec_id long, score long): for every row where is_query holds, the k rows with the highest inner products.

    Components count as floor(1024 * x). All rows but the query's own are candidates; ties go to the smaller vec_id; fewer than
    k candidates are all returned. Vectors that are null or hold null or non-finite components, and rows without a vec_id, take no part; an empty vector is all
    zeros, and so is what a shorter one lacks. Rows that share a vec_id are queries and candidates each. Components and scores
    beyond a long are cut to the largest one. Other columns are ignored. An empty table gives an empty result.

    A joined row is one tile of TILE candidates and one of QUERY_TILE queries, so rows grow with their numbers divided by both; a query's
    lists, one for each shard of about SHARD_TILES tiles, are merged FAN at a time.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    tiles = stage(rows.mapInArrow(_pack, TILES), "tiles")
    n_tiles, n_queries = tiles.agg(F.count("*"), F.coalesce(F.sum("n_queries"), F.lit(0))).first()
    shards = max(1, -(-n_tiles // SHARD_TILES))
    queries = tiles.where("n_queries > 0").mapInArrow(_query_rows, "home long, place int, id long, vector binary").repartition(max(1, -(-n_queries // QUERY_TILE)))
    queries = stage(queries.mapInArrow(_query_tiles, QUERIES), "queries")
    queries = queries.select("qtile", "homes", "places", *(F.col(c).alias(f"q_{c}") for c in ("n", "dim", "item", "norm", "ids", "vectors")), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    tiles = tiles.drop("n_queries", "queries").withColumn("shard", F.pmod(F.xxhash64("tile"), F.lit(shards)).cast("int"))
    spark_columns = "home long, place long, query_id long, shard long, top array<struct<cost:long,vec_id:long>>"
    pairs = tiles.hint("shuffle_merge").join(queries, "shard").sortWithinPartitions("shard", "qtile")
    lists = pairs.mapInArrow(_searcher(k), spark_columns)
    while True:
        lists = lists.groupBy("home", "place", "query_id", F.floor(F.col("shard") / FAN).alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        shards = -(-shards // FAN)
        if shards <= 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.cost")).alias("score"))
