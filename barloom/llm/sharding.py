"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash. Pass two puts each bucket into a fixed
order, applies Spark's shuffle(array, seed), which is a Fisher-Yates shuffle, and numbers the rows through: bucket after
bucket. Row p goes to slot p / shards of shard p % shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, small, stage, unpacked, whole_row


def _by_hash(a: Column, b: Column) -> Column:
    later = F.when(a.g < b.g, -1).when(a.g > b.g, 1).otherwise(0)
    return F.when(a.h < b.h, -1).when(a.h > b.h, 1).otherwise(later)


#: What a task holds as one array: a bucket has so many bytes at least and at most; between, BUCKETS of them hold the table.
LEAST_BYTES, MOST_BYTES, BUCKETS = 8 << 20, 256 << 20, 20_000
#: A row that occurs more often than this is counted, and its copies are dealt over the buckets.
COPIES = 1000
#: Buckets whose offsets one task sums up.
BLOCK = 4096


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 11, bucket_bytes: int | None = None) -> DataFrame:
    """docs with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard); law `rows`: shard sizes differ by one at most.

    Every row is kept: null and empty texts, repeated rows, null ids. Up to COPIES equal rows share a bucket; more are numbered and dealt over all.
    Columns named shard or slot, in whatever case, are replaced; any others stay as they are. An empty table gives an empty result.
    A bucket is a task of its own and bounds what that holds as one array, but for single rows beyond it. Rows (all their columns) and
    seed alone decide the order: a bucket is shuffled by the seed plus its number.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / (bucket_bytes or min(MOST_BYTES, max(LEAST_BYTES, total / BUCKETS)))))
    rows = packed(docs)
    whole = whole_row(docs)
    rows = _dealt(rows.withColumns({"h": F.xxhash64(F.lit(seed), whole), "g": F.xxhash64(F.lit(seed + 1), whole)}))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket").count()
    offsets = stage(offsets_of(counts), "offsets").withColumnRenamed("bucket", "b")
    arrays = (
        rows.repartitionById(buckets, "bucket")  # partition number = bucket, on which the seed of Spark's shuffle() also depends
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("h", "g", "row")), _by_hash).alias("rows"))
        .select("bucket", F.shuffle("rows", seed).alias("rows"))
        .select("bucket", F.posexplode("rows").alias("i", "r"))
    )
    at = F.col("offset") + F.col("i")
    placed = arrays.join(small(offsets), F.col("bucket") == F.col("b"))
    return unpacked(placed.select("r.row", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot")), "shard", "slot")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (row, h, g) with another h for each copy of a row that occurs more than COPIES times. Its copies are counted and made anew from the count,
    so a task that runs again deals them alike."""
    many = stage(rows.groupBy("h", "g").count().where(F.col("count") > COPIES), "copies")
    if many.isEmpty():
        return rows
    many = small(many)
    one = rows.join(many, ["h", "g"]).groupBy("h", "g").agg(F.first("row").alias("row"), F.first("count").alias("n"))
    copies = one.select("row", "g", F.col("h").alias("all"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    copies = copies.select("row", F.xxhash64("all", "k").alias("h"), F.xxhash64("g", "k").alias("g"))
    return rows.join(many, ["h", "g"], "left_anti").select("row", "h", "g").unionByName(copies)


def offsets_of(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, count) -> (bucket, offset): the rows in the buckets before it, summed in blocks of buckets and then over the blocks."""
    counts = stage(counts.select("bucket", F.floor(F.col("bucket") / block).alias("block"), "count"), "counts")
    within = counts.withColumn("offset", F.sum("count").over(Window.partitionBy("block").orderBy("bucket")) - F.col("count"))
    sums = counts.groupBy("block").agg(F.sum("count").alias("count"))
    before = counts.sparkSession.sql("SELECT block, sum(count) OVER (ORDER BY block) - count AS before FROM {sums}", sums=sums)  # a row for each block
    return within.join(before, "block").select("bucket", (F.col("offset") + F.col("before")).alias("offset"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the shards as folders shard=N, each in slot order over as many files as the session's partitions give it."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
