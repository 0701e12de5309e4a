"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, small, stage, unpacked, whole_row, words

#: No target exceeds this many times its source's size.
MOST = 3

#: From (source, source_size): weights by the order of the sources, then targets. The sources that stop at MOST times their size
#: come first in the order of size / weight; the rest share what is left by weight. What is left per weight rises while sources
#: stop and falls after, so the level is its maximum. All sums are whole numbers.
TARGETS = """
WITH ranked AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} AS INT) AS i FROM {sizes}),
weighed AS (
  SELECT source, CAST(source_size AS DECIMAL(38,0)) AS s, CAST(CASE i {cases} END AS DECIMAL(38,0)) AS w FROM ranked),
summed AS (
  SELECT source, s, w, SUM(s) OVER () AS total,
    SUM(s) OVER () - {most} * (SUM(s) OVER (ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING) - s) AS left_words,
    SUM(w) OVER () - (SUM(w) OVER (ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING) - w) AS left_weight
  FROM weighed),
level AS (
  SELECT MAX(CAST(left_words AS DOUBLE) / CAST(left_weight AS DOUBLE)) AS level FROM summed)
SELECT source AS mix_source, CAST(s AS BIGINT) AS source_size,
  LEAST(COALESCE(level, 0.0) * CAST(w AS DOUBLE), CAST({most} * s AS DOUBLE)) AS target FROM summed CROSS JOIN level
"""


def targets_sql(weights: tuple[int, ...] = (1, 2, 3), sizes: str = "{sizes}") -> str:
    return TARGETS.format(sizes=sizes, n=len(weights), most=MOST, cases=" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (row, doc_id, text, ...) with key: what tells a row from all others that can be told apart, and the number among its equals.

    Rows whose doc_id and text occur once have these as key. Of all others equal rows are counted and made anew from the count, so many copies of
    one row are no hot task, and a task that runs again numbers them alike."""
    text = F.coalesce(F.concat(F.lit("t"), F.md5(F.col("text").cast("binary"))), F.lit(""))
    rows = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id"), F.lit("null")), text))
    again = stage(rows.groupBy("key").count().where("count > 1").select("key"), "again")
    if again.isEmpty():
        return rows
    again = small(again, F.length("key"))
    whole = whole_row(rows)
    equal = rows.join(again, "key", "left_semi").groupBy("key", F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole).alias("g"))
    copies = equal.agg(F.first(F.struct(*(c for c in rows.columns if c != "key"))).alias("r"), F.count("*").alias("n"))
    copies = copies.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    key = F.concat_ws(":", *(F.col(c).cast("string") for c in ("key", "h", "g", "k")))
    repeated = copies.select(*(F.col(f"r.{c}") if c != "key" else key.alias("key") for c in rows.columns))
    return rows.join(again, "key", "left_anti").select(*rows.columns).unionByName(repeated)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 5, by_row: bool = False) -> DataFrame:
    """docs with size (words; null text: 0), source_size, target (its source's) and copies (int, 0 to 3).

    A document's rate is target / source_size. It gets floor(rate) copies and one more if a draw that its doc_id and the
    seed decide (52 bits of an MD5) is below the fraction, so reruns agree. Rows that share a doc_id share the draw; a null
    doc_id draws as an empty one. With by_row doc_id, text and a number among equal rows decide, so every row has a draw of
    its own, also where doc_id is null or repeated. A source without words has target and copies 0. Null is a source of its own, the last.
    Columns with the names of the results, in whatever case, are replaced. An empty table gives an empty result.

    Only (source, words) are aggregated, with partial sums, so a hot source is no hot task. The ranking of sources runs over
    one row per source. The join back is broadcast when the sources are counted to be few, else shuffled.
    """
    return unpacked(_mixed(docs, weights, seed, by_row), *MADE)


def emit(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 5, by_row: bool = True) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies; columns as given."""
    mixed = _mixed(docs, weights, seed, by_row).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return unpacked(mixed)


MADE = ("size", "source_size", "target", "copies")


def _mixed(docs: DataFrame, weights: tuple[int, ...], seed: int, by_row: bool) -> DataFrame:
    size = F.size(words(F.col("text"))).cast("long")
    sizes = docs.select(F.col("source").alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(docs.sparkSession.sql(targets_sql(weights), sizes=sizes), "targets")
    targets = small(targets, F.coalesce(F.octet_length("mix_source"), F.lit(0)))
    more = {"doc_id": F.col("doc_id").cast("string"), "source": F.col("source"), "size": size}
    rows = packed(docs, **more, **({"text": F.col("text")} if by_row else {}))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if by_row:
        rows = _numbered(rows)
    key = F.col("key") if by_row else F.coalesce(F.col("doc_id"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
    return rows.withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int"))
