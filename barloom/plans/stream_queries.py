"""Queries of the streaming jobs, over the bars of `events` replayed as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recurrence as rec
from ..streaming import jobs
from ..sources.store import shared_folder
from .bars import BARS, HOUR, bars_events, query, r6, table
from .tape_queries import _RB, _ema

_B = f"WITH {BARS} "


#: Files of the replay; a bar of every fifth hour comes up to LATE with the next file; and the symbol of the last row, which moves the watermark past all bars.
FILES, LATE, END = 4, 12 * HOUR, "~end"


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as a stream of several files that overlap in time, a file for each batch."""
    path = shared_folder(spark, "bars")
    b = bars_events(spark, sf_dir).withColumn("ts", F.timestamp_millis("minute_ts"))
    span = b.agg(F.min("minute_ts").alias("a"), F.max("minute_ts").alias("z")).first()
    if span.a is not None:
        come = F.col("minute_ts") + F.when(F.pmod(F.col("minute_ts"), F.lit(5 * HOUR)) == 0, LATE).otherwise(0)
        part = F.least(F.floor((come - span.a) * FILES / (span.z + 1 - span.a)), F.lit(FILES - 1))
        end = b.limit(1).withColumns({"symbol": F.lit(END), "minute_ts": F.lit(span.z + 10 * 86_400_000), "ts": F.timestamp_millis(F.lit(span.z + 10 * 86_400_000))})
        for i in range(FILES):
            b.where(part == i).coalesce(1).write.mode("append").parquet(path)
        end.write.mode("append").parquet(path)
    else:
        b.write.parquet(path)
    return spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _result(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    path = shared_folder(spark, label)
    jobs.run_available(stream, path)
    return spark.read.schema(stream.schema).parquet(path).where(F.col("symbol") != END)


@query(_B + "SELECT symbol, minute_ts FROM bars")
def x1_stream_minutes(spark, d) -> DataFrame:
    s = _replayed(spark, d)
    return _result(spark, jobs.stream_minutes(s.unionByName(s), "2 days"), "minutes").select("symbol", "minute_ts")


@query(_RB + _ema("y", "b", "close", 20) + " SELECT b.symbol, b.minute_ts, round(y.y, 6) AS ema FROM b LEFT JOIN y USING (symbol, bar_index)")
def x2_stream_indicators(spark, d) -> DataFrame:
    return _result(spark, jobs.stream_recurrences(_replayed(spark, d), [rec.ema("ema", "close", 20)], "1 day"), "ema").select("symbol", "minute_ts", *r6("ema"))


@query(_B + "SELECT symbol, minute_ts, coalesce(lag(close) OVER w > lag(close, 2) OVER w, false) AS signal FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY minute_ts)")
def x3_stream_signals(spark, d) -> DataFrame:
    return _result(spark, jobs.stream_signals(_replayed(spark, d), "1 day"), "signals")


@query(_B + ", k AS (SELECT symbol, minute_ts, unnest(['open_interest', 'liquidations', 'funding', 'taker']) AS kind, unnest([has_oi, has_liquidations, has_funding, has_taker_flow]) AS covered FROM bars), q AS (SELECT minute_ts - minute_ts % 86400000 AS day, symbol, kind, covered FROM k) SELECT day, symbol, kind, count(*) FILTER (covered) AS covered, count(*) AS bars FROM q GROUP BY day, symbol, kind")
def x4_stream_coverage(spark, d) -> DataFrame:
    out = _result(spark, jobs.stream_coverage(_replayed(spark, d), delay="1 day"), "coverage")
    return out.select(F.unix_millis("window.start").alias("day"), "symbol", "kind", "covered", "bars")


@query(f"SELECT o_orderkey AS request_id, CASE WHEN a < b THEN a END AS effective_from, CASE WHEN a < b THEN b END AS effective_to, a < b AND (a <> f OR b <> t) AS clamped, a < b AS admitted FROM (SELECT o_orderkey, f, t, greatest(f, {100 * HOUR}) AS a, least(t, {500 * HOUR}) AS b FROM (SELECT o_orderkey, o_custkey % 700 * {HOUR} AS f, (o_custkey % 700 + o_orderkey % 100) * {HOUR} AS t FROM orders))")
def x5_admit_window(spark, d) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    req = table(spark, d, "orders").select(o.alias("request_id"), F.lit("events:1h").alias("dataset"), (c % 700 * HOUR).alias("ts_from"), ((c % 700 + o % 100) * HOUR).alias("ts_to"))
    closed = spark.range(1).select(F.lit("events:1h").alias("dataset"), F.lit(100 * HOUR).alias("closed_from"), F.lit(500 * HOUR).alias("closed_to"))
    return jobs.admit_window(req, closed).select("request_id", "effective_from", "effective_to", "clamped", "admitted")
