"""Canonical market rows: schema, readers, checks, merging, writers."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MINUTE_MS
from ..operators.pieces import piece_span

ROW_SCHEMA = """symbol string, minute_ts long, open double, high double, low double, close double, volume double, turnover double,
 oi_total_usd double, has_oi boolean, funding_rate double, has_funding boolean, liq_long_usd double, liq_short_usd double,
 has_liquidations boolean, taker_buy_volume_usd double, taker_sell_volume_usd double, has_taker_flow boolean"""
PRICES = ["open", "high", "low", "close", "volume", "turnover"]
#: Kinds in their fixed order, with flag and value columns.
KINDS = {"open_interest": ("has_oi", ["oi_total_usd"]), "liquidations": ("has_liquidations", ["liq_long_usd", "liq_short_usd"]), "funding": ("has_funding", ["funding_rate"]), "taker": ("has_taker_flow", ["taker_buy_volume_usd", "taker_sell_volume_usd"])}
#: Columns that belong to results; a source of raw rows may not carry them.
RESULT_COLUMNS = {"trades", "fills", "pnl", "realized_pnl", "equity", "orders", "decisions", "positions", "metrics", "signals"}


def in_range(rows: DataFrame, ts_from: int | None = None, ts_to: int | None = None, symbols: list[str] | DataFrame | None = None) -> DataFrame:
    """Half-open [ts_from, ts_to) and a set of symbols (a list, or a table with a `symbol` column)."""
    if ts_from is not None:
        rows = rows.where(F.col("minute_ts") >= ts_from)
    if ts_to is not None:
        rows = rows.where(F.col("minute_ts") < ts_to)
    if isinstance(symbols, DataFrame):
        return rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))


def read_rows(spark: SparkSession, path: str, ts_from: int | None = None, ts_to: int | None = None, symbols: list[str] | DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """Rows of a Parquet or JSON source; the range and symbols reach the scan as filters."""
    return in_range(spark.read.schema(ROW_SCHEMA).format(fmt).load(path), ts_from, ts_to, symbols)


def read_one_symbol(spark: SparkSession, path: str, symbol: str, ts_from: int | None = None, ts_to: int | None = None) -> DataFrame:
    return read_rows(spark, path, ts_from, ts_to, [symbol])


def union_versions(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Rows without and with taker flow as one table; without it the values are NULL and the flag false."""
    return v1.unionByName(v2, allowMissingColumns=True).withColumn("has_taker_flow", F.coalesce("has_taker_flow", F.lit(False)))


def violations(columns: list[str]) -> Column:
    """The reasons why a row is not a canonical one, as a sorted array."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    tests = [(F.pmod("minute_ts", F.lit(MINUTE_MS)) != 0, "minute_not_aligned"), (F.col("symbol") != F.upper(F.trim("symbol")), "symbol_form"), (F.col("symbol").isNull() | F.col("minute_ts").isNull(), "key_missing")]
    tests += [(F.col(c).isNull(), f"{c}_missing") for c in PRICES if c in columns]
    tests += [(bad(c), f"{c}_not_finite") for c in PRICES + [v for _, vs in KINDS.values() for v in vs] if c in columns]
    tests += [(F.col(flag) != F.col(v).isNotNull(), f"{v}_against_flag") for flag, vs in KINDS.values() if flag in columns for v in vs]
    return F.array_sort(F.array_compact(F.array(*(F.when(t, reason) for t, reason in tests))))


def validate_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with `reasons`). A source that carries result columns raises."""
    if carried := RESULT_COLUMNS & {c.lower() for c in rows.columns}:
        raise ValueError(f"raw rows carry results: {sorted(carried)}")
    checked = rows.withColumn("reasons", violations(rows.columns))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest `order` for each key."""
    at = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(at)).where("_rn = 1").drop("_rn")


def dedup_minutes(rows: DataFrame, arrival: str = "seq") -> DataFrame:
    """The snapshot that arrived last for each minute of a symbol."""
    return latest(rows.withColumn("minute_ts", F.col("minute_ts") - F.pmod("minute_ts", F.lit(MINUTE_MS))), ["symbol", "minute_ts"], arrival)


def merge_kinds(bars: DataFrame, funding: DataFrame, oi: DataFrame) -> DataFrame:
    """bars with turnover = close * volume and the funding and open interest of the very same minute; of repeated minutes the last value (by seq) counts."""
    keys = ["symbol", "minute_ts"]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    f, o = funding.groupBy(*keys).agg(last("funding_rate")), oi.groupBy(*keys).agg(last("oi_total_usd"))
    out = bars.join(f, keys, "left").join(o, keys, "left")
    return out.select("*", (F.col("close") * F.col("volume")).alias("turnover"), F.col("funding_rate").isNotNull().alias("has_funding"), F.col("oi_total_usd").isNotNull().alias("has_oi"))


def list_datasets(rows: DataFrame, step_ms: int = MINUTE_MS) -> DataFrame:
    """(dataset, symbols, ts_from, ts_to, row_count); a dataset's symbols, thousands at most, are one array."""
    return rows.groupBy("dataset").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"), F.min("minute_ts").alias("ts_from"), (F.max("minute_ts") + step_ms).alias("ts_to"), F.count("*").alias("row_count")).where("row_count > 0")


def check_timeframe(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """requests with `accepted`: the timeframe asked for is that which the dataset declares."""
    declared = datasets.select("dataset", F.col("timeframe").alias("declared"))
    return requests.join(declared, "dataset", "left").withColumn("accepted", F.coalesce(F.col("timeframe") == F.col("declared"), F.lit(False)))


def present_minutes(rows: DataFrame, primary: str) -> DataFrame:
    """By dataset: minutes of the window, of the primary symbol, and common to all symbols."""
    n = rows.groupBy("dataset").agg(F.count_distinct("symbol").alias("n_symbols"), F.min("minute_ts").alias("a"), F.max("minute_ts").alias("b"))
    at = rows.groupBy("dataset", "minute_ts").agg(F.count_distinct("symbol").alias("n"), F.max((F.col("symbol") == primary).cast("int")).alias("p"))
    return at.join(n, "dataset").groupBy("dataset").agg(F.first((F.col("b") - F.col("a")) / MINUTE_MS + 1).cast("long").alias("window_minutes"), F.sum("p").cast("long").alias("primary_minutes"), F.count_if(F.col("n") == F.col("n_symbols")).alias("common_minutes"))


def dataset_fingerprint(rows: DataFrame) -> DataFrame:
    """(dataset, fingerprint): rows are hashed, then days of a symbol, symbols, datasets, as a tree without a global sort."""
    values = [c for c in rows.columns if c not in ("dataset", "symbol", "minute_ts")]
    row = F.sha2(F.to_json(F.struct("minute_ts", *values), {"ignoreNullFields": "false"}), 256)
    over = lambda key, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, h))), lambda s: s[h]), ","), 256)
    days = rows.select("dataset", "symbol", "minute_ts", F.floor(F.col("minute_ts") / 86_400_000).alias("day"), row.alias("h")).groupBy("dataset", "symbol", "day").agg(over("minute_ts", "h").alias("h"))
    symbols = days.groupBy("dataset", "symbol").agg(over("day", "h").alias("h"))
    return symbols.groupBy("dataset").agg(over("symbol", "h").alias("fingerprint"))


def write_runs(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Results keyed by run_id, in folders by a bucket of it so that many runs don't make many folders."""
    df.withColumn("run_bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets))).repartition("run_bucket").sortWithinPartitions("run_id").write.mode("append").partitionBy("run_bucket").parquet(path)


def write_bars(bars: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """bars as a table in buckets of (dataset, symbol), each one file in the order of time, so that windows and joins by symbol read it without
    an exchange; the table, read back."""
    keys = ["dataset", "symbol"]
    dealt = bars.repartition(buckets, *keys).sortWithinPartitions(*keys, "minute_ts")
    dealt.write.mode("errorifexists").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, "minute_ts").saveAsTable(name)
    return bars.sparkSession.table(name)


def ledger_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def record_in_ledger(path: str, new: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """Adds the rows of new (with created_at and run_id) whose key the ledger at path lacks, the first of each key, and returns the ledger.

    The ledger lies in folders by a bucket of the key. Only buckets that new has keys of are read, and what is added are further files
    there: no file is written again, and those of other buckets are not touched. One writer at a time.
    """
    spark = new.sparkSession
    new = new.withColumn("ledger_bucket", ledger_bucket(keys, buckets))
    first = new.groupBy(*keys, "ledger_bucket").agg(F.min_by(F.struct(*new.columns), F.struct("created_at", "run_id")).alias("r")).select("r.*")
    schema = new.schema
    try:
        old = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        touched = [r[0] for r in new.select("ledger_bucket").distinct().collect()]  # `buckets` numbers at most
        known = old.where(F.col("ledger_bucket").isin(touched)).select(*keys)
        same = reduce(lambda a, b: a & b, [first[k].eqNullSafe(known[k]) for k in keys])
        first = first.join(known, same, "left_anti")
    first.repartition("ledger_bucket").write.mode("append").partitionBy("ledger_bucket").parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def sort_rows(rows: DataFrame) -> DataFrame:
    return rows.orderBy("symbol", "minute_ts")


def page(rows: DataFrame, offset: int, limit: int, piece_rows: int = 10_000) -> DataFrame:
    """Rows offset to offset + limit in the order of (symbol, minute_ts), neither NULL.

    Rows are counted by (symbol, stretch of time); only those from the first stretch that holds a row of the page to the last are then sorted, so what is
    skipped is never held. The bounds, two rows, come to the driver and are filters of the scan.
    """
    if limit <= 0:
        return rows.limit(0)
    span = piece_span(rows, ["symbol"], "minute_ts", piece_rows)
    counts = rows.groupBy("symbol", F.floor(F.col("minute_ts") / span).alias("piece")).count()
    symbols = counts.groupBy("symbol").agg(F.sum("count").alias("n"))
    before = symbols.select("symbol", (F.sum("n").over(Window.orderBy("symbol")) - F.col("n")).alias("before"))  # a row for each symbol
    within = F.sum("count").over(Window.partitionBy("symbol").orderBy("piece")) - F.col("count")
    at = counts.join(before, "symbol").select("symbol", "piece", "count", (F.col("before") + within).alias("start"))
    held = at.where((F.col("start") < offset + limit) & (F.col("start") + F.col("count") > offset))
    bounds = held.agg(F.min(F.struct("symbol", "piece", "start")).alias("a"), F.max(F.struct("symbol", "piece")).alias("z")).first()
    if bounds.a is None:
        return rows.limit(0)
    symbol, ts = F.col("symbol"), F.col("minute_ts")
    after = (symbol > bounds.a.symbol) | (symbol == bounds.a.symbol) & (ts >= bounds.a.piece * span)
    upto = (symbol < bounds.z.symbol) | (symbol == bounds.z.symbol) & (ts < (bounds.z.piece + 1) * span)
    near = rows.where((symbol >= bounds.a.symbol) & (symbol <= bounds.z.symbol) & after & upto)
    return sort_rows(near).offset(offset - bounds.a.start).limit(limit)
