"""The market tape: grid positions, as-of readings, windows, coverage and events over rows of (dataset, symbol, minute_ts).

Windows count rows of a symbol's own grid, never clock minutes, and all share one partitioning, so a plan that combines
several of them shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rows import KINDS
from .pieces import PIECE, cut, running

KEYS = ["dataset", "symbol"]


def grid(low: int | None = None, high: int | None = None):
    """The rows of a symbol in the order of time, or a frame of them; those without a time come last."""
    w = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_last("minute_ts"))
    return w if low is None else w.rowsBetween(low, high)


PAST = Window.unboundedPreceding


def bar_index(df: DataFrame) -> DataFrame:
    return df.withColumn("bar_index", (F.row_number().over(grid()) - 1).cast("long"))


def covered(kind: str) -> Column:
    flag, values = KINDS[kind]
    out = F.coalesce(F.col(flag), F.lit(False))
    for v in values:
        out = out & F.col(v).isNotNull()
    return out


def funding_change_point() -> Column:
    """True on the first covered minute, on a changed rate, and where coverage resumes."""
    on = covered("funding")
    before = F.coalesce(F.lag(on).over(grid()), F.lit(False))
    return on & (~before | ~F.col("funding_rate").eqNullSafe(F.lag("funding_rate").over(grid())))


def funding_change_points(df: DataFrame) -> DataFrame:
    return df.withColumn("_cp", funding_change_point()).where("_cp").drop("_cp")


def funding_as_of(df: DataFrame, cadence_ms: int | None = None, span: int | None = None) -> DataFrame:
    """df with funding_state (present, stale, missing), funding_point_ts and funding_point_rate (NULL when missing).

    A bar after the last covered one is stale for one bar of grace; with a cadence the grace is elapsed time. span: see pieces.running().
    """
    hidden = [] if span is None or PIECE in df.columns else [PIECE]
    df = cut(df, "minute_ts", span).withColumn("_on", covered("funding"))
    df = running(df, {"_was": ("lag", F.col("_on")), "_rate": ("lag", F.col("funding_rate")), "_ts": ("lag", F.col("minute_ts"))}, KEYS, "minute_ts", span)
    grace = F.coalesce("_was", F.lit(False))
    changed = F.col("_on") & (~grace | ~F.col("funding_rate").eqNullSafe(F.col("_rate")))
    point = F.when(changed, F.struct(F.col("minute_ts").alias("ts"), F.col("funding_rate").alias("rate")))
    df = running(df, {"_point": ("last", point)}, KEYS, "minute_ts", span)
    if cadence_ms is not None:
        grace = grace & (F.col("minute_ts") - F.col("_ts") <= cadence_ms)
    df = df.withColumn("funding_state", F.when(F.col("_on"), "present").when(grace, "stale").otherwise("missing"))
    shown = F.col("funding_state") != "missing"
    return df.withColumn("funding_point_ts", F.when(shown, F.col("_point.ts"))).withColumn("funding_point_rate", F.when(shown, F.col("_point.rate"))).drop("_on", "_was", "_rate", "_ts", "_point", *hidden)


def as_of(df: DataFrame, kind: str) -> DataFrame:
    """df with `<kind>_now`: the exact minute's values as a struct, or NULL; a present zero stays."""
    return df.withColumn(f"{kind}_now", F.when(covered(kind), F.struct(*KINDS[kind][1])))


def kind_window(df: DataFrame, kind: str, lookback: int) -> DataFrame:
    """df with `<kind>_window`: the last `lookback` grid bars up to and with this one, NULL values in gaps."""
    slot = F.struct(F.col("minute_ts").alias("ts"), *(F.when(covered(kind), F.col(v)).alias(v) for v in KINDS[kind][1]))
    if lookback <= 0:
        return df.withColumn(f"{kind}_window", F.slice(F.array(slot), 1, 0))
    return df.withColumn(f"{kind}_window", F.collect_list(slot).over(grid(1 - lookback, 0)))


def closed_candles(df: DataFrame, lookback: int) -> DataFrame:
    """df with `closed`: the `lookback` bars strictly before this one."""
    bar = F.struct(F.col("minute_ts").alias("ts"), "open", "high", "low", "close", "volume")
    return df.withColumn("closed", F.collect_list(bar).over(grid(-lookback, -1)))


def kinds_long(df: DataFrame) -> DataFrame:
    """(dataset, symbol, minute_ts, kind, covered), four rows a bar, in one pass."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("kind_rank"), covered(k).alias("covered")) for i, k in enumerate(KINDS)))
    return df.select(*KEYS, "minute_ts", F.explode(each).alias("k")).select(*KEYS, "minute_ts", "k.*")


def coverage(df: DataFrame) -> DataFrame:
    """(dataset, symbol, kind, present, covered_minutes, gap_minutes); a kind that any symbol carries is present for all."""
    per = kinds_long(df).groupBy(*KEYS, "kind", "kind_rank").agg(F.count_if("covered").alias("covered_minutes"), F.count_if(~F.col("covered")).alias("gap_minutes"))
    return per.withColumn("present", F.max(F.col("covered_minutes") > 0).over(Window.partitionBy("dataset", "kind")))


def coverage_gaps(df: DataFrame) -> DataFrame:
    """(dataset, symbol, kind, ts_from, ts_to, minutes): maximal runs of uncovered grid bars, both ends inclusive."""
    w = Window.partitionBy(*KEYS, "kind").orderBy("minute_ts")
    wc = Window.partitionBy(*KEYS, "kind", "covered").orderBy("minute_ts")
    isles = kinds_long(df).withColumn("island", F.row_number().over(w) - F.row_number().over(wc)).where(~F.col("covered"))
    return isles.groupBy(*KEYS, "kind", "island").agg(F.min("minute_ts").alias("ts_from"), F.max("minute_ts").alias("ts_to"), F.count("*").alias("minutes")).drop("island")


def coverage_state_at_end(df: DataFrame) -> DataFrame:
    """(dataset, symbol, kind, state) of funding and taker at the last bar; funding has one bar of grace."""
    w = Window.partitionBy(*KEYS, "kind").orderBy("minute_ts")
    long = kinds_long(df).where(F.col("kind").isin("funding", "taker")).withColumn("before", F.coalesce(F.lag("covered").over(w), F.lit(False)))
    end = long.groupBy(*KEYS, "kind").agg(F.max_by("covered", "minute_ts").alias("now"), F.max_by("before", "minute_ts").alias("before"))
    return end.select(*KEYS, "kind", F.when(F.col("now"), "present").when((F.col("kind") == "funding") & F.col("before"), "stale").otherwise("missing").alias("state"))


def tape_events(df: DataFrame) -> DataFrame:
    """The tape as a long table (dataset, symbol, ts, kind, kind_rank, a, b); order by ts, kind_rank, symbol at the sink."""
    out = None
    parts = [
        ("bar_close", F.lit(True), F.col("close"), F.col("volume")),
        ("oi_snapshot", covered("open_interest"), F.col("oi_total_usd"), F.lit(None).cast("double")),
        ("liq_snapshot", covered("liquidations"), F.col("liq_long_usd"), F.col("liq_short_usd")),
        ("funding_snapshot", F.col("_cp"), F.col("funding_rate"), F.lit(None).cast("double")),
        ("taker_snapshot", covered("taker"), F.col("taker_buy_volume_usd"), F.col("taker_sell_volume_usd")),
    ]
    df = df.withColumn("_cp", funding_change_point())
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("kind_rank"), on.alias("on"), a.alias("a"), b.alias("b")) for i, (k, on, a, b) in enumerate(parts)))
    out = df.select(*KEYS, F.col("minute_ts").alias("ts"), F.explode(each).alias("e")).select(*KEYS, "ts", "e.*")
    return out.where("on").drop("on")


def kind_fully_uncovered(cov: DataFrame, symbols: list[str], kinds: list[str]) -> DataFrame:
    """(dataset, kind): kinds that no requested symbol covers anywhere."""
    wanted = cov.where(F.col("symbol").isin(symbols) & F.col("kind").isin(kinds))
    return wanted.groupBy("dataset", "kind").agg(F.sum("covered_minutes").alias("n")).where("n = 0").drop("n")


def window_complete(bars: DataFrame, ts_from: int, ts_to: int, interval: int) -> DataFrame:
    """(dataset, symbol, complete): the bars cover [ts_from, ts_to) on the grid from the bar that holds its left edge, with none missing or more."""
    t = F.col("minute_ts")
    per = bars.groupBy(*KEYS).agg(F.max(F.when((t <= ts_from) & (t + interval > ts_from), t)).alias("anchor"), F.collect_set(F.when((t >= ts_from) & (t < ts_to), F.pmod(t, F.lit(interval)))).alias("phases"), F.count_distinct(F.when((t >= ts_from) & (t < ts_to), t)).alias("n"))
    first = F.when(F.col("anchor") == ts_from, F.col("anchor")).otherwise(F.col("anchor") + interval)
    slots = F.greatest(F.ceil((F.lit(ts_to) - first) / interval), F.lit(0))
    on_grid = (F.size("phases") == 0) | ((F.size("phases") == 1) & (F.get("phases", F.lit(0)) == F.pmod("anchor", F.lit(interval))))
    return per.select(*KEYS, F.coalesce(F.col("anchor").isNotNull() & on_grid & (F.col("n") == slots), F.lit(False)).alias("complete"))


def windows_complete(bars: DataFrame, windows: DataFrame, interval: int, span: int | None = None) -> DataFrame:
    """(window_id, complete) for windows (window_id, symbol, ts_from, ts_to): every symbol's bars cover the window on the grid of `interval`, with a bar that holds
    its left edge, none missing and none between.

    A window is complete if the last bar at or before ts_from reaches over it, the last one before ts_to reaches ts_to, and no two neighbours between
    them are anything but `interval` apart: the breaks so far are equal at both. So a window is two rows, however long it is.
    """
    b = running(bars.select("symbol", F.col("minute_ts").alias("ts")), {"_was": ("lag", F.col("ts"))}, ["symbol"], "ts", span)
    b = running(b.withColumn("_break", (~F.coalesce(F.col("ts") - F.col("_was") == interval, F.lit(False))).cast("long")), {"breaks": ("sum", F.col("_break"))}, ["symbol"], "ts", span)
    ends = F.array(F.struct(F.lit("a").alias("end"), F.col("ts_from").alias("ts"), F.lit(1).alias("_o")), F.struct(F.lit("z").alias("end"), F.col("ts_to").alias("ts"), F.lit(-1).alias("_o")))
    points = windows.select("window_id", "symbol", "ts_from", "ts_to", F.explode(ends).alias("e")).select("window_id", "symbol", "ts_from", "ts_to", "e.*")
    both = points.unionByName(b.select("symbol", "ts", F.lit(0).alias("_o"), F.struct("ts", "breaks").alias("_bar")), allowMissingColumns=True)
    met = running(both, {"bar": ("last", F.col("_bar"))}, ["symbol"], "ts", span, ["_o"]).where("_o <> 0")
    pick = lambda e: F.max(F.when(F.col("end") == e, F.col("bar")))
    per = met.groupBy("window_id", "symbol", "ts_from", "ts_to").agg(pick("a").alias("a"), pick("z").alias("z"))
    inside = (F.col("z.ts") + interval >= F.col("ts_to")) & (F.col("a.breaks") == F.col("z.breaks"))
    ok = (F.col("a.ts") + interval > F.col("ts_from")) & (inside | (F.col("ts_from") >= F.col("ts_to")))  # an empty window has no slots
    return per.groupBy("window_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("complete"))


def flow_columns(df: DataFrame) -> DataFrame:
    """df with taker_delta_usd and liq_ratio_pct (0 without open interest)."""
    ratio = F.when(F.col("oi_total_usd") > 0, F.col("liq_long_usd") / F.col("oi_total_usd") * 100).otherwise(0.0)
    return df.withColumn("taker_delta_usd", F.col("taker_buy_volume_usd") - F.col("taker_sell_volume_usd")).withColumn("liq_ratio_pct", F.when(F.col("liq_long_usd").isNotNull(), ratio))


def source_column(source: str) -> Column:
    if source == "hlc3":
        return (F.col("high") + F.col("low") + F.col("close")) / 3
    if source == "ohlc4":
        return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    if source in ("close", "open", "high", "low", "volume"):
        return F.col(source)
    raise ValueError(f"unknown source {source}")
