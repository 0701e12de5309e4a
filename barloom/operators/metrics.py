"""Run metrics over equity (run_id, seq, bar_ts, equity) and trades (run_id, realized_pnl, ...): one aggregation of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, YEAR_MS, day_of
from .pieces import running

EQUITY_METRICS = ["pnl", "max_drawdown", "sharpe", "sortino", "returns_stddev", "returns_skew", "returns_kurtosis", "returns_count", "cagr", "calmar", "elapsed_years"]
TRADE_METRICS = ["win_rate", "total_trades", "profit_factor", "top_trade_contribution_pct", "expectancy", "sqn"]
METRICS = EQUITY_METRICS + TRADE_METRICS


def equity_metrics(equity: DataFrame, keys: list[str] | None = None, years: Column | None = None, span: int | None = None) -> DataFrame:
    """One row for each key. Fewer than two points or an earlier equity of 0 make the returns invalid: count 0, moments 0.
    Moments are those of the population; kurtosis is Pearson's. `years` (a column of equity) replaces the elapsed time.
    span: points (of seq) of a piece, for runs too long for one task; see pieces.running()."""
    keys = keys or ["run_id"]
    e = running(equity, {"_prev": ("lag", F.col("equity")), "_peak": ("max", F.col("equity"))}, keys, "seq", span)
    e = e.withColumn("_dd", F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("equity")) / F.col("_peak")).otherwise(0.0))
    e = e.withColumn("_r", F.try_divide(F.col("equity"), F.col("_prev")) - 1)
    if years is not None:
        e = e.withColumn("_years", years)
    r = F.col("_r")
    agg = e.groupBy(*keys).agg(
        F.max_by("equity", "seq").alias("last"), F.min_by("equity", "seq").alias("first"), F.max("_dd").alias("max_drawdown"), F.count("*").alias("points"), F.count_if(F.col("_prev") == 0).alias("zeros"),
        F.avg("_r").alias("m"), F.stddev_pop("_r").alias("s"), F.sqrt(F.avg(F.when(r < 0, r * r).when(r.isNotNull(), 0.0))).alias("down"), F.skewness("_r").alias("skew"), F.kurtosis("_r").alias("kurt"), F.count("_r").alias("n"),
        ((F.max("bar_ts") - F.min("bar_ts")) / YEAR_MS).alias("span"), (F.max("bar_ts") > F.min("bar_ts")).alias("times"), *([F.first("_years").alias("_years")] if years is not None else []),
    )
    ok = (F.col("points") >= 2) & (F.col("zeros") == 0)
    many = ok & (F.col("n") > 1) & (F.col("s") > 0)
    elapsed = F.col("_years") if years is not None else F.when(F.col("times"), F.col("span"))
    grown = F.when((elapsed > 0) & (F.col("first") > 0) & (F.col("last") > 0), F.pow(F.col("last") / F.col("first"), F.try_divide(F.lit(1.0), elapsed)) - 1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = agg.select(
        *keys, zero(F.col("last") - F.col("first")).alias("pnl"), zero(F.col("max_drawdown")).alias("max_drawdown"),
        zero(F.when(many, F.try_divide(F.col("m"), F.col("s")))).alias("sharpe"), zero(F.when(ok & (F.col("n") > 1) & (F.col("down") > 0), F.try_divide(F.col("m"), F.col("down")))).alias("sortino"),
        zero(F.when(ok, F.col("s"))).alias("returns_stddev"), zero(F.when(many, F.col("skew"))).alias("returns_skew"), zero(F.when(many, F.col("kurt") + 3)).alias("returns_kurtosis"),
        F.when(ok, F.col("n")).otherwise(0).cast("long").alias("returns_count"), grown.alias("cagr"), elapsed.alias("elapsed_years"), "points",
    )
    return out.withColumn("calmar", F.try_divide("cagr", F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))))


def trade_aggregates() -> list[Column]:
    p = F.col("realized_pnl")
    win, loss = F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, -p))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(F.avg((p > 0).cast("double"))).alias("win_rate"), F.count(p).alias("total_trades"), F.try_divide(zero(win), loss).alias("profit_factor"), zero(F.try_divide(F.max(F.when(p > 0, p)), win) * 100).alias("top_trade_contribution_pct"),
        zero(F.avg(p)).alias("expectancy"), zero(F.when(F.count(p) >= 2, F.try_divide(F.avg(p), F.when(F.stddev_pop(p) > 0, F.stddev_pop(p))) * F.sqrt(F.count(p)))).alias("sqn"),
    ]


def trade_metrics(trades: DataFrame, keys: list[str] | None = None, custom: dict[str, Column] | None = None) -> DataFrame:
    """custom: further metrics as aggregates over the trades' columns."""
    return trades.groupBy(*(keys or ["run_id"])).agg(*trade_aggregates(), *(c.alias(k) for k, c in (custom or {}).items()))


def run_metrics(equity: DataFrame, trades: DataFrame, names: list[str] | None = None, keys: list[str] | None = None, years: Column | None = None, custom: dict[str, Column] | None = None) -> DataFrame:
    """The metrics asked for (unknown names are passed over) and the custom ones, aggregates over the trades; one row for each run that has equity."""
    keys = keys or ["run_id"]
    out = equity_metrics(equity, keys, years).join(trade_metrics(trades, keys, custom), keys, "left")
    out = out.fillna(0.0, ["win_rate", "top_trade_contribution_pct", "expectancy", "sqn"]).fillna(0, ["total_trades"])
    return out.select(*keys, *(n for n in (names or METRICS) if n in METRICS or n == "points"), *(custom or {}))


def long_form(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value); undefined metrics have no row."""
    return metrics.select(*keys, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(keys, names, "metric", "value").where("value is not null")


def metrics_rollup(trades: DataFrame) -> DataFrame:
    """Trade metrics for each symbol of a run and for the run (symbol NULL, level `run`)."""
    return trades.rollup("run_id", "symbol").agg(F.grouping_id().alias("g"), *trade_aggregates()).where("g <= 1").withColumn("level", F.when(F.col("g") == 0, "symbol").otherwise("run")).drop("g")


def diagnostics(trades: DataFrame, runs: DataFrame, min_trades: int = 10, concentration_pct: float = 50) -> DataFrame:
    """runs (run_id, bars, orders, returns_count) with facts and flags, in the flags' fixed order."""
    p = F.col("realized_pnl")
    per = trades.groupBy("run_id").agg(F.count("*").alias("trade_count"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(F.col("exit_bar_index") - F.col("entry_bar_index")).alias("exposure"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("gross"), F.coalesce(F.max(F.when(p > 0, p)), F.lit(0.0)).alias("top"))
    d = runs.join(per, "run_id", "left").fillna(0, ["trade_count", "wins", "losses", "exposure"]).fillna(0.0, ["gross", "top"])
    d = d.withColumn("exposure_fraction", F.coalesce(F.try_divide(F.col("exposure"), F.col("bars")), F.lit(0.0)))
    d = d.withColumn("concentration_pct", F.coalesce(F.try_divide(F.col("top"), F.col("gross")) * 100, F.lit(0.0)))
    n = F.col("trade_count")
    flags = [(n == 0, "no_entries"), (n < min_trades, "underpowered"), ((F.col("gross") > 0) & (F.col("concentration_pct") > concentration_pct), "single_trade_dominated"), ((n > 0) & (F.col("exposure_fraction") == 0), "zero_exposure"), ((n > 0) & (F.col("losses") == n), "all_losing")]
    return d.withColumn("flags", F.array_compact(F.array(*(F.when(c, f) for c, f in flags)))).drop("exposure", "gross", "top")


def overlay_effect_counts(effects: DataFrame) -> DataFrame:
    kinds = ["pass", "annotate", "patch", "veto"]
    return effects.groupBy("run_id").agg(*(F.count_if(F.col("effect") == k).alias(k) for k in kinds))


def daily_pnl_deltas(equity: DataFrame) -> DataFrame:
    """(run_id, day, delta): differences of the last equity of adjacent days that there are, labelled by the later day."""
    last = equity.groupBy("run_id", F.floor(F.col("bar_ts") / DAY_MS).alias("d")).agg(F.max_by("equity", "seq").alias("e"))
    delta = F.col("e") - F.lag("e").over(Window.partitionBy("run_id").orderBy("d"))
    return last.withColumn("delta", delta).where("delta is not null").select("run_id", day_of(F.col("d") * F.lit(DAY_MS)).alias("day"), "delta")
