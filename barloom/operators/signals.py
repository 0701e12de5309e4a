"""Conditions over bars. Each returns df with new columns; look-back is by lag and frames, never beyond the bar itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pct_change, pct_drop, pct_rise
from .tape import grid


def momentum_signal() -> Column:
    """close[i-1] > close[i-2], false on the first two bars."""
    return F.coalesce(F.lag("close", 1).over(grid()) > F.lag("close", 2).over(grid()), F.lit(False))


def pump_signal(pump_pct: float = 10, window: int = 20, min_volume: float = 0) -> Column:
    return F.coalesce((pct_change("close", F.lag("close", window).over(grid())) >= pump_pct) & (F.col("volume") >= min_volume) & F.lag("close", window).over(grid()).isNotNull(), F.lit(False))


def dump_open_to_close(df: DataFrame, lookback: int = 20, min_drop: float = 10) -> DataFrame:
    """df with `dump`: a struct of the fall from the window's first open to this close, its extremes and their first times; NULL without one."""
    w = grid(1 - lookback, 0)
    first_open, high, low = F.first("open").over(w), F.max("high").over(w), F.min("low").over(w)
    high_ts, low_ts = F.min_by("minute_ts", F.struct(-F.col("high"), "minute_ts")).over(w), F.min_by("minute_ts", F.struct("low", "minute_ts")).over(w)
    drop = pct_drop(first_open, "close")
    value = F.struct(drop.alias("drop_open_close"), pct_drop(high, low).alias("drop_high_low"), high.alias("highest"), high_ts.alias("highest_ts"), low.alias("lowest"), low_ts.alias("low_ts"), pct_rise(low, "close").alias("bounce"))
    return df.withColumn("dump", F.when((F.count("*").over(w) >= 2) & (drop >= min_drop), value))


def dump_high_to_low(df: DataFrame, lookback: int = 20, min_drop: float = 10, hold: float = 6, max_bounce: float = 3.5, max_place: float = 55) -> DataFrame:
    """df with `dump`: the fall from the window's highest high (the first) to the lowest low at or after it, if the close
    holds, the low's candle closed low in its range, and a green one has not recovered. Lists hold `lookback` bars."""
    w = grid(1 - lookback, 0)
    df = df.withColumn("_w", F.collect_list(F.struct("high", "low", "open", "close", F.col("minute_ts").alias("ts"))).over(w))
    df = df.withColumn("_top", F.array_max(F.transform("_w", lambda b: F.struct(b.high.alias("high"), (-b.ts).alias("late")))))
    after = F.filter("_w", lambda b: (b.ts >= -F.col("_top.late")) & (b.low > 0))
    df = df.withColumn("_bot", F.array_min(F.transform(after, lambda b: F.struct(b.low.alias("low"), b.ts.alias("ts"), b.high.alias("high"), b.open.alias("open"), b.close.alias("close")))))
    b, top, close = F.col("_bot"), F.col("_top.high"), F.col("close")
    bounce, drop = pct_rise(b.low, close), pct_drop(top, b.low)
    place = F.when(b.high > b.low, F.try_divide(b.close - b.low, b.high - b.low) * 100).otherwise(0.0)
    ok = (F.size("_w") >= 2) & (drop >= min_drop) & (pct_drop(top, close) >= hold) & (place <= max_place) & ~((b.close >= b.open) & (bounce > max_bounce))
    value = F.struct(drop.alias("drop_high_low"), top.alias("highest"), (-F.col("_top.late")).alias("highest_ts"), b.low.alias("lowest"), b.ts.alias("low_ts"), bounce.alias("bounce"))
    return df.withColumn("dump", F.when(F.coalesce(ok, F.lit(False)), value)).drop("_w", "_top", "_bot")


def _rising(fast_pct: float, green: int) -> tuple[Column, Column]:
    back = lambda n: F.lag("close", n).over(grid())
    fast = pct_change("close", back(1)) >= fast_pct
    greens = (F.col("close") > back(1)).cast("int") + (back(1) > back(2)).cast("int")
    return fast, fast | (greens >= green)


def _oi_recovery(fast: Column) -> Column:
    oi = lambda n: F.lag("oi_total_usd", n).over(grid()) if n else F.col("oi_total_usd")
    return F.when(fast, pct_change(oi(0), oi(1))).otherwise(pct_change(oi(0), oi(2)))


def _complete_oi() -> Column:
    held = (F.col("has_oi") & F.col("oi_total_usd").isNotNull()).cast("int")
    return F.sum(held).over(grid(-2, 0)) == 3


def entry_confirm(df: DataFrame, local_low: Column, fast_pct: float = 2.5, green: int = 2, min_oi: float = 0.05, min_bounce: float = 0.6, min_ratio: float = 0.02, require_liquidation: bool = True) -> DataFrame:
    """df with entry_reason: NULL if the entry is confirmed, else the first thing that speaks against it."""
    fast, rising = _rising(fast_pct, green)
    liq, oi = F.col("liq_long_usd"), F.col("oi_total_usd")
    ratio = F.when(oi > 0, liq / oi * 100).otherwise(0.0)
    reason = F.when(~F.coalesce(_complete_oi(), F.lit(False)), "missing_open_interest").when(liq.isNull(), "missing_liquidations").when(F.lag("close", 2).over(grid()).isNull(), "too_few_candles")
    reason = reason.when(~rising, "price_not_rising_2m").when(_oi_recovery(fast) < min_oi, "oi_not_recovered").when(pct_change("close", local_low) < min_bounce, "bounce_too_small")
    if require_liquidation:
        reason = reason.when(liq <= 0, "no_liquidations").when(ratio < min_ratio, "liq_ratio_too_small")
    return df.withColumn("entry_reason", reason)


def dca_confirm(df: DataFrame, local_low: Column, done: Column, max_adds: int = 2, fast_pct: float = 2.0, green: int = 2, min_oi: float = 0.005, min_bounce: float = 0.5) -> DataFrame:
    """df with dca_reason: NULL if adding is confirmed, else the first thing that speaks against it."""
    fast, rising = _rising(fast_pct, green)
    reason = F.when(done >= max_adds, "dca_limit_reached").when(~F.coalesce(_complete_oi(), F.lit(False)), "missing_open_interest")
    reason = reason.when(~F.coalesce(rising, F.lit(False)), "price_not_rising_2m").when(_oi_recovery(fast) < min_oi, "oi_not_recovered").when(pct_change("close", local_low) < min_bounce, "bounce_too_small")
    return df.withColumn("dca_reason", reason)


def exit_rules(trades: DataFrame, bars: DataFrame, take: float, stop: float, max_hold_ms: int) -> DataFrame:
    """trades (trade_id, symbol, entry_ts, entry_price) with the first bar after the entry that exits: take profit before hard stop before time.

    Bars inside the holding time are met by buckets of that span, not by a range join; the bar that leaves by time, however
    late it comes, is the first at or after the span's end: a union and one window.
    """
    span = max(max_hold_ms, 1)
    t = trades.select("trade_id", "symbol", "entry_ts", "entry_price", F.explode(F.sequence(F.floor(F.col("entry_ts") / span), F.floor(F.col("entry_ts") / span) + 1)).alias("_bucket"))
    b = bars.select("symbol", F.col("minute_ts").alias("ts"), "close", F.floor(F.col("minute_ts") / span).alias("_bucket"))
    inside = t.join(b, ["symbol", "_bucket"]).where((F.col("ts") > F.col("entry_ts")) & (F.col("ts") - F.col("entry_ts") < max_hold_ms)).select("trade_id", "entry_ts", "entry_price", "ts", "close")
    bar = F.struct(F.col("minute_ts").alias("ts"), "close")
    ends = trades.select("symbol", (F.col("entry_ts") + max_hold_ms).alias("at"), F.lit(0).alias("o"), F.struct("trade_id", "entry_ts", "entry_price").alias("trade"))
    rows = bars.select("symbol", F.col("minute_ts").alias("at"), F.lit(1).alias("o"), bar.alias("bar"))
    ahead = Window.partitionBy("symbol").orderBy("at", "o").rowsBetween(0, Window.unboundedFollowing)
    both = ends.unionByName(rows, allowMissingColumns=True).withColumn("bar", F.first("bar", ignorenulls=True).over(ahead))
    late = both.where("o = 0 and bar is not null").select("trade.*", "bar.*")
    change = pct_change("close", "entry_price")
    reason = F.when(change >= take, "take_profit").when(change <= -stop, "hard_stop").when(F.col("ts") - F.col("entry_ts") >= max_hold_ms, "time_exit")
    hit = inside.unionByName(late).withColumn("reason", reason).where("reason is not null")
    first = hit.groupBy("trade_id").agg(F.min(F.struct("ts", "reason", "close")).alias("h")).select("trade_id", F.col("h.ts").alias("exit_ts"), F.col("h.reason").alias("close_reason"), F.col("h.close").alias("exit_price"))
    return trades.join(first, "trade_id", "left")


def fail_fast(held: DataFrame, min_candles: int = 2, max_drift: float = -1.5, max_green: float = 0.75, skip_bounce: float = 1.25) -> DataFrame:
    """held: the bars of each trade (trade_id, entry_ts, entry_price and bar columns) with `fail_fast`: leave before the first target."""
    w = Window.partitionBy("trade_id").orderBy("minute_ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    body = lambda c, o: F.when((o > 0) & (c > o), (c - o) / o * 100).otherwise(0.0)
    since = F.sum((F.col("minute_ts") > F.col("entry_ts")).cast("int")).over(upto)
    bounce = (F.max(F.when(F.col("minute_ts") >= F.col("entry_ts"), F.col("high"))).over(upto) / F.col("entry_price") - 1) * 100
    back = F.lag("close", 3).over(w)
    drift = F.when(back > 0, (F.col("close") - back) / back * 100)
    greens = body(F.col("close"), F.col("open")) + body(F.lag("close").over(w), F.lag("open").over(w))
    return held.withColumn("fail_fast", F.coalesce((since >= min_candles) & (bounce < skip_bounce) & (greens < max_green) & (drift < max_drift), F.lit(False)))


def adverse_drift(entry_price: Column, n: int = 3) -> Column:
    """All of the last n closed closes stand above a short's entry."""
    w = grid(-n, -1)
    return F.coalesce((F.count("close").over(w) == n) & (F.min("close").over(w) > entry_price), F.lit(False))


def compose_overlays(effects: DataFrame) -> DataFrame:
    """effects (decision_id, pos, effect, stop, take) -> one row per decision: vetoed, veto_pos, and the last patched stop and take before a veto."""
    veto = effects.groupBy("decision_id").agg(F.min(F.when(F.col("effect") == "veto", F.col("pos"))).alias("veto_pos"))
    seen = effects.join(veto, "decision_id").where(F.col("veto_pos").isNull() | (F.col("pos") <= F.col("veto_pos")))
    patch = lambda c: F.max_by(F.when(F.col("effect") == "patch", F.col(c)), F.when((F.col("effect") == "patch") & F.col(c).isNotNull(), F.col("pos")))
    return seen.groupBy("decision_id").agg(F.first("veto_pos").isNotNull().alias("vetoed"), F.first("veto_pos").alias("veto_pos"), patch("stop").alias("stop"), patch("take").alias("take"), F.count("*").alias("applied"))
