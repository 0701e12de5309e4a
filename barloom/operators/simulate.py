"""From decisions to fills, positions and equity, as joins and windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from ..functions.scalars import clamp, fee, fill_price, protection_levels
from .pieces import ROWS, in_pieces, running
from .signals import momentum_signal
from .tape import KEYS, funding_as_of, grid

INITIAL = 10_000.0


def attach_fills(decisions: DataFrame, bars: DataFrame, model: str = "next_bar_open") -> DataFrame:
    """decisions (symbol, minute_ts, ...) with fill_ts, base_price and expired: the next bar's open, or this bar's close."""
    ahead = model == "next_bar_open"
    prices = bars.select("symbol", "minute_ts", (F.lead("minute_ts").over(grid()) if ahead else F.col("minute_ts")).alias("fill_ts"), (F.lead("open").over(grid()) if ahead else F.col("close")).alias("base_price"))
    return decisions.join(prices, ["symbol", "minute_ts"], "left").withColumn("expired", F.col("base_price").isNull())


def risk_gate(decisions: DataFrame, profiles: DataFrame) -> DataFrame:
    """decisions (decision_id, profile, kind, side, stop, take, percent, size_hint, equity, open_positions, add_count, mode) with action, reason,
    notional, stop, take and close_fraction. profiles hold a row for each profile."""
    d = decisions.join(profiles, "profile", "left")
    held, kind = F.col("open_positions") > 0, F.col("kind")
    limit = F.when(F.col("mode") == "dca", F.col("dca_max_adds")).otherwise(F.col("scale_max_adds"))
    most = F.when(F.col("mode") == "dca", F.col("dca_max_pct")).otherwise(F.col("scale_max_pct"))
    stop, take = F.when(F.col("stop").isNotNull(), clamp("stop", F.col("stop_min"), F.col("stop_max"))), F.when(F.col("take").isNotNull(), clamp("take", F.col("take_min"), F.col("take_max")))
    hinted = F.coalesce(stop != F.col("stop"), F.lit(False)) | F.coalesce(take != F.col("take"), F.lit(False))
    size = F.coalesce(F.col("size_hint"), most)
    reason = (
        F.when(kind == "enter", F.when(~F.array_contains("sides", F.col("side")), F.concat(F.lit("side_not_allowed:"), "side")).when(F.col("open_positions") >= F.col("max_positions"), "max_concurrent_positions").when(hinted, "hints_clamped").otherwise("within_risk_profile"))
        .when(kind == "exit", F.when(F.col("percent").isNull(), "exit_always_allowed").when(F.isnan("percent") | (F.col("percent") <= 0), "invalid_exit_percent").when(F.col("percent") >= 100, "exit_percent_clamped").otherwise("exit_partial_allowed"))
        .when(kind == "update_protection", F.when(~held, "update_without_position").when(hinted, "hints_clamped").otherwise("protection_updated"))
        .when(kind == "add", F.when(~held | F.col("add_count").isNull(), "add_without_position").when(limit.isNull(), F.concat("mode", F.lit("_not_permitted"))).when(F.col("add_count") >= limit, F.concat("mode", F.lit("_limit_exceeded"))).when(size > most, "add_notional_clamped").otherwise("add_within_limits"))
        .otherwise("not_gated")
    )
    d = d.withColumn("reason", reason)
    rejected = F.col("reason").rlike("^(side_not_allowed|max_concurrent|invalid_exit|update_without|add_without)|_not_permitted$|_limit_exceeded$")
    action = F.when(rejected, "reject").when(F.col("reason").isin("hints_clamped", "exit_percent_clamped", "add_notional_clamped"), "clamp").otherwise("accept")
    notional = F.when(kind == "enter", F.col("size_pct") * F.col("equity")).when(kind == "add", F.least(size, most) * F.col("equity"))
    ok = ~rejected
    fraction = F.when(kind == "exit", F.when(F.col("percent").isNull() | (F.col("percent") >= 100), 1.0).otherwise(F.col("percent") / 100))
    return d.select("decision_id", action.alias("action"), "reason", F.when(ok, notional).alias("notional"), F.when(ok, stop).alias("stop"), F.when(ok, take).alias("take"), F.when(ok, fraction).alias("close_fraction"))


def _bucketed(trades: DataFrame, width: int) -> DataFrame:
    return trades.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("entry_bar") / width), F.floor(F.col("exit_bar") / width))))


def held_bars(trades: DataFrame, bars: DataFrame, width: int = 1440) -> DataFrame:
    """Trades joined to the bars from entry_bar to exit_bar, both inclusive, by buckets of `width` bars: an equi-join, then a filter."""
    b = bars.withColumn("_bucket", F.floor(F.col("bar_index") / width))
    return _bucketed(trades, width).join(b, ["symbol", "_bucket"]).where("bar_index between entry_bar and exit_bar").drop("_bucket")


#: Bars, or blocks, of one block of the next level; levels above the bars.
FAN, LEVELS = 128, 3


def _extremes(bars: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """For each level above the bars (symbol, node, children): a node's children with their places, lowest lows and highest highs, in order."""
    below, out = bars.select("symbol", F.col("bar_index").alias("unit"), "low", "high"), []
    for _ in range(levels):
        child = F.struct(F.pmod("unit", F.lit(fan)).cast("int").alias("i"), "low", "high")
        nodes = below.groupBy("symbol", F.floor(F.col("unit") / fan).alias("node")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        out.append(nodes)
        below = nodes.select("symbol", F.col("node").alias("unit"), F.array_min("children.low").alias("low"), F.array_max("children.high").alias("high"))
    return out


def first_touch(ranges: DataFrame, bars: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """ranges (trade_id, symbol, first_bar, last_bar, below, above) -> (trade_id, symbol, bar_index) of those with a bar in [first_bar, last_bar] whose
    low is at or under `below` or whose high is at or over `above`: the first such bar. bars: symbol, bar_index, low, high.

    Bars stand in blocks of fan, these in blocks of fan, and so on, with the extremes of each. A range is two parts of blocks at each level at most (and whole
    blocks of the top one), each a row that meets its block by an equi-join; the first part touched is then followed down. So rows go by
    the logarithm of the bars held.
    """
    tables = _extremes(bars, fan, levels)
    lo, hi, parts = F.col("first_bar"), F.col("last_bar"), []
    part = lambda level, node, a, z: F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"), a.cast("int").alias("a"), z.cast("int").alias("z"))
    for level in range(1, levels):
        first, last = F.floor(lo / fan), F.floor(hi / fan)
        whole = F.lit(fan - 1)
        parts.append(F.when(lo <= hi, part(level, first, F.pmod(lo, F.lit(fan)), F.when(first == last, F.pmod(hi, F.lit(fan))).otherwise(whole))))
        parts.append(F.when((lo <= hi) & (first < last), part(level, last, F.lit(0), F.pmod(hi, F.lit(fan)))))
        lo, hi = first + 1, last - 1
    first, last = F.floor(lo / fan), F.floor(hi / fan)
    top = F.transform(F.sequence(first, last), lambda n: part(levels, n, F.when(n == first, F.pmod(lo, F.lit(fan))).otherwise(0), F.when(n == last, F.pmod(hi, F.lit(fan))).otherwise(fan - 1)))
    top = F.when(lo <= hi, top)
    parts = F.filter(F.concat(F.array(*parts), F.coalesce(top, F.slice(F.array(parts[0]), 1, 0))), lambda p: p.isNotNull())
    rows = ranges.select("trade_id", "symbol", "below", "above", F.explode(parts).alias("p")).select("trade_id", "symbol", "below", "above", "p.*")

    def touched(a: Column, z: Column) -> Column:
        """The place of the first child from a to z that touches a level; NULL without one."""
        hit = F.filter("children", lambda c: (c.i >= a) & (c.i <= z) & F.coalesce((c.low <= F.col("below")) | (c.high >= F.col("above")), F.lit(False)))
        return F.get(hit.i, F.lit(0))

    nodes = tables[0].withColumn("level", F.lit(1))
    for level, t in enumerate(tables[1:], 2):
        nodes = nodes.unionByName(t.withColumn("level", F.lit(level)))
    met = rows.join(nodes, ["symbol", "level", "node"]).withColumn("_i", touched(F.col("a"), F.col("z"))).where("_i is not null")
    unit = F.col("node") * fan + F.col("_i")
    start = unit * F.element_at(F.array(*(F.lit(fan**k) for k in range(levels))), F.col("level"))
    now = met.select("trade_id", "symbol", "below", "above", "level", unit.alias("unit"), start.alias("start"))
    now = now.groupBy("trade_id").agg(F.min_by(F.struct("symbol", "below", "above", "level", "unit"), "start").alias("f")).select("trade_id", "f.*")
    for level in range(levels - 1, 0, -1):
        here = F.col("level") == level + 1
        spread = -1 - F.pmod(F.xxhash64("trade_id"), F.lit(1024))  # rows that need no step meet no block, dealt evenly
        t = tables[level - 1].withColumnRenamed("symbol", "_symbol")
        now = now.withColumn("node", F.when(here, F.col("unit")).otherwise(spread)).join(t.withColumnRenamed("node", "_node"), (F.col("symbol") == F.col("_symbol")) & (F.col("node") == F.col("_node")), "left")
        below = F.col("unit") * fan + touched(F.lit(0), F.lit(fan - 1))
        now = now.select("trade_id", "symbol", "below", "above", F.when(here, level).otherwise(F.col("level")).alias("level"), F.when(here, below).otherwise(F.col("unit")).alias("unit"))
    return now.select("trade_id", "symbol", F.col("unit").cast("long").alias("bar_index"))


def protection_hits(trades: DataFrame, bars: DataFrame, first_offset: int = 0, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """trades (trade_id, symbol, side, entry_bar, exit_bar, entry_price, stop, take) with hit_bar, hit_kind and hit_price of the first bar that
    touches a level: the stop before the take, at the open when it gapped through. first_offset 0 checks the entry bar itself, 1 starts after it.
    The first touch is searched in blocks, so held bars are no rows."""
    stop, take = protection_levels(F.col("entry_price"), F.col("side"), F.col("stop"), F.col("take"))
    long = F.col("side") == "long"
    ranges = trades.select("trade_id", "symbol", (F.col("entry_bar") + first_offset).alias("first_bar"), F.col("exit_bar").alias("last_bar"), F.when(long, stop).otherwise(take).alias("below"), F.when(long, take).otherwise(stop).alias("above"))
    found = first_touch(ranges, bars, fan, levels).join(bars.select("symbol", "bar_index", "open", "high", "low"), ["symbol", "bar_index"]).drop("symbol")
    h = trades.join(found, "trade_id", "left")
    stopped = F.when(long, F.col("low") <= stop).otherwise(F.col("high") >= stop)
    price = F.when(stopped, F.when(long, F.least("open", stop)).otherwise(F.greatest("open", stop))).otherwise(F.when(long, F.greatest("open", take)).otherwise(F.least("open", take)))
    hit = F.col("bar_index").isNotNull()
    return h.select(*(F.col(c) for c in trades.columns), F.col("bar_index").alias("hit_bar"), F.when(hit, F.when(stopped, "stop").otherwise("take")).alias("hit_kind"), F.when(hit, price).alias("hit_price"))


#: A bar's charge for one unit; sums of it are exact, so a difference of two running sums is the sum between them.
CHARGE = "decimal(38,20)"


def _between(trades: DataFrame, bars: DataFrame, charge: Column, counted: Column, last_bar: Column, span: int | None) -> DataFrame:
    """(trade_id, charge, counted): sums over the bars from entry_bar to before last_bar, as the difference of running sums at its two ends."""
    ends = F.array(F.struct(F.col("entry_bar").alias("bar_index"), F.lit(-1).alias("sign")), F.struct(F.greatest(last_bar, F.col("entry_bar")).alias("bar_index"), F.lit(1).alias("sign")))
    points = trades.select("symbol", "trade_id", F.explode(ends).alias("e")).select("symbol", "trade_id", "e.*", F.lit(0).alias("_o"))
    moves = bars.select("symbol", "bar_index", F.when(counted, charge).cast(CHARGE).alias("_c"), counted.cast("long").alias("_n"), F.lit(1).alias("_o"))
    both = running(points.unionByName(moves, allowMissingColumns=True), {"_sum": ("sum", F.col("_c")), "_count": ("sum", F.col("_n"))}, ["symbol"], "bar_index", span, ["_o"])
    signed = lambda c: F.coalesce(F.sum(F.when(F.col("sign") > 0, F.col(c)).otherwise(-F.col(c))), F.lit(0))  # noqa: E731  a product would cut the decimals
    return both.where("_o = 0").groupBy("trade_id").agg(signed("_sum").cast("double").alias("charge"), signed("_count").alias("counted"))


def funding_accrual(trades: DataFrame, bars: DataFrame, bar_minutes: float, interval_h: float = 8, span: int | None = None) -> DataFrame:
    """trades with `funding`: one charge for each held covered bar from the entry bar up to but not including the exit bar; longs pay positive rates.
    span: bars of a piece, for symbols too long for one task; see pieces.running()."""
    side = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    shown = funding_as_of(bars, int(bar_minutes * 60_000), None if span is None else int(span * bar_minutes * 60_000))
    unit = F.col("funding_point_rate") / (interval_h * 60) * bar_minutes * F.col("close")
    per = _between(trades, shown, unit, F.col("funding_state") != "missing", F.col("exit_bar"), span)
    out = trades.join(per, "trade_id", "left").withColumn("funding", F.coalesce(side * F.col("size") * F.col("charge"), F.lit(0.0)))
    return out.withColumn("covered_bars", F.coalesce("counted", F.lit(0)).cast("long")).drop("charge", "counted")


def funding_fraction(trades: DataFrame, bars: DataFrame, bar_minutes: float = 1, interval_h: float = 8, span: int | None = None) -> DataFrame:
    """(trade_id, fraction) of the notional over the held bars, entry and exit bar included; uncovered ones are skipped."""
    side = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    on = F.coalesce(F.col("has_funding") & F.col("funding_rate").isNotNull(), F.lit(False))
    per = _between(trades, bars, F.col("funding_rate") / (interval_h * 60) * bar_minutes, on, F.col("exit_bar") + 1, span)
    return trades.select("trade_id", "side").join(per, "trade_id", "left").select("trade_id", (side * F.coalesce("charge", F.lit(0.0))).alias("fraction"))


def momentum_trades(rows: DataFrame, keys: list[str] | None = None, signal: Column | None = None) -> DataFrame:
    """One trade for each long bar: (dataset, symbol, bar_index, entry_ts, entry_close, exit_close, ret)."""
    before = F.lag("close").over(grid())
    d = rows.withColumn("_s", momentum_signal() if signal is None else signal).withColumn("_p", before).withColumn("_i", F.row_number().over(grid()) - 1)
    d = d.where("_s and _p <> 0 and _i >= 2")
    return d.select(*KEYS, F.col("_i").cast("long").alias("bar_index"), F.col("minute_ts").alias("entry_ts"), F.col("_p").alias("entry_close"), F.col("close").alias("exit_close"), ((F.col("close") - F.col("_p")) / F.col("_p")).alias("ret"))


def vector_signal(bars: DataFrame, strategy: Callable[[pd.DataFrame], Sequence], out: str = "signal", columns: Sequence[str] = ("open", "high", "low", "close", "volume"), kind: str = "boolean", lookback: int | None = None, rows: int = ROWS) -> DataFrame:
    """bars with a column of a user's own strategy: strategy(bars of one symbol in the order of time, with minute_ts and `columns`) gives one value
    for each of them, as numpy, pandas or a list.

    A strategy sees a whole symbol; with lookback, the number of bars before it that a value depends on, it sees a piece of `rows` bars at a time with
    that many before, so a long symbol is many groups. Values at bars whose past is not whole (the first ones) are the strategy's own.
    """

    def decide(df: DataFrame) -> DataFrame:
        names, made_type = df.columns, to_arrow_type(DataType.fromDDL(kind))
        schema = StructType([*df.schema, StructField(out, DataType.fromDDL(kind))])

        def one(g: pa.Table) -> pa.Table:
            g = g.sort_by("minute_ts")
            seen = g.column("row").combine_chunks()
            got = strategy(pd.DataFrame({c: seen.field(c).to_pandas() for c in ("minute_ts", *columns)}))
            if len(got) != g.num_rows:
                raise ValueError(f"the strategy gave {len(got)} values for {g.num_rows} bars")
            return pa.table([*(seen.field(c) for c in names), pa.array(got, made_type, from_pandas=True)], [*names, out])

        return df.select(*KEYS, "minute_ts", F.struct(*names).alias("row")).groupBy(*KEYS).applyInArrow(one, schema)

    bars = bars.drop(out)
    return decide(bars) if lookback is None else in_pieces(bars, decide, lookback, rows=rows)


def momentum_run(rows: DataFrame, signal: Column | None = None) -> DataFrame:
    """(dataset, pnl, return_pct, total_bars, long_bars, win_rate): each symbol compounds 10 000 over its long bars, those of `signal`."""
    t = momentum_trades(rows, signal=signal).groupBy(*KEYS).agg(F.product(1 + F.col("ret")).alias("growth"), F.count("*").alias("long_bars"), F.count_if(F.col("ret") > 0).alias("wins"))
    n = rows.groupBy(*KEYS).agg(F.greatest(F.count("*") - 2, F.lit(0)).alias("bars")).join(t, KEYS, "left").fillna(0, ["long_bars", "wins"])
    growth = F.coalesce("growth", F.lit(1.0))  # fillna() would take a growth of NaN, as prices without end make it, for none
    out = n.groupBy("dataset").agg(F.sum((growth - 1) * INITIAL).alias("pnl"), F.count("*").alias("n"), F.sum("bars").alias("total_bars"), F.sum("long_bars").alias("long_bars"), F.sum("wins").alias("wins"))
    return out.select("dataset", "pnl", (F.col("pnl") / (INITIAL * F.col("n")) * 100).alias("return_pct"), "total_bars", "long_bars", F.coalesce(F.try_divide("wins", "long_bars"), F.lit(0.0)).alias("win_rate"))


def param_sweep(bars: DataFrame, lookbacks: list[int], thresholds: list[float], signal: Callable[[int], Column] | None = None) -> DataFrame:
    """(run_id, symbol, lookback, threshold, long_bars, growth): close[t-1] over close[t-1-lookback] above a threshold holds the bar t, or
    signal(lookback), a number as of the bar before, does. Each distinct window is computed once; the grid meets the rows as an array of its points."""
    close1 = F.lag("close").over(grid())
    signal = signal or (lambda n: pct_over(close1, F.lag("close", n + 1).over(grid())))
    feats = [signal(n).alias(f"f{n}") for n in lookbacks]
    ret = F.try_divide(F.col("close") - close1, close1)
    rows = bars.select(*KEYS, ret.alias("ret"), *feats)
    points = F.array(*(F.struct(F.lit(n).alias("lookback"), F.lit(float(t)).alias("threshold"), (F.col(f"f{n}") > t).alias("on")) for n in lookbacks for t in thresholds))
    on = rows.select(*KEYS, "ret", F.explode(points).alias("p")).where("p.on and ret is not null")
    out = on.groupBy(*KEYS, "p.lookback", "p.threshold").agg(F.count("*").alias("long_bars"), F.product(1 + F.col("ret")).alias("growth"))
    return out.withColumn("run_id", F.concat_ws("-", F.col("lookback").cast("string"), F.col("threshold").cast("int").cast("string")))


def pct_over(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, b) * 100


def replay_trades(recorded: DataFrame, bars: DataFrame, model: str = "same_bar_close", slippage_bps: float = 0) -> DataFrame:
    """recorded (trade_id, symbol, side, entry_ts, exit_ts) with fill prices of the model and pnl_pct, side-aware."""
    t = attach_fills(recorded.withColumn("minute_ts", F.col("entry_ts")), bars, model).withColumnRenamed("base_price", "_in").drop("fill_ts", "expired", "minute_ts")
    t = attach_fills(t.withColumn("minute_ts", F.col("exit_ts")), bars, model).withColumnRenamed("base_price", "_out").drop("fill_ts", "expired", "minute_ts")
    t = t.withColumn("entry_fill_price", fill_price(F.col("side"), F.lit("open"), F.col("_in"), slippage_bps)).withColumn("exit_fill_price", fill_price(F.col("side"), F.lit("close"), F.col("_out"), slippage_bps)).drop("_in", "_out")
    return t.withColumn("pnl_pct", pnl_pct())


def pnl_pct() -> Column:
    gain = F.when(F.col("side") == "short", F.col("entry_fill_price") - F.col("exit_fill_price")).otherwise(F.col("exit_fill_price") - F.col("entry_fill_price"))
    return F.try_divide(gain, F.col("entry_fill_price")) * 100


def equity_curve(trades: DataFrame, bars: DataFrame, fee_bps: float = 0, span: int | None = None) -> DataFrame:
    """(run_id, symbol, seq, bar_ts, equity) of fixed-size trades (run_id, symbol, side, entry_bar, exit_bar, entry_price, exit_price, size):
    cash and the open positions at each close, as running sums of what each bar changes; trades of a run and symbol may overlap.
    span: bars of a piece, for symbols too long for one task; see pieces.running()."""
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    ends = [F.struct(F.col("entry_bar").alias("bar_index"), (-sign * F.col("size") * F.col("entry_price") - fee(F.col("size") * F.col("entry_price"), fee_bps)).alias("cash"), (sign * F.col("size")).alias("units")), F.struct(F.col("exit_bar").alias("bar_index"), (sign * F.col("size") * F.col("exit_price") - fee(F.col("size") * F.col("exit_price"), fee_bps)).alias("cash"), (-sign * F.col("size")).alias("units"))]
    moves = trades.select("run_id", "symbol", F.explode(F.array(*ends)).alias("m")).groupBy("run_id", "symbol", "m.bar_index").agg(F.sum("m.cash").alias("cash"), F.sum("m.units").alias("units"))
    runs = trades.select("run_id", "symbol").distinct()
    rows = bars.select("symbol", "bar_index", "minute_ts", "close").join(runs, "symbol").join(moves, ["run_id", "symbol", "bar_index"], "left")
    rows = running(rows, {"_cash": ("sum", F.col("cash")), "_units": ("sum", F.col("units"))}, ["run_id", "symbol"], "bar_index", span)
    cash, units = F.coalesce("_cash", F.lit(0.0)), F.coalesce("_units", F.lit(0.0))
    return rows.select("run_id", "symbol", F.col("bar_index").alias("seq"), F.col("minute_ts").alias("bar_ts"), (INITIAL + cash + units * F.col("close")).alias("equity"))


def portfolio_equity(curves: DataFrame, initial: float = INITIAL, span: int | None = None) -> DataFrame:
    """(run_id, bar_ts, seq, equity): at each time of any symbol the sum of all symbols' last equities, `initial` before a symbol's first.
    Summed as changes, so symbols x times are never laid out. span: a stretch of bar_ts that makes a piece of a run."""
    d = running(curves, {"_before": ("lag", F.col("equity"))}, ["run_id", "symbol"], "bar_ts", span, ["seq"])
    d = d.withColumn("delta", F.col("equity") - F.coalesce("_before", F.lit(initial))).groupBy("run_id", "bar_ts").agg(F.sum("delta").alias("delta"))
    n = curves.groupBy("run_id").agg(F.count_distinct("symbol").alias("n"))
    d = running(d, {"_seq": ("count", F.lit(1)), "_sum": ("sum", F.col("delta"))}, ["run_id"], "bar_ts", span)
    return d.join(n, "run_id").select("run_id", "bar_ts", (F.col("_seq") - 1).alias("seq"), (F.col("_sum") + initial * F.col("n")).alias("equity"))


def merge_run_tables(df: DataFrame, key: str, span: int | None = None) -> DataFrame:
    """One run table of per-symbol ones: position by key, a number, then by the order in which symbols were asked for, then by the original order.
    span: a stretch of key that makes a piece of a run too large for one task."""
    return running(df, {"position": ("count", F.lit(1))}, ["run_id"], key, span, ["symbol_pos", "seq"]).withColumn("position", F.col("position") - 1)


def compare_metrics(base: DataFrame, variant: DataFrame) -> DataFrame:
    """(pair, metric, base, variant, delta) of metrics both sides have; inputs are long (pair, metric, value)."""
    return base.select("pair", "metric", F.col("value").alias("base")).join(variant.select("pair", "metric", F.col("value").alias("variant")), ["pair", "metric"]).withColumn("delta", F.col("variant") - F.col("base"))


def outcome_changed(base: DataFrame, variant: DataFrame) -> DataFrame:
    """(pair, changed): the trades (pair, ordinal, close_reason, exit_bar_index, realized_pnl) differ in number or in any of these."""
    side = lambda d, p: d.select("pair", "ordinal", F.struct("close_reason", "exit_bar_index", "realized_pnl").alias(p))
    j = side(base, "a").join(side(variant, "b"), ["pair", "ordinal"], "full")
    return j.groupBy("pair").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


