"""Reconciliation of two trade lists, differences of artefacts, and what realism costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_close_reason, trade_key
from .pieces import running

IDENTITY = r"(?i)(ts|index|count|seed|processed|length|version)(\[\d+\])?$"


def floor_closes(points: DataFrame, rows: DataFrame, span: int | None = None) -> DataFrame:
    """points (point_id, symbol, ts) with floor_ts and floor_close of the last row at or before ts: a union and one running value, no range join. span: see pieces.running()."""
    p = points.select("symbol", "ts", F.lit(1).alias("o"), "point_id", F.lit(None).cast("struct<ts:bigint,close:double>").alias("r"))
    r = rows.select("symbol", F.col("minute_ts").alias("ts"), F.lit(0).alias("o"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.struct(F.col("minute_ts").alias("ts"), "close").alias("r"))
    both = running(p.unionByName(r), {"f": ("last", F.col("r"))}, ["symbol"], "ts", span, ["o"])
    return both.where("o = 1").select("point_id", "symbol", "ts", F.col("f.ts").alias("floor_ts"), F.col("f.close").alias("floor_close"))


def close_to_close_pnl(trades: DataFrame, rows: DataFrame, span: int | None = None, divide: Callable[[Column, Column], Column] = F.try_divide) -> DataFrame:
    """trades (trade_id, symbol, side, entry_ts, exit_ts) with c2c_pct; NULL if a floor row is missing or both are one minute though the times differ. divide says what a close of 0 gives, NULL at first."""
    ends = trades.select("trade_id", "symbol", F.explode(F.array(F.struct(F.lit("in").alias("e"), F.col("entry_ts").alias("ts")), F.struct(F.lit("out").alias("e"), F.col("exit_ts").alias("ts")))).alias("x"))
    f = floor_closes(ends.select(F.struct("trade_id", "x.e").alias("point_id"), "symbol", "x.ts"), rows, span)
    pick = lambda e, c: F.max(F.when(F.col("point_id.e") == e, F.col(c)))
    per = f.groupBy(F.col("point_id.trade_id").alias("trade_id")).agg(pick("in", "floor_ts").alias("a"), pick("in", "floor_close").alias("ca"), pick("out", "floor_ts").alias("b"), pick("out", "floor_close").alias("cb"))
    gain = F.when(F.col("side") == "short", F.col("ca") - F.col("cb")).otherwise(F.col("cb") - F.col("ca"))
    lost = (F.col("entry_ts") != F.col("exit_ts")) & (F.col("a") == F.col("b"))
    return trades.join(per, "trade_id", "left").withColumn("c2c_pct", F.when(~lost, divide(gain, F.col("ca")) * 100)).drop("a", "b", "ca", "cb")


def reconcile_trades(paper: DataFrame, backtest: DataFrame, rows: DataFrame, tol: float = 1e-3) -> DataFrame:
    """(trade_key, status, pnl_delta) over both lists (symbol, side, entry_ts, exit_ts, close_reason, pnl_pct)."""
    def side(d: DataFrame, p: str) -> DataFrame:
        return d.groupBy(trade_key("symbol", "entry_ts", "side").alias("trade_key")).agg(F.count("*").alias(f"{p}_n"), F.min(F.struct("symbol", "side", "entry_ts", "exit_ts", "close_reason", "pnl_pct")).alias(p))

    j = side(paper, "p").join(side(backtest, "b"), "trade_key", "full")
    c2c = close_to_close_pnl(j.where("p is not null").select(F.col("trade_key").alias("trade_id"), "p.symbol", "p.side", "p.entry_ts", "p.exit_ts"), rows).select(F.col("trade_id").alias("trade_key"), "c2c_pct")
    j = j.join(c2c, "trade_key", "left")
    delta = F.col("b.pnl_pct") - F.col("p.pnl_pct")
    same = (F.col("p.exit_ts") == F.col("b.exit_ts")) & (F.col("p.close_reason") == F.col("b.close_reason")) & (F.abs(delta) <= tol)
    status = F.when((F.coalesce("p_n", F.lit(0)) > 1) | (F.coalesce("b_n", F.lit(0)) > 1), "ambiguous").when(F.col("b_n").isNull(), "paper_only").when(F.col("p_n").isNull(), "backtest_only").when(same, "matched")
    status = status.when(F.col("c2c_pct").isNull() | (F.abs(F.col("c2c_pct") - F.col("p.pnl_pct")) > tol), "data_divergent").otherwise("engine_divergent")
    both = (F.coalesce("p_n", F.lit(0)) == 1) & (F.coalesce("b_n", F.lit(0)) == 1)
    return j.select("trade_key", status.alias("status"), F.when(both, delta).alias("pnl_delta"))


def reconcile_summary(rows: DataFrame) -> DataFrame:
    kinds = ["matched", "engine_divergent", "data_divergent", "paper_only", "backtest_only", "ambiguous"]
    out = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))
    return out.withColumn("match_rate", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def _compared(before: DataFrame, after: DataFrame, expected: DataFrame | None) -> DataFrame:
    a, b = (d.select("scenario", "path", F.col("value").alias(n), F.lit(True).alias(f"has_{n}")) for d, n in ((before, "a"), (after, "b")))
    j = a.join(b, ["scenario", "path"], "full")
    x, y = F.col("a").try_cast("double"), F.col("b").try_cast("double")
    moved = F.abs(y - x)
    verdict = F.when(F.col("has_b").isNull(), "removed").when(F.col("has_a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "same").when(x.isNull() | y.isNull(), "structural").when(F.col("path").rlike(IDENTITY), "identity_moved").otherwise("numeric")
    out = j.select("scenario", "path", verdict.alias("verdict"), moved.alias("abs_delta"), F.when(x == 0, moved).otherwise(F.try_divide(moved, F.abs(x))).alias("rel_delta"), (x.isNotNull() & y.isNotNull()).alias("number"))
    if expected is not None:
        out = out.join(expected.select("path", F.lit(True).alias("_expected")).distinct(), "path", "left")
        out = out.withColumn("verdict", F.when(F.col("_expected") & F.col("verdict").isin(*BREAKS), "declared").otherwise(F.col("verdict"))).drop("_expected")
    return out


BREAKS = ("removed", "added", "structural", "identity_moved")


def artifact_diff(before: DataFrame, after: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(scenario, path, verdict, abs_delta, rel_delta) of the leaves (scenario, path, value) that differ. Numbers move; appearing, vanishing or other values break, and so do
    moved identities; a break at a path in expected (path) is `declared`."""
    return _compared(before, after, expected).where("verdict <> 'same'").drop("number")


def artifact_report(before: DataFrame, after: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(scenario, structural_breaks, numeric_moves, numbers_compared, declared, refreeze_allowed): a scenario may be frozen anew if nothing breaks but what is declared."""
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    out = _compared(before, after, expected).groupBy("scenario").agg(is_(*BREAKS).alias("structural_breaks"), is_("numeric").alias("numeric_moves"), F.count_if("number").alias("numbers_compared"), is_("declared").alias("declared"))
    return out.withColumn("refreeze_allowed", F.col("structural_breaks") == 0)


def stale_exceptions(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """(path): declared paths at which no scenario breaks."""
    seen = artifact_diff(before, after, expected).where("verdict = 'declared'").select("path")
    return expected.select("path").distinct().join(seen, "path", "left_anti")


def largest_movers(diff: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("scenario").orderBy(F.desc("rel_delta"), "path")
    return diff.where("verdict = 'numeric'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def match_trades(golden: DataFrame, generated: DataFrame, ts_from: int, ts_to: int, tol: float = 0.05) -> DataFrame:
    """(entry_ts, failure): what is wrong with each golden trade of the window, and entries beyond it. Inputs: trade_id, symbol, side, entry_ts, exit_ts, close_reason, pnl_pct."""
    keys = ["symbol", "entry_ts"]
    g = golden.where((F.col("entry_ts") >= ts_from) & (F.col("entry_ts") <= ts_to))
    m = g.select(*keys, F.struct("side", "exit_ts", "close_reason", "pnl_pct").alias("g")).join(generated.select(*keys, F.struct("side", "exit_ts", "close_reason", "pnl_pct").alias("m")), keys, "left")
    tests = [(F.col("m").isNull(), "missing"), (F.col("m.side") != F.col("g.side"), "side"), (F.col("m.exit_ts") != F.col("g.exit_ts"), "exit_bar"), (normalize_close_reason("m.close_reason") != normalize_close_reason("g.close_reason"), "close_reason"), (F.abs(F.col("m.pnl_pct") - F.col("g.pnl_pct")) > tol, "pnl")]
    failed = m.select(*keys, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)) & (F.col("m").isNotNull() if n != "missing" else F.lit(True)), n) for t, n in tests)))).alias("failure"))
    extra = generated.where((F.col("entry_ts") >= ts_from) & (F.col("entry_ts") <= ts_to)).join(golden, keys, "left_anti").select(*keys, F.lit("extra").alias("failure"))
    return failed.unionByName(extra)


#: Fields of a trade in the order in which they are compared.
FIELDS = ["symbol", "side", "entry_bar_index", "entry_ts", "entry_fill_price", "exit_bar_index", "exit_ts", "exit_fill_price", "size", "realized_pnl", "close_reason"]


def first_divergence(a: DataFrame, b: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(run_id, ordinal, field): the first trade, and in it the first field, in which two runs differ; field `count` where one list ends."""
    x = a.select("run_id", "ordinal", F.struct(*fields).alias("a"))
    y = b.select("run_id", "ordinal", F.struct(*fields).alias("b"))
    j = x.join(y, ["run_id", "ordinal"], "full")
    first: Column = F.when(F.col("a").isNull() | F.col("b").isNull(), "count")
    for f in fields:
        first = first.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f)
    return j.withColumn("field", first).where("field is not null").groupBy("run_id").agg(F.min(F.struct("ordinal", "field")).alias("d")).select("run_id", "d.ordinal", "d.field")


def realism_gap(trades: DataFrame, divide: Callable[[Column, Column], Column] = F.try_divide) -> DataFrame:
    """trades (symbol, trade_id, side, entry_base, exit_base, entry_fill_price, exit_fill_price, size, fee_paid, funding, covered_bars, held_bars) ->
    baseline, drags and gap of each, and the mean of each as row AGGREGATE. divide says what a price of 0 gives, NULL at first."""
    notional = F.col("size") * F.col("entry_fill_price")
    sign = F.when(F.col("side") == "short", -1.0).otherwise(1.0)
    base = sign * divide(F.col("exit_base") - F.col("entry_base"), F.col("entry_base")) * 100
    real = divide(sign * (F.col("exit_fill_price") - F.col("entry_fill_price")) * F.col("size") - F.col("fee_paid") - F.col("funding"), notional) * 100
    slip = F.abs(F.col("entry_fill_price") - F.col("entry_base")) + F.abs(F.col("exit_fill_price") - F.col("exit_base"))
    d = trades.select("trade_id", base.alias("baseline_pct"), (-divide(F.col("fee_paid"), notional) * 1e4).alias("fee_bps"), (-divide(slip * F.col("size"), notional) * 1e4).alias("slippage_bps"), (divide(F.col("funding"), notional) * 1e4).alias("funding_bps"), F.coalesce(F.try_divide(F.col("covered_bars"), F.col("held_bars")) * 100, F.lit(0.0)).alias("coverage_pct"), real.alias("realistic_pct"))
    d = d.withColumn("gap_bps", (F.col("realistic_pct") - F.col("baseline_pct")) * 100)
    mean = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(c)  # noqa: E731  of one value itself, as a sum would lose the sign of a zero
    out = d.rollup("trade_id").agg(*map(mean, d.columns[1:]))
    return out.withColumn("trade_id", F.coalesce("trade_id", F.lit("AGGREGATE")))
