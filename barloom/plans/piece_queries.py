"""The windows over one symbol, run or family once more, dealt over pieces of it: each query has the SQL of its plain form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import indicators as ind
from ..operators import metrics as mt
from ..operators import reconcile as rc
from ..operators import research as rs
from ..operators import signals as sig
from ..operators import simulate as sim
from ..operators import tape
from ..operators.pieces import in_pieces, piece_span
from . import run_queries as runs
from . import tape_queries as tapes
from .bars import HOUR, SQL, bars_events, fixed_trades, query, r6, runs_equity, rounded

#: Bars of a piece here; the tables have some hundred to some thousand bars for each symbol.
ROWS = 128
KEYS = ["dataset", "symbol"]


def _span(bars: DataFrame) -> int:
    return piece_span(bars, KEYS, "minute_ts", ROWS)


@query(SQL["i4_ema"])
def h1_ema_in_pieces(spark, d) -> DataFrame:
    b = bars_events(spark, d)
    return ind.ema(b, 20, span=_span(b)).select("symbol", "minute_ts", F.when(F.col("close").isNotNull(), rounded("ema", 6)).alias("ema"))


@query(SQL["i5_macd"])
def h1_macd_in_pieces(spark, d) -> DataFrame:
    b = bars_events(spark, d)
    return ind.macd(b, span=_span(b)).select("symbol", "minute_ts", *(rounded(f"macd.{c}", 6).alias(c) for c in ("macd", "signal", "histogram")))


@query(SQL["i6_rsi"])
def h1_rsi_in_pieces(spark, d) -> DataFrame:
    b = bars_events(spark, d)
    return ind.rsi(b, span=_span(b)).select("symbol", "minute_ts", *r6("rsi"))


@query(SQL["i7_atr"])
def h1_atr_in_pieces(spark, d) -> DataFrame:
    b = bars_events(spark, d)
    return ind.atr(b, span=_span(b)).select("symbol", "minute_ts", *r6("atr"))


@query(SQL["i8_adx"])
def h1_adx_in_pieces(spark, d) -> DataFrame:
    b = bars_events(spark, d)
    return ind.adx(b, span=_span(b)).select("symbol", "minute_ts", *r6("adx"))


@query(SQL["i1_sma"])
def h2_sma_in_pieces(spark, d) -> DataFrame:
    return in_pieces(bars_events(spark, d), lambda b: b.withColumn("sma", rounded(ind.sma(10), 6)), 9, rows=ROWS).select("symbol", "minute_ts", "sma")


@query(SQL["i2_bollinger"])
def h2_bollinger_in_pieces(spark, d) -> DataFrame:
    out = in_pieces(bars_events(spark, d), lambda b: b.withColumn("v", ind.bollinger()), 19, rows=ROWS)
    return out.select("symbol", "minute_ts", *(rounded(f"v.{c}", 6).alias(c) for c in ("lower", "middle", "upper")))


@query(SQL["i3_stochastic"])
def h2_stochastic_in_pieces(spark, d) -> DataFrame:
    out = in_pieces(bars_events(spark, d), lambda b: ind.stochastic(b, 14, 3, 3), 14 + 3 + 3 - 3, rows=ROWS)
    return out.select("symbol", "minute_ts", rounded("stochastic.k", 6).alias("k"), rounded("stochastic.d", 6).alias("d"))


@query(SQL["s2_pump_signal"])
def h2_pump_in_pieces(spark, d) -> DataFrame:
    return in_pieces(bars_events(spark, d), lambda b: b.withColumn("signal", sig.pump_signal(10, 5, 2)), 5, rows=ROWS).select("symbol", "minute_ts", "signal")


@query(SQL["s4_dump_high_to_low"])
def h2_dump_in_pieces(spark, d) -> DataFrame:
    out = in_pieces(bars_events(spark, d), lambda b: sig.dump_high_to_low(b, 10), 9, rows=ROWS).where("dump is not null")
    return out.select("symbol", "minute_ts", rounded("dump.drop_high_low", 6).alias("drop_high_low"), "dump.highest_ts", "dump.low_ts", rounded("dump.bounce", 6).alias("bounce"))


@query(SQL["a14_closed_candles"])
def h2_closed_candles_in_pieces(spark, d) -> DataFrame:
    b = in_pieces(bars_events(spark, d), lambda b: tape.closed_candles(b, 3), 3, rows=ROWS)
    return b.select("symbol", "minute_ts", F.size("closed").cast("long").alias("n"), F.get("closed", F.size("closed") - 1).close.alias("last_close"), F.array_max(F.transform("closed", lambda c: c.high)).alias("top"))


@query(SQL["a10_funding_as_of_cadence"])
def h3_funding_in_pieces(spark, d) -> DataFrame:
    b = bars_events(spark, d)
    return tapes._as_of_result(tape.funding_as_of(b, HOUR, _span(b)))


@query(SQL["p7_funding_accrual"])
def h3_accrual_in_pieces(spark, d) -> DataFrame:
    b = tape.bar_index(bars_events(spark, d))
    out = sim.funding_accrual(fixed_trades(spark, d).withColumn("size", F.lit(2.0)), b, 60, span=ROWS)
    return out.select("trade_id", rounded("funding", 10).alias("funding"), "covered_bars")


@query(SQL["p12_equity_curve"])
def h3_equity_in_pieces(spark, d) -> DataFrame:
    t = fixed_trades(spark, d).withColumn("size", F.lit(1.0)).withColumn("run_id", F.lit("r"))
    out = sim.equity_curve(t, tape.bar_index(bars_events(spark, d)), 10, ROWS)
    return out.select("symbol", "seq", "bar_ts", rounded("equity", 5).alias("equity"))


@query(SQL["p13_portfolio_equity"])
def h3_portfolio_in_pieces(spark, d) -> DataFrame:
    return sim.portfolio_equity(runs._curve(spark, d), span=ROWS * HOUR).select("bar_ts", "seq", rounded("equity", 6).alias("equity"))


@query(SQL["p14_merge_run_tables"])
def h3_merge_in_pieces(spark, d) -> DataFrame:
    t = fixed_trades(spark, d).withColumn("run_id", F.lit("r")).withColumn("symbol_pos", F.col("symbol")).withColumn("seq", F.col("entry_bar"))
    return sim.merge_run_tables(t, "exit_ts", ROWS * HOUR).select("trade_id", "position")


@query(SQL["m1_m17_equity_metrics"])
def h3_metrics_in_pieces(spark, d) -> DataFrame:
    return runs._metrics(mt.equity_metrics(runs_equity(spark, d), span=ROWS))


@query(SQL["d6_trial_context_as_of"])
def h3_family_in_pieces(spark, d) -> DataFrame:
    return rs.trial_context_as_of(runs._trials(spark, d), 5, 7).select("run_id", "n_trials", "basis", rounded("v_sr", 8).alias("v_sr"))


@query(SQL["v3_attempt_number"])
def h3_attempts_in_pieces(spark, d) -> DataFrame:
    return rs.attempt_number(runs._attempts(spark, d), ROWS).select(F.col("created_at").alias("c_custkey"), "attempt_no")


@query(SQL["c2_close_to_close_pnl"])
def h3_close_to_close_in_pieces(spark, d) -> DataFrame:
    t = fixed_trades(spark, d).withColumn("entry_ts", F.col("entry_ts") + 600_000).withColumn("exit_ts", F.col("exit_ts") + 600_000)
    return rc.close_to_close_pnl(t, bars_events(spark, d), ROWS * HOUR, f.ieee_divide).select("trade_id", *r6("c2c_pct"))
