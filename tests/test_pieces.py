"""Windows in pieces equal windows over whole keys, one key spreads over many tasks, and searches in blocks equal a look at every bar."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import pieces
from barloom.operators import recurrence as rec
from barloom.operators import research as rs
from barloom.operators import signals as sig
from barloom.operators import simulate as sim
from barloom.operators import tape
from barloom.sources import rows as src

M = 60_000
KEYS = ["dataset", "symbol"]


@pytest.fixture(scope="module")
def bars(spark):
    """A long symbol with gaps in time and in a column, one with two bars and one with a few; prices on a grid, so that ties occur."""
    rng = np.random.default_rng(4)
    rows = []
    for s, n in (("A", 3000), ("B", 2), ("C", 25)):
        close, at = 50 + np.round(np.cumsum(rng.normal(size=n)) * 2) / 2, np.cumsum(rng.choice([1, 1, 1, 2, 40], n))
        for i in range(n):
            rows.append(("d", s, int(at[i]) * M, float(close[i]), float(close[i] + rng.integers(0, 3)), float(close[i] - rng.integers(0, 3)), float(close[i]), float(i % 7), bool(i % 5), float(i % 3) if i % 5 else None, None if i % 11 == 3 else float(close[i])))
    return spark.createDataFrame(rows, "dataset string, symbol string, minute_ts long, open double, high double, low double, close double, volume double, has_funding boolean, funding_rate double, gap double").repartition(3).cache()


def same(got, want, columns, keys=("symbol", "minute_ts")):
    a, b = (d.select(*keys, *columns).toPandas().sort_values(list(keys)).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("span", [7 * M, 500 * M, 10**12])
def test_running(bars, span):
    values = {"n": ("count", F.col("gap")), "s": ("sum", F.col("gap")), "hi": ("max", F.col("gap")), "lo": ("min", F.col("gap")), "new": ("last", F.col("gap")), "was": ("lag", F.col("gap")), "m": ("moments", F.col("gap"))}
    got = pieces.running(bars, values, KEYS, "minute_ts", span).withColumn("v", pieces.var_samp(F.col("m")))
    w = Window.partitionBy(*KEYS).orderBy("minute_ts")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    g = F.col("gap")
    want = bars.withColumns({"n": F.count(g).over(u), "s": F.sum(g).over(u), "hi": F.max(g).over(u), "lo": F.min(g).over(u), "new": F.last(g, ignorenulls=True).over(u), "was": F.lag(g).over(w), "v": F.var_samp(g).over(u)})
    same(got, want, ["n", "s", "hi", "lo", "new", "was", "v"])
    same(pieces.running(bars, values, KEYS, "minute_ts", None).withColumn("v", pieces.var_samp(F.col("m"))), want, ["n", "s", "hi", "lo", "new", "was", "v"])
    assert pieces.running(bars.limit(0), values, KEYS, "minute_ts", span).count() == 0


def test_running_with_ties_and_one_exchange(spark, bars):
    d = spark.createDataFrame([("n", 5, "b", 1.0), ("n", 5, "a", 2.0), ("k", 9, "a", 4.0), ("n", 90, "a", 8.0)], "k string, t long, u string, x double")
    got = pieces.running(d, {"s": ("sum", F.col("x"))}, ["k"], "t", 10, ["u"])
    assert sorted(tuple(r) for r in got.select("k", "t", "u", "s").collect()) == [("k", 9, "a", 4.0), ("n", 5, "a", 2.0), ("n", 5, "b", 3.0), ("n", 90, "a", 11.0)]
    whole = pieces.running(d.unionByName(d.limit(1).withColumn("k", F.lit(None).cast("string"))), {"s": ("sum", F.col("x"))}, ["k"], "t", None, ["u"])
    assert whole.count() == 5
    chain = pieces.cut(bars.drop("gap"), "minute_ts", 7 * M)
    for name, kind in (("a", "sum"), ("b", "lag"), ("c", "last")):
        chain = pieces.running(chain, {name: (kind, F.col("close"))}, KEYS, "minute_ts", 7 * M)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = chain._jdf.queryExecution().executedPlan().toString()
        rows = [line for line in plan.splitlines() if "hashpartitioning(dataset" in line and "_piece" in line]
        assert len(rows) <= 1 + 2 * 3  # the rows once for all calls, and for each call its totals and what they carry, a row for each piece
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def scalar(x, r):
    out, n, total, y = [], 0, 0.0, None
    for v in x:
        if v == v and v is not None:
            n += 1
            if n <= r.n:
                total += v
                y = total / (r.n if r.seed == "mean" else 1)
            else:
                y = r.a * y + r.b * v
        out.append(y if n >= r.n else None)
    return out


@pytest.mark.parametrize("span", [None, 9 * M, 1000 * M])
def test_recurrences(bars, span):
    specs = [rec.ema("e", "gap", 20), rec.rma("r", "close", 14, "close"), rec.wilder_sum("w", "open", 14, "close"), rec.ema("one", "gap", 1), rec.ema("two", "close", 2)]
    got = rec.linear_recurrences(bars, specs, span).toPandas().sort_values(["symbol", "minute_ts"])
    for r in specs:
        want = got.groupby("symbol")[r.x].transform(lambda x, r=r: pd.Series(scalar(list(x), r), index=x.index, dtype=float))
        np.testing.assert_allclose(got[r.out].to_numpy(float), want.to_numpy(float), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("name", ["ema", "rsi", "atr", "adx"])
def test_indicators_in_pieces(bars, name):
    f = getattr(ind, name)
    same(f(bars, span=77 * M), f(bars), [name])


def test_frames_in_pieces(bars):
    def make(b):
        b = b.withColumns({"sma": ind.sma(10), "mid": ind.bollinger(20)["middle"], "up": sig.momentum_signal(), "pump": sig.pump_signal(3, 5)})
        b = sig.dump_high_to_low(ind.stochastic(tape.closed_candles(b, 4), 14, 3, 3), 10, 1, 0)
        return b.withColumns({"k": F.col("stochastic.k"), "d": F.col("stochastic.d"), "n": F.size("closed"), "low_ts": F.col("dump.low_ts"), "next": F.lead("close", 2).over(tape.grid())})

    columns = ["sma", "mid", "up", "pump", "k", "d", "n", "low_ts", "next"]
    for rows in (5, 64):  # pieces shorter than the frame, and longer
        same(pieces.in_pieces(bars, make, 19, 2, rows), make(bars), columns)
    assert pieces.in_pieces(bars.limit(0), make, 19, 2, 5).count() == 0


def test_one_symbol_spreads(spark):
    one = spark.range(40_000).select(F.lit("d").alias("dataset"), F.lit("S").alias("symbol"), (F.col("id") * M).alias("minute_ts"), *(F.sin(F.col("id") / n).alias(c) for n, c in ((7, "open"), (5, "high"), (3, "low"), (9, "close"))), F.lit(1.0).alias("volume"))
    span = pieces.piece_span(one, KEYS, "minute_ts", 1000)
    assert 990 * M <= span <= 1000 * M
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (ind.rsi(one, span=span), tape.bar_index(one), pieces.in_pieces(one, lambda b: b.withColumn("m", ind.sma(20)), 19, rows=1000, span=span)):
            made = out.columns[-1]  # read, so that its window is not pruned
            tasks = {r[0]: r[1] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*"), F.max(made)).collect()}
            spread = "bar_index" not in out.columns
            assert (len(tasks) > 1) == spread and sum(tasks.values()) == 40_000
            assert not spread or max(tasks.values()) < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_first_touch_equals_every_bar(spark):
    rng = np.random.default_rng(7)
    n = 120_000
    price = 100 + np.cumsum(rng.normal(size=n)) * 0.05
    low, high = price - rng.random(n), price + rng.random(n)
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "S", "bar_index": np.arange(n), "open": price, "low": low, "high": high}))
    trades = []
    for i in range(60):
        a = int(rng.integers(0, n))
        z = min(n - 1, a + int(rng.choice([0, 1, 5, 127, 128, 129, 5000, 110_000])))
        away = float(rng.choice([0.5, 3, 30, 300]))
        trades.append((i, "S", a, z, float(price[a] - away), float(price[a] + away)))
    trades += [(100, "S", 0, n - 1, None, None), (101, "other", 0, 10, 1e9, 0.0), (102, "S", 5, 4, 1e9, 0.0), (103, "S", 0, n + 500, -1e9, 1e9), (104, "S", 10, 20, 1e9, None)]
    d = spark.createDataFrame(trades, "trade_id long, symbol string, first_bar long, last_bar long, below double, above double")
    want = {}
    for i, s, a, z, below, above in trades:
        hit = np.zeros(max(min(z, n - 1) - a + 1, 0), bool)
        if s == "S" and below is not None:
            hit |= low[a : z + 1] <= below
        if s == "S" and above is not None:
            hit |= high[a : z + 1] >= above
        if hit.any():
            want[i] = a + int(hit.argmax())
    for fan, levels in ((128, 3), (4, 2), (16, 5)):
        assert {r.trade_id: r.bar_index for r in sim.first_touch(d, bars, fan, levels).collect()} == want
    assert sim.first_touch(d.limit(0), bars).count() == 0 and sim.first_touch(d, bars.limit(0)).count() == 0


def test_held_bars_are_no_rows(spark):
    """A trade over 100,000 bars is a dozen rows at most on the way to its first touch, and two to its funding."""
    bars = spark.range(100_001).select(F.lit("d").alias("dataset"), F.lit("S").alias("symbol"), F.col("id").alias("bar_index"), (F.col("id") * M).alias("minute_ts"), F.lit(1.0).alias("open"), F.lit(1.0).alias("low"), F.lit(1.0).alias("high"), F.lit(2.0).alias("close"), (F.col("id") % 2 == 0).alias("has_funding"), F.when(F.col("id") % 2 == 0, 480.0).alias("funding_rate"))
    trades = spark.createDataFrame([("t", "S", "long", 0, 100_000, 1.0, 0.5, 0.5, 3.0), ("u", "S", "short", 10, 11, 1.0, 0.5, 0.5, 3.0), ("v", "none", "long", 0, 9, 1.0, 0.5, 0.5, 3.0)], "trade_id string, symbol string, side string, entry_bar long, exit_bar long, entry_price double, stop double, take double, size double")
    assert all(r.hit_bar is None and r.hit_kind is None for r in sim.protection_hits(trades, bars).collect())
    # bars without funding are stale for a minute, so every bar pays 1 a unit and minute
    got = {r.trade_id: (r.funding, r.covered_bars) for r in sim.funding_accrual(trades, bars, 1, span=1000).collect()}
    assert got == {"t": (600_000.0, 100_000), "u": (-6.0, 1), "v": (0.0, 0)}
    assert {r.trade_id: r.fraction for r in sim.funding_fraction(trades, bars).collect()} == {"t": 50_001.0, "u": -1.0, "v": 0.0}
    for df in (sim.funding_accrual(trades, bars, 1), sim.protection_hits(trades, bars)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("piece", [1, 37, 10**6])
def test_page(bars, piece):
    want = [(r.symbol, r.minute_ts) for r in bars.orderBy("symbol", "minute_ts").collect()]
    for offset, limit in ((0, 5), (995, 20), (2999, 4), (3020, 50), (5000, 3), (7, 0)):
        assert [(r.symbol, r.minute_ts) for r in src.page(bars, offset, limit, piece).collect()] == want[offset : offset + limit]
    assert src.page(bars.limit(0), 3, 4, piece).count() == 0


def test_tiers(spark):
    tiers = spark.createDataFrame([("b", 2880), ("a", 2880), ("tiny", 10), ("big", 500_000_000), ("none", None)], "tier string, common_present_minutes long")
    req = spark.createDataFrame([(1, 2), (2, 3), (3, 0), (4, 10**6), (5, None), (6, 2)], "request_id long, days long")
    for span in (60, 365 * 1440):
        assert {r.request_id: r.tier for r in rs.smallest_sufficient_tier(tiers, req, span).collect()} == {1: "a", 2: "big", 3: "tiny", 4: None, 5: None, 6: "a"}
    plan = rs.smallest_sufficient_tier(tiers, req)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
