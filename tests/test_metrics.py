"""Hand-computed vectors."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars as f
from barloom.functions.scalars import YEAR_MS
from barloom.operators import metrics as m
from barloom.operators import research as r
from barloom.operators import simulate as s


def one(df):
    return df.first().asDict()


def equity(spark, values, step=int(2 * YEAR_MS / 4)):
    return spark.createDataFrame([("r", i, i * step, float(v)) for i, v in enumerate(values)], "run_id string, seq long, bar_ts long, equity double")


def test_equity_vector(spark):
    got = one(m.equity_metrics(equity(spark, [100, 120, 108, 129.6, 116.64])))
    want = {"sharpe": 1 / 3, "sortino": 0.70710678, "returns_stddev": 0.15, "returns_skew": 0, "returns_kurtosis": 1, "returns_count": 4, "cagr": 0.08, "calmar": 0.8, "pnl": 16.64, "max_drawdown": 0.1, "elapsed_years": 2}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-8)


def test_degenerate_equity(spark):
    got = one(m.equity_metrics(equity(spark, [100])))
    assert got["returns_count"] == 0 and got["sharpe"] == 0 and got["cagr"] is None and got["calmar"] is None
    got = one(m.equity_metrics(equity(spark, [0, 10, 20])))
    assert got["returns_count"] == 0 and got["returns_stddev"] == 0
    assert one(m.equity_metrics(equity(spark, [1, 2, 3])))["calmar"] is None


def test_trade_vector(spark):
    t = spark.createDataFrame([("r", x) for x in (30.0, -10.0, 30.0, -10.0)], "run_id string, realized_pnl double")
    got = one(m.trade_metrics(t))
    assert got == pytest.approx({"run_id": "r", "win_rate": 0.5, "total_trades": 4, "profit_factor": 3, "top_trade_contribution_pct": 50, "expectancy": 10, "sqn": 1}) or got["sqn"] == pytest.approx(1)
    assert one(m.trade_metrics(t.where("realized_pnl > 0")))["profit_factor"] is None


def test_daily_deltas(spark):
    day = 86_400_000
    e = spark.createDataFrame([("r", 0, 0, 100.0), ("r", 1, 5, 110.0), ("r", 2, day, 105.0), ("r", 3, 4 * day, 130.0)], "run_id string, seq long, bar_ts long, equity double")
    assert [(x.day, x.delta) for x in m.daily_pnl_deltas(e).orderBy("day").collect()] == [("1970-01-02", -5.0), ("1970-01-05", 25.0)]


def test_portfolio_carries_forward(spark):
    c = spark.createDataFrame([("r", "a", 0, 1, 10_100.0), ("r", "a", 1, 3, 9_800.0), ("r", "b", 0, 2, 10_000.0), ("r", "b", 1, 3, 9_900.0)], "run_id string, symbol string, seq long, bar_ts long, equity double")
    assert [x.equity for x in s.portfolio_equity(c).orderBy("bar_ts").collect()] == [20_100.0, 20_100.0, 19_700.0]


def test_deflated_sharpe(spark):
    t = spark.createDataFrame([("f", "a", 1.0, 0.0, 3.0, 100, 1)], "family_key string, run_id string, sharpe double, skew double, kurtosis double, t_count long, created_at long")
    got = one(r.deflated_sharpe(t))
    assert got["sr0"] == 0 and got["basis"] == "asymptotic" and got["v_sr"] == pytest.approx(0.015)
    two = t.unionByName(t.withColumn("run_id", F.lit("b")).withColumn("sharpe", F.lit(1.0 + 2**0.5)))
    assert r.deflated_sharpe(two, 2).first()["sr0"] == pytest.approx(0.5196, abs=1e-3)
    assert one(r.deflated_sharpe(t.withColumn("t_count", F.lit(1))))["dsr"] is None


def test_normal(spark):
    d = spark.range(1)
    for p, z in ((0.5, 0), (0.975, 1.959964), (0.01, -2.326348), (0.99, 2.326348)):
        assert d.select(f.normal_inv_cdf(F.lit(p))).first()[0] == pytest.approx(z, abs=1e-6)
    assert d.select(f.normal_cdf(F.lit(1.959964))).first()[0] == pytest.approx(0.975, abs=1e-6)
    assert d.select(f.normal_inv_cdf(F.lit(1.0))).first()[0] is None


def test_scalars(spark):
    d = spark.createDataFrame([("1m", 60_000), ("2h", 7_200_000), ("3d", 259_200_000), ("1w", 604_800_000), ("15s", 15_000), ("1M", None), ("1y", None), ("1.5h", None), ("0m", None), ("1h30m", None), ("", None), ("m", None), (" 1m", None)], "tf string, ms long")
    assert d.where(~f.parse_timeframe("tf").eqNullSafe(F.col("ms"))).count() == 0
    side, action = F.lit("long"), F.lit("open")
    got = spark.range(1).select(f.fill_price(side, action, F.lit(100.0), 5), f.fill_price(side, F.lit("close"), F.lit(100.0), 5), f.fee(F.lit(1000.0), 5), f.quantize(F.lit(-0.0)), *f.protection_levels(F.lit(100.0), side, F.lit(0.05), F.lit(0.1))).first()
    assert list(got) == pytest.approx([100.05, 99.95, 0.5, 0, 95, 110])


def test_protection(spark):
    bars = spark.createDataFrame([("s", 0, 100.0, 101.0, 99.0), ("s", 1, 93.0, 120.0, 92.0)], "symbol string, bar_index long, open double, high double, low double")
    t = spark.createDataFrame([("t", "s", "long", 0, 1, 100.0, 0.05, 0.1)], "trade_id string, symbol string, side string, entry_bar long, exit_bar long, entry_price double, stop double, take double")
    got = one(s.protection_hits(t, bars))
    assert (got["hit_bar"], got["hit_kind"], got["hit_price"]) == (1, "stop", 93.0)


def test_custom_metric(spark):
    t = spark.createDataFrame([("r", x) for x in (30.0, -10.0)], "run_id string, realized_pnl double")
    got = one(m.run_metrics(equity(spark, [100, 120]), t, ["pnl"], custom={"best": F.max("realized_pnl")}))
    assert got == {"run_id": "r", "pnl": 20.0, "best": 30.0}
