"""Tape, indicators, state machine: fixtures and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import reconcile as rc
from barloom.operators import recurrence as rec
from barloom.operators import research as rs
from barloom.operators import tape
from barloom.sources import rows as src

M = 60_000


def bars(spark, closes, highs=None, lows=None):
    return spark.createDataFrame([("d", "S", i * M, float(c), float(h), float(lo), float(c), 1.0) for i, (c, h, lo) in enumerate(zip(closes, highs or closes, lows or closes, strict=True))], "dataset string, symbol string, minute_ts long, open double, high double, low double, close double, volume double")


def column(df, c):
    return [r[0] for r in df.orderBy("minute_ts").select(c).collect()]


def test_funding_states(spark):
    rate = [0.1, 0.1, None, None, 0.1, 0.2]
    d = spark.createDataFrame([("d", "S", i * M if i < 3 else (i + 60) * M, r is not None, r) for i, r in enumerate(rate)], "dataset string, symbol string, minute_ts long, has_funding boolean, funding_rate double")
    assert column(tape.funding_as_of(d), "funding_state") == ["present", "present", "stale", "missing", "present", "present"]
    late = d.where("minute_ts <> 120000")
    assert column(tape.funding_as_of(late, M), "funding_state") == ["present", "present", "missing", "present", "present"]
    assert [r.minute_ts // M for r in tape.funding_change_points(d).orderBy("minute_ts").collect()] == [0, 64, 65]


def test_window_complete(spark):
    d = spark.createDataFrame([("d", s, float(t * M)) for s, ts in {"full": range(10), "hole": [0, 1, 2, 4, 5, 6, 7, 8, 9], "late": range(3, 10), "extra": [x / 2 for x in range(20)]}.items() for t in ts], "dataset string, symbol string, minute_ts double").withColumn("minute_ts", F.col("minute_ts").cast("long"))
    got = {r.symbol: r.complete for r in tape.window_complete(d, 2 * M, 8 * M, M).collect()}
    assert got == {"full": True, "hole": False, "late": False, "extra": False}


def test_validate(spark):
    good = ("S", M, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5.0, True)
    bad = [("S", M + 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None, False), ("s", M, 1.0, 1.0, 1.0, float("nan"), 1.0, 1.0, None, True)]
    d = spark.createDataFrame([good, *bad], "symbol string, minute_ts long, open double, high double, low double, close double, volume double, turnover double, oi_total_usd double, has_oi boolean")
    ok, rejected = src.validate_rows(d)
    assert ok.count() == 1 and sorted(tuple(r.reasons) for r in rejected.collect()) == [("close_not_finite", "oi_total_usd_against_flag", "symbol_form"), ("minute_not_aligned",)]
    with pytest.raises(ValueError):
        src.validate_rows(d.withColumn("pnl", F.lit(1)))


def test_fingerprint_sees_any_change(spark):
    d = bars(spark, [1, 2, 3])
    a, b = (src.dataset_fingerprint(x).first()["fingerprint"] for x in (d.repartition(3), d.withColumn("close", F.when(F.col("minute_ts") == M, F.col("close") + 1e-12).otherwise(F.col("close")))))
    assert a == src.dataset_fingerprint(d).first()["fingerprint"] and a != b


def test_indicator_vectors(spark):
    assert column(bars(spark, [1, 2, 3]).withColumn("x", ind.sma(3)), "x") == [None, None, 2.0]
    flat = bars(spark, [5] * 6)
    assert column(ind.stochastic(flat, 2, 2, 1), "stochastic")[-1].asDict() == {"k": 50.0, "d": 50.0}
    up = bars(spark, range(1, 9), [c + 0.5 for c in range(1, 9)], [c - 0.5 for c in range(1, 9)])
    got = column(ind.adx(up, 2), "adx")
    assert got[:2] == [None, None] and got[2:] == pytest.approx([100.0] * 6)
    assert column(ind.adx(flat, 2), "adx")[-1] == 0
    assert column(ind.rsi(up, 3), "rsi")[-1] == 100 and column(ind.rsi(flat, 3), "rsi")[-1] == 100


@pytest.mark.parametrize(("period", "n"), [(1, 50), (2, 1200), (7, 3000), (200, 900)])
def test_recurrence_over_blocks(spark, period, n):
    x = np.random.default_rng(1).normal(10, 2, n)
    x[n // 2 :] *= 1e-6  # what lies before must not drown what comes after
    got = column(ind.ema(bars(spark, x), period), "ema")
    y, want = x[:period].mean(), [None] * (period - 1)
    want.append(y)
    for v in x[period:]:
        y += (v - y) * 2 / (period + 1)
        want.append(y)
    assert got[: period - 1] == want[: period - 1] and got[period - 1 :] == pytest.approx(want[period - 1 :], rel=1e-9)


def test_recurrence_skips_nulls(spark):
    x = [None, None, 1.0, 2.0, 3.0] + [float(i % 5) for i in range(400)]
    holes = [v if i % 7 or i < 5 else None for i, v in enumerate(x)]
    d = spark.createDataFrame([("d", "S", i * M, v) for i, v in enumerate(holes)], "dataset string, symbol string, minute_ts long, x double")
    got = column(rec.linear_recurrences(d, [rec.rma("y", "x", 2)]), "y")
    y, seen, want = None, [], []
    for v in holes:
        if v is not None:
            seen.append(v)
            y = sum(seen) / 2 if len(seen) == 2 else 0.5 * y + 0.5 * v if len(seen) > 2 else None
        want.append(y)
    assert got == pytest.approx(want)


def test_no_look_ahead(spark):
    x = list(np.random.default_rng(2).normal(10, 2, 60))
    both = [column(ind.indicator_requests(bars(spark, x[:n]), [{"name": "rsi"}, {"name": "macd"}]).withColumn("v", F.to_json(F.struct("`rsi|period=14|close`", "`macd|fast=12,signal=9,slow=26|close`"))), "v") for n in (60, 45)]
    assert both[0][:45] == both[1]


def test_request_issues():
    assert ind.validate_requests([{"name": "nope"}, {"name": "macd", "params": {"fast": 30}}, {"name": "sma", "params": {"period": 0}, "source": "x"}]) == [("requests[0].name", "unsupported_indicator"), ("requests[1].params", "fast_not_below_slow"), ("requests[2].params.period", "invalid_param"), ("requests[2].source", "unsupported_source")]


def test_novelty(spark):
    d = lambda r, xs: [(r, "k", f"2024-01-{i + 1:02d}", float(x)) for i, x in enumerate(xs)]
    rows = d("a", [1, 2, 3, 5]) + d("b", [1, 2, 3, 5]) + d("c", [-1, -2, -3, -5]) + d("e", [1])
    x = spark.createDataFrame(rows, "run_id string, key string, day string, delta double")
    got = {r.run_id: (r.status, r.score, r.nearest, r.duplicate) for r in rs.novelty(x, x, 0.95, 3).collect()}
    assert got["a"] == ("resolved", 0.0, "b", True) and got["c"] == ("resolved", 0.0, "a", True) and got["e"][0] == "empty_candidate"
    blocks = {r.run_id: (r.nearest, abs(r.rho)) for r in rs.novelty_blocks(x, 3, block=2).collect()}
    assert blocks["a"] == ("b", 1.0) and blocks["c"] == ("a", 1.0)


def test_reconcile_ambiguous(spark):
    t = spark.createDataFrame([("S", "long", M, 2 * M, "tp", 1.0)] * 2, "symbol string, side string, entry_ts long, exit_ts long, close_reason string, pnl_pct double")
    assert [r.status for r in rc.reconcile_trades(t, t.limit(1), bars(spark, [1, 2, 3]).withColumn("symbol", F.lit("S"))).collect()] == ["ambiguous"]


def test_fingerprint_tells_null_and_separators(spark):
    d = spark.createDataFrame([("d", "S", M, "a|b", None), ("d", "T", M, "null", "x")], "dataset string, symbol string, minute_ts long, p string, q string")
    prints = {src.dataset_fingerprint(x).first()["fingerprint"] for x in (d, d.withColumn("p", F.when(F.col("p") == "null", F.lit(None)).otherwise(F.col("p"))), d.withColumn("p", F.lit("a")).withColumn("q", F.lit("b|x")), d.withColumn("q", F.coalesce("q", F.lit("null"))))}
    assert len(prints) == 4


def test_written_runs(spark, tmp_path):
    d = spark.createDataFrame([(f"r{i % 5}", i, float(i)) for i in range(40)], "run_id string, seq long, equity double")
    src.write_runs(d, str(tmp_path / "runs"), 3)
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted(map(tuple, back.select("run_id", "seq", "equity").collect())) == sorted(map(tuple, d.collect())) and back.select("run_bucket").distinct().count() <= 3
    src.write_json(d, str(tmp_path / "json"))
    assert spark.read.schema(d.schema).json(str(tmp_path / "json")).count() == 40


def test_walk_forward_takes_a_signal(spark):
    d = bars(spark, [1, 2, 3, 4, 5, 4, 3, 2, 3, 4, 5, 6])
    folds = rs.walk_forward_folds(spark.createDataFrame([("d", 0, 12 * M)], "run_id string, ts_from long, ts_to long"), 2, "rolling")
    mine = rs.walk_forward_run(d, folds, F.col("close") > F.lag("close").over(tape.grid()))
    plain = rs.walk_forward_run(d, folds)
    assert {(r.fold, r.entry_ts // M) for r in mine.collect()} == {(0, 4), (1, 8), (1, 9), (1, 10), (1, 11)}
    assert {(r.fold, r.entry_ts // M) for r in plain.collect()} == {(0, 4), (0, 5), (1, 9), (1, 10), (1, 11)}


def test_correlation_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", "k", f"2024-01-{d + 1:02d}", float(rng.normal())) for i in range(12) for d in range(20) if rng.random() < 0.8]
    x = spark.createDataFrame(rows, "run_id string, key string, day string, delta double")
    one, many = ({(r.a_run, r.b_run): (r.overlap, r.rho) for r in rs.pnl_correlation(x, x, 3, block).collect()} for block in (512, 3))
    assert one == many and len(one) == 132
    by = {}
    for r, _, d, v in rows:
        by.setdefault(r, {})[d] = v
    for (a, b), (n, rho) in one.items():
        shared = sorted(by[a].keys() & by[b].keys())
        assert n == len(shared) and rho == pytest.approx(np.corrcoef([by[a][d] for d in shared], [by[b][d] for d in shared])[0, 1], abs=1e-7)
    near = {r.run_id: r.nearest for r in rs.novelty_blocks(x, 3, 3).collect()}
    assert near == {a: min((-abs(rho), b) for (c, b), (_, rho) in one.items() if c == a)[1] for a in by}
