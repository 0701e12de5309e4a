"""Promotion inputs read off the tape, keys, walk-forward status, declared exceptions and users' own strategies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import reconcile as rc
from barloom.operators import research as rs
from barloom.operators import simulate as sim
from barloom.operators import tape

M = 60_000


def test_windows_complete_equals_one_window(spark):
    times = {"full": range(10), "hole": [0, 1, 2, 4, 5, 6, 7, 8, 9], "late": range(3, 10), "extra": [x / 2 for x in range(20)], "left": [0, 1, 2, 3, 4, 5, 6], "odd": [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]}
    d = spark.createDataFrame([("d", s, int(t * M)) for s, ts in times.items() for t in ts], "dataset string, symbol string, minute_ts long")
    spans = [(2, 8), (0, 10), (0, 7), (1, 2), (3, 3), (-1, 4), (2, 30)]
    w = spark.createDataFrame([(f"{s}:{a}:{z}", s, a * M, z * M) for s in times for a, z in spans], "window_id string, symbol string, ts_from long, ts_to long")
    want = {f"{r.symbol}:{a}:{z}": r.complete for a, z in spans for r in tape.window_complete(d, a * M, z * M, M).collect()}
    for span in (None, 3 * M):
        assert {r.window_id: r.complete for r in tape.windows_complete(d, w, M, span).collect()} == want
    both = w.where("window_id in ('full:2:8', 'hole:2:8')").withColumn("window_id", F.lit("run"))
    assert [r.complete for r in tape.windows_complete(d, both, M).collect()] == [False]  # every symbol of a run
    none = spark.createDataFrame([("x", "unknown", 0, M)], w.schema)
    assert [r.complete for r in tape.windows_complete(d, none, M).collect()] == [False]


def test_keys(spark):
    t = spark.createDataFrame([(1, None, "m", "d", ["b", "a"], "1h", 0, 5), (2, None, "m", "d", ["a", "b"], "1h", 3, 9), (3, "h", "m", "d", ["a", "b"], "1h", 0, 5)], "id long, trial_hint string, module_id string, dataset string, symbols array<string>, timeframe string, ts_from long, ts_to long")
    k = {r.id: r for r in t.select("id", rs.promotion_family_key().alias("p"), rs.family_key().alias("f"), rs.qualification_epoch_key(rs.promotion_family_key(), F.lit("e"), F.lit("v")).alias("e"), rs.attempt_identity(F.lit("r"), F.col("id").cast("string")).alias("a")).collect()}
    assert k[1].p == k[2].p != k[3].p and k[1].f != k[2].f and k[1].e == k[2].e != k[3].e and len({r.a for r in k.values()}) == 3


def test_walk_forward_status(spark):
    folds = spark.createDataFrame([(r, i) for r in ("all", "some", "bad", "thin", "lost") for i in range(3)], "run_id string, fold int")
    m = spark.createDataFrame([("all", 0, True), ("all", 1, True), ("all", 2, True), ("some", 0, True), ("some", 1, False), ("some", 2, True), ("thin", 0, False), ("thin", 1, False), ("thin", 2, False), ("bad", 2, False)], "run_id string, fold int, sufficient boolean")
    failed = spark.createDataFrame([("some", 2, "budget_exhausted"), ("bad", 0, "runner_failure"), ("bad", 1, "runner_failure")], "run_id string, fold int, code string")
    got = {r.run_id: tuple(r)[1:] for r in rs.walk_forward_status(folds, m, failed).collect()}
    assert got == {
        "all": ("resolved", None, 3, 3, [], []),
        "some": ("partial", None, 3, 1, [1], ["2:budget_exhausted"]),
        "bad": ("unavailable", "all_folds_failed", 3, 0, [2], ["0:runner_failure", "1:runner_failure"]),
        "thin": ("unavailable", "insufficient_folds", 3, 0, [0, 1, 2], []),
        "lost": ("unavailable", "insufficient_folds", 3, 0, [0, 1, 2], []),
    }
    assert {r.status for r in rs.walk_forward_status(folds, m).where("run_id = 'all'").collect()} == {"resolved"}
    assert rs.completed_folds(m, failed).count() == 4 and rs.completed_folds(m).count() == 5


def test_declared_exceptions(spark):
    a = spark.createDataFrame([("s", "engineVersion", "1"), ("s", "x.pnl", "1.5"), ("s", "x.note", "a"), ("t", "x.pnl", "2"), ("t", "gone", "1")], "scenario string, path string, value string")
    b = spark.createDataFrame([("s", "engineVersion", "2"), ("s", "x.pnl", "1.75"), ("s", "x.note", "a"), ("t", "x.pnl", "2")], "scenario string, path string, value string")
    expected = spark.createDataFrame([("engineVersion",), ("x.pnl",), ("nowhere",)], "path string")
    report = lambda e: {r.scenario: tuple(r)[1:] for r in rc.artifact_report(a, b, e).collect()}
    assert report(None) == {"s": (1, 1, 2, 0, False), "t": (1, 0, 1, 0, False)}
    assert report(expected) == {"s": (0, 1, 2, 1, True), "t": (1, 0, 1, 0, False)}
    assert {r.path: r.verdict for r in rc.artifact_diff(a, b, expected).collect()} == {"engineVersion": "declared", "x.pnl": "numeric", "gone": "removed"}
    assert sorted(r.path for r in rc.stale_exceptions(a, b, expected).collect()) == ["nowhere", "x.pnl"]  # a move needs no declaration


def test_vector_signal(spark):
    rows = [("d", s, i * M, *(float((i * 7 + len(s)) % 5),) * 4, 1.0) for s in ("A", "BB") for i in range(50)]
    b = spark.createDataFrame(rows, "dataset string, symbol string, minute_ts long, open double, high double, low double, close double, volume double").repartition(3)

    def strategy(g):
        assert g["minute_ts"].is_monotonic_increasing
        return g["close"].rolling(3).mean().to_numpy()

    key = lambda df: {(r.symbol, r.minute_ts): r.m for r in df.collect()}
    whole = key(sim.vector_signal(b, strategy, "m", ["close"], "double"))
    pieces = key(sim.vector_signal(b, strategy, "m", ["close"], "double", lookback=2, rows=7))
    assert whole == pieces and len(whole) == 100 and whole["A", 0] is None
    assert abs(whole["A", 4 * M] - np.mean([(i * 7 + 1) % 5 for i in (2, 3, 4)])) < 1e-12
    assert sim.vector_signal(b.limit(0), strategy, "m", ["close"], "double").count() == 0
    with pytest.raises(Exception, match="values for 50 bars"):
        sim.vector_signal(b, lambda g: [True], "m", ["close"]).collect()
    own = sim.momentum_run(b, F.lit(False)).first()
    assert own.long_bars == 0 and own.pnl == 0
