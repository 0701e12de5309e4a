"""Stored layouts: buckets that need no exchange, a ledger that only grows; blocks of runs met once."""

import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import research as rs
from barloom.operators import simulate as sim
from barloom.sources import rows as src

M = 60_000


def test_stored_bars_need_no_exchange(spark, tmp_path):
    b = spark.range(4000).select(F.lit("d").alias("dataset"), F.concat(F.lit("s"), (F.col("id") % 13).cast("string")).alias("symbol"), (F.col("id") * M).alias("minute_ts"), *(F.abs(F.sin(F.col("id") * n)).alias(c) for n, c in ((1, "open"), (2, "high"), (3, "low"), (5, "close"))), F.lit(1.0).alias("volume"))
    stored = src.write_bars(b, "stored_bars_test", str(tmp_path / "bars"), 4)
    try:
        assert sim.momentum_run(stored).first().total_bars == sim.momentum_run(b).first().total_bars
        plan = lambda df: re.findall(r"Exchange (\w+)\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
        assert plan(ind.rsi(stored)) == []
        assert all("symbol" not in keys for _, keys in plan(sim.momentum_run(stored)))  # only the sums of a dataset's symbols move
        assert any("symbol" in keys for _, keys in plan(sim.momentum_run(b)))
        a, c = ({(r.symbol, r.minute_ts): r.rsi for r in ind.rsi(x).collect()} for x in (stored, b))
        assert a == c
    finally:
        spark.sql("DROP TABLE stored_bars_test")


def test_ledger_only_grows(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "k string, run_id long, created_at long"
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    first = spark.createDataFrame([(f"k{i % 40}", i, i) for i in range(80)] + [(None, 500, 9)], schema)
    got = src.record_in_ledger(path, first, ["k"], 8)
    assert sorted((str(r.k), r.run_id) for r in got.collect()) == sorted([(f"k{i}", i) for i in range(40)] + [("None", 500)])
    before = files()
    got = src.record_in_ledger(path, spark.createDataFrame([("k1", 900, 0), ("new", 902, 5), ("new", 901, 5), (None, 1, 1)], schema), ["k"], 8)
    assert {(r.k, r.run_id) for r in got.collect() if r.run_id > 100} == {(None, 500), ("new", 901)} and got.count() == 42
    after = files()
    assert before.items() <= after.items() and len({os.path.dirname(f) for f in after.keys() - before.keys()}) == 1
    assert src.record_in_ledger(path, first.limit(0), ["k"], 8).count() == 42


@pytest.mark.parametrize("block", [2, 5, 512])
def test_blocks_meet_once(spark, block):
    rng = np.random.default_rng(3)
    days = [f"2024-01-{d:02d}" for d in range(1, 13)]
    rows = [(f"r{i:02d}", "k" if i < 20 else "m", d, float(rng.integers(-2, 3)) + (i % 3)) for i in range(26) for d in days if rng.random() < 0.8]
    d = spark.createDataFrame(rows, "run_id string, key string, day string, delta double")
    two = {(r.a_run, r.b_run): (r.overlap, r.rho) for r in rs.pnl_correlation(d, d, 5).collect()}
    want = {k: v for k, v in two.items() if k[0] < k[1] and v[1] is not None and abs(v[1]) >= 0.2}
    got = rs.correlated_pairs(d, 0.2, 5, block).collect()
    assert {(r.a_run, r.b_run): (r.overlap, r.rho) for r in got} == want and len(got) == len(want)
    same = lambda df: sorted(tuple(r) for r in df.collect())
    assert same(rs.novelty_blocks(d, 5, block)) == same(rs.nearest_blocks(d, d, 5))
    assert rs._self_cells(d, block).count() * 2 <= rs._cells(d, d, block).count()
    assert rs.novelty_blocks(d.limit(0)).count() == 0
