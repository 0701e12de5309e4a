"""What a task holds, and how often a row is copied, does not grow with the table."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import metrics as mt
from barloom.operators import pieces
from barloom.operators import research as rs
from barloom.plans import bars, piece_queries, run_queries  # noqa: F401


@pytest.fixture(scope="module")
def deltas(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{i:03d}", "k", f"2024-01-{d + 1:02d}", float(rng.normal())) for i in range(120) for d in range(15) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "run_id string, key string, day string, delta double").cache()


def test_small_blocks_copy_no_delta_more_often(spark, deltas, monkeypatch):
    """a key has at most TILES tiles beside those that its deltas ask for, and a run's deltas lie packed in a few rows."""
    cells = rs._self_cells(deltas, 2)
    assert cells.count() <= rs.TILES**2
    copies = cells.agg(F.sum(F.octet_length("delta")) / 8).first()[0] / deltas.count()
    assert copies == rs.TILES
    by = lambda df: sorted(tuple(r) for r in df.collect())
    want = by(rs.novelty_blocks(deltas, 3))
    assert by(rs.novelty_blocks(deltas, 3, 2)) == want and len(want) == 120
    for name, n in (("TILE_DELTAS", 100), ("PACK_DELTAS", 30), ("SIDE", 40)):  # many tiles, packs of a tile and chunks of a pack
        monkeypatch.setattr(rs, name, n)
    assert rs._self_cells(deltas, 2).select("i").distinct().count() > rs.TILES
    assert by(rs.novelty_blocks(deltas, 3, 2)) == want


def test_moments_merge_few_pieces_each(spark):
    """with a piece for every row, none merges more than FAN of a level; the moments are those of one window."""
    rng = np.random.default_rng(9)
    n = 5000  # more than FAN * FAN pieces
    rows = [("f", int(t), float(1e6 + rng.normal()) if t % 7 else None) for t in np.cumsum(rng.choice([1, 1, 9], n))]
    d = spark.createDataFrame(rows, "k string, t long, x double")
    out = pieces.running(d, {"m": ("moments", F.col("x"))}, ["k"], "t", 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"_at1#\d+L?\], \[_at0", plan)) >= 1  # stretches, not whole keys, are what a piece looks back on
    upto = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = d.select("t", F.count("x").over(upto).alias("n"), F.var_samp("x").over(upto).alias("v")).orderBy("t").toPandas()
    got = out.select("t", F.col("m.n").alias("n"), pieces.var_samp(F.col("m")).alias("v")).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-6)


def test_equity_metrics_hold_no_row_for_each_time(spark):
    """whether a run has two times is told by the first and the last, so no aggregate is kept for each time of a run."""
    e = spark.createDataFrame([("a", 0, 5, 1.0), ("a", 1, 5, 2.0), ("b", 0, 5, 1.0), ("b", 1, 6, 2.0), ("c", 0, None, 1.0)], "run_id string, seq long, bar_ts long, equity double")
    out = mt.equity_metrics(e)
    assert {r.run_id: r.elapsed_years is None for r in out.collect()} == {"a": True, "b": False, "c": True}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*bar_ts", plan)


def test_line_bars_take_tasks_by_their_lines(spark, monkeypatch):
    """more lines are more tasks, in one exchange, and the same deltas."""
    sf = "/root/testdata/sf0.001"
    by = lambda df: sorted(tuple(r) for r in df.collect())
    want = by(bars.QUERIES["m22_daily_pnl_deltas"](spark, sf))
    monkeypatch.setattr(bars, "LINES_OF_TASK", 500)
    got = bars.QUERIES["m22_daily_pnl_deltas"](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(symbol#\d+, (\d+)\), REPARTITION_BY_NUM", plan) == ["12"] or "REPARTITION_BY_NUM" in plan
    assert plan.count("Exchange") == 1 and by(got) == want


def test_novelty_reads_its_deltas_once(spark, deltas, tmp_path):
    """r04 F16: the numbers of days and of runs come from the stored deltas, not from making them again."""
    deltas.write.parquet(f"{tmp_path}/given")
    d = spark.read.parquet(f"{tmp_path}/given")
    out = rs.novelty(d, d, 0.95, 3)
    assert "/given" not in out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    two = rs.novelty(d, d.select("*"), 0.95, 3)
    by = lambda df: sorted(tuple(r) for r in df.collect())
    assert by(out) == by(two) and out.count() == 120


def test_few_cells_take_tasks_of_their_own(spark, deltas):
    """r04 F16: some cells are dealt over four times as many tasks, so that hardly one holds several."""
    plan = rs.novelty_blocks(deltas, 3, 2)._jdf.queryExecution().optimizedPlan().toString()
    cells = rs.TILES * (rs.TILES + 1) // 2
    assert re.search(rf"RepartitionByExpression \[key#\d+, i#\d+L?, j#\d+L?\], {4 * cells}\b", plan)


@pytest.mark.parametrize("odd", ["", "twins", "flat", "large", "endless", "short", "high"])
def test_nearest_by_single_precision(odd, monkeypatch):
    """r04 F16: what single precision leaves open is worked out in double, so the nearest run of each is that of all pairs in double."""
    rng = np.random.default_rng(4)
    n, days = 90, 700
    x = rng.normal(size=(n, days)) * np.exp(rng.normal(size=(n, 1)) * 3) + 40 * rng.normal(size=(n, 1))
    x[rng.random(x.shape) > 0.2] = np.nan
    if odd == "twins":
        x[60:70] = x[10:20]  # in another chunk, and as far from all others
        x[70:75] = x[10:15] * (1 + 1e-6 * rng.normal(size=(5, days)))
    if odd == "flat":
        x[5:9] = np.where(np.isnan(x[5:9]), np.nan, 0.1)
    if odd == "large":
        x[7:9] *= 1e170
    if odd == "endless":
        x[7, np.nonzero(~np.isnan(x[7]))[0][:3]] = np.inf
    if odd == "short":
        x[20:60, 60:] = np.nan  # runs of a dozen days, which share few
    if odd == "high":
        x[11:14] = 1e6 + 0.2 * rng.normal(size=(3, days)) * np.where(np.isnan(x[11:14]), np.nan, 1.0)  # a deviation of 2e-7 of the mean is none
        x[14, 50:] = np.where(np.isnan(x[14, 50:]), np.nan, 0.0)  # nothing on most days, but a mean
        x[15:25, :60] = np.nan
    names = np.array([f"r{i:02d}" for i in rng.permutation(n)], dtype=object)
    chunks = [(names[k : k + 30], x[k : k + 30], (False, 0, k)) for k in range(0, n, 30)]

    def found(mirrored):
        cell = rs._nearest_of(3, mirrored)()
        for k, one in enumerate(chunks):
            for other in chunks[k:] if mirrored else chunks:
                cell(one, other, mirrored and one is other)
        out = pd.concat(list(cell.rows())).sort_values("run_id").reset_index(drop=True)
        return out.astype({"nearest": str})

    rho = rs._rho((names, x, None), (names, x, None), 3)[1]
    has = np.isfinite(rho)
    top = np.where(has, np.abs(rho), -1).max(1)
    if odd == "high":
        assert not has[11:14].any() and has[14].sum() < n - 10 and np.isnan(rho[14, 15:25]).all()
    want = [(names[i], min(names[has[i] & (np.abs(rho[i]) == top[i])]), top[i], has[i].sum()) for i in range(n) if has[i].any()]
    want = pd.DataFrame(want, columns=["run_id", "nearest", "rho", "compared"]).sort_values("run_id").reset_index(drop=True)
    for got in (found(True), found(False)):
        pd.testing.assert_frame_equal(got.assign(rho=got.rho.abs()), want, check_dtype=False, check_exact=True)
    tried = []
    monkeypatch.setattr(rs, "_rho_of", lambda a, b, m, f=rs._rho_of: tried.append(len(a)) or f(a, b, m))
    found(True)
    assert sum(tried) < n * n / 4 and (odd in ("large", "endless") or tried)


@pytest.mark.parametrize("name", ["a5_merge_kinds", "a8_dedup_minutes", "a14_closed_candles"])
def test_missing_values_as_in_sql(spark, tmp_path, name):
    """The first and the last value of an hour or minute are the first and last that there are."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 1 THEN NULL ELSE value END AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = bars.QUERIES[name](spark, str(tmp_path)).toPandas()
    want = con.sql(bars.SQL[name]).df()[list(got.columns)]
    keys = ["symbol", "minute_ts"]
    pd.testing.assert_frame_equal(*(d.sort_values(keys).reset_index(drop=True) for d in (got, want)), check_dtype=False)


def _beside_sql(spark, folder, name: str, events: str) -> None:
    """The query over events made by a SELECT from e (sf0.001) has the rows of its SQL; NaN counts as missing."""
    con = duckdb.connect()
    con.sql("CREATE VIEW e AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    con.sql(f"COPY ({events}) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = bars.QUERIES[name](spark, str(folder)).toPandas()
    want = con.sql(bars.SQL[name]).df()[list(got.columns)]
    keys = [c for c in ("symbol", "minute_ts", "ts", "kind", "trade_key", "trade_id", "entry_ts", "failure", "total") if c in got]
    pd.testing.assert_frame_equal(*(d.sort_values(keys).reset_index(drop=True) for d in (got, want)), check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", ["a12_as_of_kinds", "a18_tape_events", "a22_flow_columns", "a23_source_column"])
def test_decimals_round_as_in_sql(spark, tmp_path, name):
    """values of five decimals that a double holds from just below a half."""
    _beside_sql(spark, tmp_path, name, "SELECT * REPLACE (event_id + i * 1000 AS event_id, value * (1 + i * 0.001) AS value) FROM e, range(6) t(i)")


@pytest.mark.parametrize("made", ["0", "NULL"])
@pytest.mark.parametrize("name", ["c1_reconcile_trades", "c2_close_to_close_pnl", "c3_reconcile_summary", "c5_match_trades", "c8_realism_gap", "h1_ema_in_pieces", "i4_ema"])
def test_prices_of_nothing_as_in_sql(spark, tmp_path, name, made):
    """Bars that close at 0, or without a price."""
    _beside_sql(spark, tmp_path, name, f"SELECT * REPLACE (CASE WHEN event_id % 3 = 1 THEN {made} ELSE value END AS value) FROM e")


def test_sign_of_zero_as_in_sql(spark, tmp_path):
    """a short trade that ends where it began gains -0.0."""
    name, half = "c8_realism_gap", "SELECT * REPLACE (round(value / 20) * 20 + 20 AS value) FROM e"
    _beside_sql(spark, tmp_path, name, half)
    got = bars.QUERIES[name](spark, str(tmp_path)).where("baseline_pct = 0").toPandas()["baseline_pct"]
    events = duckdb.read_parquet(f"{tmp_path}/events.parquet")  # noqa: F841  named in the SQL
    want = duckdb.sql(bars.SQL[name]).df().query("baseline_pct == 0")["baseline_pct"]
    assert np.signbit(got).sum() == np.signbit(want).sum() > 0


@pytest.mark.parametrize("name", ["a7_run_over_stored_bars", "p9_momentum_run", "u2_vector_strategy_run"])
@pytest.mark.parametrize(
    "events",
    {
        "a growth of NaN": "SELECT * REPLACE (CASE WHEN event_id % 50 = 7 THEN 'inf'::DOUBLE ELSE value END AS value) FROM e",
        "too large to round": "SELECT * REPLACE ([1, 2, 1e302][event_id + 1] AS value, 'a' AS event_type, TIMESTAMP '2024-01-01' + to_hours(event_id::INT) AS ts) FROM e WHERE event_id < 3",
        "no long bars": "SELECT * REPLACE (-epoch_ms(ts)::DOUBLE AS value) FROM e",
        "no bars": "SELECT * FROM e WHERE event_id < 0",
        "columns that are not read": "SELECT * REPLACE (CASE WHEN event_id % 50 = 7 THEN 1e15 ELSE value END AS value, '{}' AS props) FROM e",
        "bars without a time": "SELECT * REPLACE (CASE WHEN event_id % 50 <> 7 THEN ts END AS ts) FROM e",
        "before 1970": "SELECT * REPLACE (TIMESTAMP '1969-12-31 19:00:00' + to_minutes((event_id % 600)::INT) AS ts) FROM e",
    }.items(),
    ids=lambda x: x[0],
)
def test_run_as_in_sql(spark, tmp_path, name, events):
    """runs without end, without trades or bars, over bars whose other columns do not cast, and over odd times."""
    _beside_sql(spark, tmp_path, name, events[1])


#: Events in the last half of an hour's last ms, which epoch_ms rounds up into the next hour.
LATE = "SELECT * REPLACE (CASE WHEN event_id % 3 = 1 THEN date_trunc('hour', ts) + to_microseconds(3599999500 + event_id % 400) ELSE ts END AS ts) FROM e"


@pytest.mark.parametrize("name", ["a12_as_of_kinds", "a14_closed_candles", "a18_tape_events", "a22_flow_columns", "a23_source_column", "a7_run_over_stored_bars", "c1_reconcile_trades", "c2_close_to_close_pnl", "c3_reconcile_summary", "c8_realism_gap", "h1_ema_in_pieces", "h1_macd_in_pieces"])
def test_times_round_as_in_sql(spark, tmp_path, name):
    """r04 F1 to F5, F7, F9 to F14: an event in the last half ms of an hour is one of the next hour."""
    _beside_sql(spark, tmp_path, name, LATE)


@pytest.mark.parametrize(
    "events",
    {
        "late in a minute": "SELECT * REPLACE (date_trunc('minute', ts) + to_microseconds(59999500 + event_id % 400) AS ts) FROM e",
        "before 1970": "SELECT * REPLACE (TIMESTAMP '1969-12-31 23:00:00' + to_microseconds(event_id * 7000500) AS ts) FROM e",
        "without an id": "SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_seconds(20 * event_id) AS ts, CASE WHEN event_id % 100 < 70 THEN event_id END AS event_id) FROM e",
    }.items(),
    ids=lambda x: x[0],
)
def test_minutes_as_in_sql(spark, tmp_path, events):
    """r04 F8: the last half ms of a minute, times before 1970, and events that have no place in their minute."""
    _beside_sql(spark, tmp_path, "a8_dedup_minutes", events[1])


def test_merged_kinds_round_times_as_in_sql(spark, tmp_path):
    """r04 F6: the funding and open interest of an hour begin with the last half ms before it, as its bar does."""
    _beside_sql(spark, tmp_path, "a5_merge_kinds", LATE)
