"""Statistics across runs: walk-forward folds, hold-outs, trial families, deflated Sharpe ratios, novelty, gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import DAY_MS, YEAR_MS, canonical_hash, js_round, normal_cdf, normal_inv_cdf, parse_timeframe
from ..sources.store import stored
from .metrics import METRICS, long_form, run_metrics
from .pieces import running, var_samp
from .simulate import momentum_trades

EULER_GAMMA = 0.5772156649015329
MACD_WARMUP = 34


def walk_forward_folds(runs: DataFrame, folds: int, mode: str = "expanding") -> DataFrame:
    """runs (run_id, ts_from, ts_to) -> a row for each fold: fold, train_from, train_to, test_from, test_to."""
    if folds < 1 or mode not in ("expanding", "rolling"):
        raise ValueError("folds must be positive and mode expanding or rolling")
    at = lambda k: F.col("ts_from") + js_round((F.col("ts_to") - F.col("ts_from")) * k / (folds + 1)).cast("long")
    f = runs.where("ts_to > ts_from").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("ts_from") if mode == "expanding" else at(F.col("fold"))
    return f.select("run_id", "fold", start.alias("train_from"), at(F.col("fold") + 1).alias("train_to"), at(F.col("fold") + 1).alias("test_from"), at(F.col("fold") + 2).alias("test_to"))


def fold_anchors(equity: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (run_id, fold, test_from, test_to) with the last equity point before each (`anchor`; of equal times the last by seq) and the number
    of distinct times before it (`warmup_steps`): one window over points and folds together, so points are not laid out for each fold."""
    point = F.struct(*(c for c in equity.columns if c != "run_id"))
    points = equity.select("run_id", F.col("bar_ts").alias("_at"), F.lit(1).alias("_o"), F.col("seq").alias("_seq"), point.alias("_point"))
    starts = windows.select("run_id", F.col("test_from").alias("_at"), F.lit(0).alias("_o"), F.struct("fold", "test_from", "test_to").alias("_fold"))
    w = Window.partitionBy("run_id").orderBy("_at", "_o", "_seq")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(starts, allowMissingColumns=True)
    both = both.withColumn("_before", F.last(F.when(F.col("_o") == 1, F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = ((F.col("_o") == 1) & ~F.col("_before").eqNullSafe(F.col("_at"))).cast("long")
    both = both.withColumn("anchor", F.last("_point", ignorenulls=True).over(past)).withColumn("warmup_steps", F.sum(new).over(past))
    return both.where("_o = 0").select("run_id", "_fold.*", "anchor", "warmup_steps")


def anchored_window(equity: DataFrame, windows: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Equity points inside each window (run_id, fold, test_from, test_to) and the last one before it (of equal times the last by seq)."""
    f = windows.select(F.col("run_id").alias("_run"), "fold", "test_from", "test_to")
    inside = (F.col("run_id") == F.col("_run")) & (F.col("bar_ts") >= F.col("test_from")) & (F.col("bar_ts") < F.col("test_to"))
    a = fold_anchors(equity, windows) if anchors is None else anchors
    return equity.join(f, inside).drop("_run").unionByName(a.where("anchor is not null").select("run_id", "anchor.*", "fold", "test_from", "test_to"))


def evaluate_folds(equity: DataFrame, trades: DataFrame, folds: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Metrics of each (run_id, fold) over its anchored equity and the trades that open and close in it, with points, carried-in trades and warm-up steps."""
    keys = ["run_id", "fold"]
    anchors = fold_anchors(equity, folds)
    e = anchored_window(equity, folds, anchors)
    t = trades.join(folds, "run_id").where("exit_ts >= test_from and exit_ts < test_to")
    inside = t.where("entry_ts >= test_from")
    carry = t.groupBy(*keys).agg(F.count_if(F.expr("entry_ts < test_from")).alias("carry_in"))
    m = run_metrics(e, inside, [*(names or METRICS), "points"], keys, (F.col("test_to") - F.col("test_from")) / YEAR_MS)
    out = m.join(carry, keys, "left").join(anchors.select(*keys, "warmup_steps"), keys, "left").fillna(0, ["carry_in", "warmup_steps"])
    return out.withColumn("sufficient", F.col("points") >= 2)


def walk_forward_run(bars: DataFrame, folds: DataFrame, signal: Column | None = None) -> DataFrame:
    """(dataset, fold, entry_ts, ...): the momentum trades, or those of `signal`, of each fold (run_id = dataset, fold, train_from, test_from, test_to), run over
    its training and test bars and kept where they are entered in the test. Each fold's bars are a tape of their own, so nothing looks over its edges."""
    f = folds.select(F.col("run_id").alias("_run"), "fold", "train_from", "test_from", "test_to")
    inside = (F.col("dataset") == F.col("_run")) & (F.col("minute_ts") >= F.col("train_from")) & (F.col("minute_ts") < F.col("test_to"))
    each = bars.join(f, inside).withColumn("dataset", F.struct(F.col("dataset").alias("name"), "fold", "test_from")).drop("_run", "fold", "train_from", "test_from", "test_to")
    t = momentum_trades(each, signal=signal)
    t = t.select(F.col("dataset.name").alias("_name"), "dataset.fold", "dataset.test_from", *(c for c in t.columns if c != "dataset"))
    return t.where("entry_ts >= test_from").drop("test_from").withColumnRenamed("_name", "dataset")


def aggregate_folds(fold_metrics: DataFrame, names: list[str]) -> DataFrame:
    """(run_id, metric, mean, stddev, min, max, positive_fraction) of the metrics that every fold of the run has."""
    v = long_form(fold_metrics, ["run_id", "fold"], [n for n in names if n in METRICS])
    n = fold_metrics.groupBy("run_id").agg(F.count_distinct("fold").alias("folds"))
    a = v.groupBy("run_id", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg((F.col("value") > 0).cast("double")).alias("positive_fraction"))
    return a.join(n, "run_id").where("n = folds").drop("n", "folds")


def walk_forward_status(folds: DataFrame, fold_metrics: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(run_id, status, reason, requested_folds, completed_folds, insufficient_folds, failed_folds) of runs with folds (run_id, fold).

    A fold in failed (run_id, fold, code) failed; one with metrics that are `sufficient` is completed; any other is insufficient. resolved: all folds
    completed; partial: some; unavailable: none, for all_folds_failed if any failed, else insufficient_folds. Lists are in the order of folds,
    failed ones as fold:code.
    """
    f = folds.select("run_id", "fold").distinct().join(fold_metrics.select("run_id", "fold", "sufficient"), ["run_id", "fold"], "left")
    if failed is None:
        f = f.withColumn("code", F.lit(None).cast("string"))
    else:
        f = f.join(failed.groupBy("run_id", "fold").agg(F.min("code").alias("code")), ["run_id", "fold"], "left")
    done = F.col("code").isNull() & F.coalesce("sufficient", F.lit(False))
    listed = lambda on, x: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("fold", x.alias("x"))))), lambda s: s.x)
    per = f.groupBy("run_id").agg(
        F.count("*").alias("requested_folds"), F.count_if(done).alias("completed_folds"), listed(F.col("code").isNull() & ~done, F.col("fold")).alias("insufficient_folds"),
        listed(F.col("code").isNotNull(), F.concat_ws(":", F.col("fold").cast("string"), "code")).alias("failed_folds"),
    )
    none = F.col("completed_folds") == 0
    status = F.when(none, "unavailable").when(F.col("completed_folds") == F.col("requested_folds"), "resolved").otherwise("partial")
    reason = F.when(none, F.when(F.size("failed_folds") > 0, "all_folds_failed").otherwise("insufficient_folds"))
    return per.select("run_id", status.alias("status"), reason.alias("reason"), "requested_folds", "completed_folds", "insufficient_folds", "failed_folds")


def completed_folds(fold_metrics: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The folds that count in aggregate_folds(): sufficient and not failed."""
    done = fold_metrics.where("sufficient")
    return done if failed is None else done.join(failed.select("run_id", "fold"), ["run_id", "fold"], "left_anti")


def common_metrics(fold_metrics_long: DataFrame) -> DataFrame:
    """(run_id, metric) present in all folds of the run."""
    n = fold_metrics_long.groupBy("run_id").agg(F.count_distinct("fold").alias("folds"))
    return fold_metrics_long.groupBy("run_id", "metric").agg(F.count_distinct("fold").alias("n")).join(n, "run_id").where("n = folds").select("run_id", "metric")


def holdout_window(coverage: DataFrame, fraction: float) -> DataFrame:
    """coverage (ts_from, ts_to, ...) with holdout_from and holdout_to: the last fraction of the span."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie in (0, 1)")
    return coverage.withColumn("holdout_from", F.col("ts_to") - js_round(fraction * (F.col("ts_to") - F.col("ts_from"))).cast("long")).withColumn("holdout_to", F.col("ts_to"))


def holdout_overlap(r_from: Column, r_to: Column, h_from: Column, h_to: Column) -> Column:
    return F.when(~((r_from < h_to) & (h_from < r_to)), "none").when((h_from <= r_from) & (r_to <= h_to), "full").otherwise("partial")


def history_check(runs: DataFrame, folds: int, novelty_days: int, holdout_days: int = 30) -> DataFrame:
    """runs (run_id, timeframe, ts_from, ts_to) with required_days and sufficient; a timeframe that can't be read requires nothing by itself."""
    wfo = F.ceil(parse_timeframe("timeframe") * ((folds + 1) * MACD_WARMUP) / DAY_MS)
    need = F.greatest(wfo, F.lit(novelty_days), F.lit(holdout_days)).cast("long")
    return runs.withColumn("required_days", need).withColumn("sufficient", (F.col("ts_to") - F.col("ts_from")) / DAY_MS >= need)


def smallest_sufficient_tier(tiers: DataFrame, requests: DataFrame, span: int = 365 * 1440) -> DataFrame:
    """requests (request_id, days) with the tier of the fewest common_present_minutes (then the smallest name) that still cover them; NULL if none does.

    The distinct numbers of days are laid among the tiers, from the most minutes down, and each takes the last tier before it; requests then
    meet theirs by an equi-join. span: minutes of a piece of that scale."""
    minutes = F.col("common_present_minutes")
    steps = tiers.where(minutes.isNotNull()).groupBy((-minutes).cast("double").alias("_down")).agg(F.min("tier").alias("tier")).withColumn("_o", F.lit(0))
    needs = requests.where("days is not null").select("days").distinct().withColumn("_down", (-F.col("days") * 1440).cast("double")).withColumn("_o", F.lit(1))
    scale = running(steps.unionByName(needs, allowMissingColumns=True).withColumn("_all", F.lit(0)), {"_tier": ("last", F.col("tier"))}, ["_all"], "_down", span, ["_o"])
    found = scale.where("_o = 1").select("days", F.col("_tier").alias("tier"))
    return requests.select("request_id", "days").distinct().join(found, "days", "left").select("request_id", "days", "tier")


def family_key(with_period: bool = True) -> Column:
    """Over hint or module, dataset, sorted symbols, timeframe and, for a family, the period; without it, for comparability."""
    fields = {"hint": F.coalesce("trial_hint", "module_id"), "dataset": F.col("dataset"), "symbols": F.array_sort("symbols"), "timeframe": F.col("timeframe")}
    return canonical_hash(**(fields | ({"from": F.col("ts_from"), "to": F.col("ts_to")} if with_period else {})))


def promotion_family_key() -> Column:
    """Over hint or module, dataset, sorted symbols and timeframe: another period stays in the family."""
    return canonical_hash(hint=F.coalesce("trial_hint", "module_id"), datasetRef=F.col("dataset"), symbols=F.array_sort("symbols"), timeframe=F.col("timeframe"))


def qualification_epoch_key(family: Column, epoch_id: Column, policy_version: Column) -> Column:
    return canonical_hash(promotionFamilyKey=family, epochId=epoch_id, policyVersion=policy_version)


def attempt_identity(request: Column, dataset: Column) -> Column:
    """Over the fingerprints of a request and of the data it ran on: a replay on the same data is the same attempt."""
    return canonical_hash(requestFingerprint=request, datasetFingerprint=dataset)


def request_fingerprint(columns: list[str]) -> Column:
    return canonical_hash(**{c: F.col(c) for c in columns})


def record_if_new(ledger: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with the new rows whose key it lacks; the first by created_at and run_id of each key stays."""
    w = Window.partitionBy(*keys).orderBy("_old", "created_at", "run_id")
    both = ledger.withColumn("_old", F.lit(0)).unionByName(new.withColumn("_old", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_old")


def deflation(trials: DataFrame, empirical_min_n: int = 10) -> DataFrame:
    """trials (n_trials, family_var, sharpe, skew, kurtosis, t_count) with v_sr, basis, sr0 and dsr; NULL where undefined."""
    sr, n, t = F.col("sharpe"), F.col("n_trials"), F.col("t_count")
    asymptotic = (1 + 0.5 * sr * sr) / F.when(t >= 2, t)
    empirical = (n >= empirical_min_n) & (n > 1) & (F.col("family_var") > 0)
    d = trials.withColumn("basis", F.when(empirical, "empirical").otherwise("asymptotic")).withColumn("v_sr", F.when(empirical, F.col("family_var")).otherwise(asymptotic))
    q = lambda x: normal_inv_cdf(1 - 1 / x)
    term = (1 - EULER_GAMMA) * q(n.cast("double")) + EULER_GAMMA * q(n * F.lit(math.e))
    d = d.withColumn("sr0", F.when(n <= 1, 0.0).otherwise(F.sqrt("v_sr") * term))
    under = 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr
    z = (sr - F.col("sr0")) * F.sqrt(F.when(t >= 2, t - 1)) / F.sqrt(F.when(under > 0, under))
    return d.withColumn("dsr", normal_cdf(z))


def deflated_sharpe(trials: DataFrame, empirical_min_n: int = 10) -> DataFrame:
    """trials (family_key, run_id, sharpe, skew, kurtosis, t_count): each against all trials of its family."""
    family = trials.groupBy("family_key").agg(F.count("*").alias("n_trials"), F.var_samp("sharpe").alias("family_var"))
    return deflation(trials.join(family, "family_key"), empirical_min_n)


def trial_context_as_of(trials: DataFrame, empirical_min_n: int = 10, span: int | None = None) -> DataFrame:
    """The same against the trials recorded up to each run (by created_at, a number, then run_id). span: a stretch of created_at that makes a
    piece of a family too large for one task: counts add up, and means and variances are merged (pieces.running())."""
    upto = running(trials, {"n_trials": ("count", F.lit(1)), "_m": ("moments", F.col("sharpe"))}, ["family_key"], "created_at", span, ["run_id"])
    return deflation(upto.withColumn("family_var", var_samp(F.col("_m"))).drop("_m"), empirical_min_n)


#: Runs of a block and, at most, of a pack, which is one row and one side of a matrix product; deltas of a pack and of a tile; numbers of one side of a product;
#: tiles that a key may have whatever its deltas; tasks up to which there are four for each cell.
BLOCK, PACK_DELTAS, TILE_DELTAS, SIDE, TILES, EVEN = 512, 500_000, 4_000_000, 4_000_000, 8, 2_000


def _dealing(d: DataFrame, block: int) -> DataFrame:
    """(key, tiles, packs): into how many tiles a key's runs are dealt, and each tile into how many packs. A tile is a block of runs, or several where a key
    has more than TILES: then as many as make TILE_DELTAS. So a delta is copied as often as its key has tiles, whatever the block."""
    n = d.groupBy("key").agg(F.greatest(F.approx_count_distinct("run_id", 0.02), F.lit(1)).alias("runs"), F.count("*").alias("deltas"))
    tiles = F.least(F.ceil(F.col("runs") / block), F.greatest(F.lit(TILES), F.ceil(F.col("deltas") / TILE_DELTAS))).cast("long")
    packs = F.greatest(F.ceil(F.col("runs") / tiles / BLOCK), F.ceil(F.col("deltas") / tiles / PACK_DELTAS)).cast("long")
    return n.select("key", tiles.alias("tiles"), packs.alias("packs"))


def _pack(g: pa.Table) -> pa.Table:
    """The deltas of a pack's runs as one row: the runs and days that there are, then each delta's place among both."""
    runs, days = (g.column(c).combine_chunks().dictionary_encode() for c in ("run_id", "day"))
    run, day = runs.indices.to_numpy(), days.indices.to_numpy()
    order = np.lexsort((day, run))
    run, day, delta = run[order].astype("<u4"), day[order].astype("<u4"), g.column("delta").to_numpy()[order].astype("<f8")
    if ((np.diff(run) == 0) & (np.diff(day) == 0)).any():
        raise ValueError("a run has two deltas of one day")
    at = [g.column(c).slice(0, 1) for c in ("key", "at")]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.table([*at, one(runs.dictionary), one(days.dictionary), *(pa.array([x.tobytes()], pa.binary()) for x in (run, day, delta))], ["key", "at", *PACKED])


PACKED = ["runs", "days", "run", "day", "delta"]


def _packs(d: DataFrame, dealing: DataFrame) -> DataFrame:
    """(key, tiles, tile, and PACKED) of deltas (run_id, key, day, delta)."""
    kind = {c: d.schema[c].dataType.simpleString() for c in ("key", "run_id", "day")}
    at = F.pmod(F.xxhash64("run_id"), F.col("tiles") * F.col("packs")).alias("at")
    dealt = d.join(dealing, "key").select("key", at, "run_id", "day", F.col("delta").cast("double").alias("delta"))
    schema = f"key {kind['key']}, at long, runs array<{kind['run_id']}>, days array<{kind['day']}>, run binary, day binary, delta binary"
    packs = dealt.groupBy("key", "at").applyInArrow(_pack, schema).join(dealing.select("key", "tiles"), "key")
    return packs.select("key", "tiles", F.pmod("at", "tiles").alias("tile"), *PACKED)


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _in_cells(cells: DataFrame, number: int, found, schema: str) -> DataFrame:
    """found(left, right, alone) over each pair of chunks of each cell (key, i, j, side and PACKED), a cell being about a task. A chunk is (runs, one row of
    deltas for each, NaN where it has none, its place); alone: both are the same chunk. A class is made anew for each cell and gives its rows in the end, by rows()."""

    def cell(batches):
        sides: tuple[list, list] = ([], [])
        for b in batches:
            for i in range(b.num_rows):
                sides[b.column("side")[i].as_py()].append([b.column(c)[i] for c in PACKED])
        itself = not sides[1] and b.column("i")[0] == b.column("j")[0]
        names = pa.concat_arrays([p[1].values for s in sides for p in s]).unique() if any(sides) else None

        def chunks(packs):
            """(pack, first run, last run) of products of bounded size."""
            rows = max(1, min(BLOCK, SIDE // max(1, len(names))))
            return [(k, a, min(a + rows, len(p[0].values))) for k, p in enumerate(packs) for a in range(0, len(p[0].values), rows)]

        def chunk(packs, k, a, z):
            runs, days, run, day, delta = packs[k]
            run, day, delta = (np.frombuffer(x.as_buffer(), t) for x, t in ((run, "<u4"), (day, "<u4"), (delta, "<f8")))
            here = slice(*np.searchsorted(run, [a, z]))
            at = pc.index_in(days.values, names).to_numpy()
            x = np.full((z - a, len(names)), np.nan)
            x[run[here] - np.uint32(a), at[day[here]]] = delta[here]
            return runs.values.slice(a, z - a).to_numpy(zero_copy_only=False), x, (packs is not sides[0], k, a)

        answer = found() if isinstance(found, type) else found
        left = chunks(sides[0])
        right = left if itself else chunks(sides[1])
        for n, c in enumerate(left):
            one = chunk(sides[0], *c)
            for other in right[n:] if itself else right:
                alone = itself and other == c
                out = answer(one, one if alone else chunk(sides[0] if itself else sides[1], *other), alone)
                if out is not None and len(out):
                    yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        if answer is not found:
            for out in answer.rows():
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    # the signature tells Spark that a group comes, and goes, batch by batch
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cell(batches)

    arrow = to_arrow_schema(cells.sparkSession.createDataFrame([], schema).schema)
    # a task for each cell; few cells are dealt over more tasks than cells, as some would else hold several of them
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), number, min(4 * number, EVEN))
    return cells.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(each, schema)


def _cells(a: DataFrame, b: DataFrame, block: int, dealing: DataFrame | None = None) -> DataFrame:
    """Both sides' packs dealt into cells (key, i, j) of a tile of a's runs and one of b's, within a comparability key."""
    n = _two_dealings(a, b, block) if dealing is None else dealing
    of = lambda x: n.select("key", F.col(f"tiles_{x}").alias("tiles"), F.col(f"packs_{x}").alias("packs"))
    left, right = _packs(a, of("a")).join(n, "key"), _packs(b, of("b")).join(n, "key")
    cells = left.select("key", F.lit(0).alias("side"), F.col("tile").alias("i"), _upto("tiles_b").alias("j"), *PACKED)
    return cells.unionByName(right.select("key", F.lit(1).alias("side"), F.col("tile").alias("j"), _upto("tiles_a").alias("i"), *PACKED))


def _two_dealings(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    one, other = (_dealing(d, block).withColumnsRenamed({"tiles": f"tiles_{x}", "packs": f"packs_{x}"}) for d, x in ((a, "a"), (b, "b")))
    return one.join(other, "key")


def _self_cells(a: DataFrame, block: int, dealing: DataFrame | None = None) -> DataFrame:
    """The same for one side against itself: a cell for each unordered pair of tiles, i <= j; a tile meets itself as side 0 alone. So a run's deltas stand in
    as many cells as there are tiles, half of what two sides take."""
    d = _packs(a, _dealing(a, block) if dealing is None else dealing).withColumn("other", _upto("tiles"))
    return d.select("key", (F.col("tile") > F.col("other")).cast("int").alias("side"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), *PACKED)


def _met(a: DataFrame, b: DataFrame, block: int, found, schema: str, lies: bool = False) -> DataFrame:
    """found over all pairs of chunks of a's and b's runs of a comparability key; with a is b each unordered pair once. Deltas are read twice, so they are stored, unless they lie so."""
    if a is b:
        a = a if lies else stored(a, "deltas")
        n = stored(_dealing(a, block), "dealing")
        cells, number = _self_cells(a, block, n), F.expr("tiles * (tiles + 1) div 2")
    else:
        a, b = (a, b) if lies else (stored(a, "deltas"), stored(b, "deltas"))
        n = stored(_two_dealings(a, b, block), "dealing")
        cells, number = _cells(a, b, block, n), F.col("tiles_a") * F.col("tiles_b")
    return _in_cells(cells, n.agg(F.sum(number)).first()[0] or 1, found, schema)


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where there are deltas, as numbers; these less their run's mean, so that a mean far larger than the deviation takes no digits from it; and the means."""
    there = ~np.isnan(x)
    with np.errstate(all="ignore"):
        mean = np.where(there, x, 0.0).sum(1) / np.maximum(there.sum(1), 1)
        mean = np.where(np.isfinite(mean), mean, 0.0)
        return there.astype(float), np.nan_to_num(np.where(there, x - mean[:, None], 0.0)), mean


def _rho(one: tuple, other: tuple, min_overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of either chunk their shared days and their correlation on these, NaN below min_overlap days, below two, without variance and for a run with itself."""
    (left, x, _), (right, y, _) = one, other
    (mx, x, ax), (my, y, ay) = _centred(x), _centred(y)
    with np.errstate(all="ignore"):
        c, sx, sy, sxx, syy, sxy = mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T
        vx, vy = sxx - sx * sx / c, syy - sy * sy / c
        squares = lambda s, ss, a: np.maximum(ss, ss + 2 * a * s + a * a * c)  # noqa: E731  of the deltas less their mean or as they are
        rho = np.where((c >= max(2, min_overlap)) & (vx > 1e-12 * squares(sx, sxx, ax[:, None])) & (vy > 1e-12 * squares(sy, syy, ay)), (sxy - sx * sy / c) / np.sqrt(vx * vy), np.nan)
    same = left[:, None] == right[None, :]
    rho[same], c[same] = np.nan, 0
    return c.astype(np.int64), np.round(rho, 8)


PAIRS = "a_run string, b_run string, overlap long, rho double"


def pnl_correlation(a: DataFrame, b: DataFrame, min_overlap: int = 5, block: int = BLOCK) -> DataFrame:
    """(a_run, b_run, overlap, rho) of daily deltas (run_id, key, day, delta) on shared days, within a comparability key; NULL below min_overlap days, below two, or without variance."""
    twice = a is b  # an unordered pair is met once

    def pairs(one, other, alone):
        c, rho = _rho(one, other, min_overlap)
        i, j = np.nonzero(c)
        out = pd.DataFrame({"a_run": one[0][i], "b_run": other[0][j], "overlap": c[i, j], "rho": rho[i, j]})
        return out if alone or not twice else pd.concat([out, out.rename(columns={"a_run": "b_run", "b_run": "a_run"})])

    out = _met(a, b, block, pairs, PAIRS)
    return out.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


def correlated_pairs(deltas: DataFrame, at_least: float, min_overlap: int = 5, block: int = BLOCK) -> DataFrame:
    """(a_run, b_run, overlap, rho), a_run < b_run: the pairs of runs of a comparability key with |rho| >= at_least, once each. Others never leave their cell."""

    def pairs(one, other, alone):
        c, rho = _rho(one, other, min_overlap)
        with np.errstate(invalid="ignore"):
            i, j = np.nonzero(np.abs(rho) >= at_least)
        out = pd.DataFrame({"a_run": np.minimum(one[0][i], other[0][j]), "b_run": np.maximum(one[0][i], other[0][j]), "overlap": c[i, j], "rho": rho[i, j]})
        return out.drop_duplicates(["a_run", "b_run"])

    return _met(deltas, deltas, block, pairs, PAIRS)


def _light(chunk: tuple) -> tuple | None:
    """A chunk in single precision (where there are deltas, these less their run's mean over their deviation, their squares), which runs have a deviation, and the variance
    for each shared day above which it is one for _rho() too; None where a number is too large for that."""
    there, x, mean = _centred(chunk[1])
    with np.errstate(all="ignore"):
        deviation = np.sqrt((x * x).sum(1) / np.maximum(there.sum(1), 1))
    if not np.isfinite(deviation).all():
        return None
    unit = np.where(deviation > 0, deviation, 1.0)
    x = (x / unit[:, None]).astype("<f4")
    with np.errstate(all="ignore"):
        return there.astype("<f4"), x, x * x, deviation > 0, (4e-12 * (mean / unit) ** 2).astype("<f4")


def _rho_of(x: np.ndarray, y: np.ndarray, min_overlap: int) -> np.ndarray:
    """The correlation of each row of x with that of y, as _rho() has it, by means first."""
    both = ~(np.isnan(x) | np.isnan(y))
    c = both.sum(1)
    with np.errstate(all="ignore"):
        sums = lambda v: v.sum(1)
        x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
        sxx, syy = sums(x * x), sums(y * y)
        x, y = (np.where(both, v - (sums(v) / c)[:, None], 0.0) for v in (x, y))
        vx, vy = sums(x * x), sums(y * y)
        rho = np.where((c >= max(2, min_overlap)) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy), sums(x * y) / np.sqrt(vx * vy), np.nan)
    return np.round(rho, 8)


#: Numbers of a slice of pairs worked out one by one; the days below which, and the share of a chunk's pairs in doubt and the error of a correlation above which, a chunk is
#: worked out in double precision as a whole.
SLICE, FEW, OPEN, ROUGH = 1 << 18, 512, 0.02, 0.02


def _nearest_of(min_overlap: int, mirrored: bool) -> type:
    """The nearest run of each, for _in_cells(): of left ones among the right, and mirrored, also the other way round.

    All pairs are met in single precision, with a bound on the error; only those that by it may be a run's nearest, or whose variance is in doubt, are worked out in double.
    """

    class Nearest:
        def __init__(self):
            self.best: dict = {}  # by the place of a chunk: runs, the largest |rho|, with which run, its rho, and how many it was compared with
            self.last = (None, None)

        def __call__(self, one, other, alone):
            if one[1].shape[1] < FEW:
                i, j, rho, compared = self._in_full(one, other)
            else:
                if self.last[0] is not one:
                    self.last = one, _light(one)
                light = self.last[1]
                i, j, rho, compared = self._found(one, other, light, light if alone else _light(other))
            self._keep(one, i, other[0][j], rho, compared[0])
            if mirrored and not alone:
                self._keep(other, j, one[0][i], rho, compared[1])

        def _found(self, one, other, a, b):
            """Pairs (i, j) with their rho, among them the nearest of each run that may be its nearest of all, and the numbers of pairs by row and by column."""
            error = 40 * (one[1].shape[1] + 8) * 2.0**-24  # of a rho whose variances are a quarter or more of the mean squares: 6 / 0.25 times the rounding of a sum, and some
            if a is None or b is None or error > ROUGH:
                return self._in_full(one, other)
            (m, x, q, live, least), (n, y, r, alive, lowest) = a, b
            with np.errstate(all="ignore"):
                c, sx, sy, sxx, syy, sxy = m @ n.T, x @ n.T, m @ y.T, q @ n.T, m @ r.T, x @ y.T
                vx, vy = sxx - sx * sx / c, syy - sy * sy / c
                sure = (c >= max(2, min_overlap)) & (vx > 0.25 * sxx) & (vy > 0.25 * syy) & (vx > least[:, None] * c) & (vy > lowest * c)
                near = np.where(sure, np.abs(sxy - sx * sy / c) / np.sqrt(vx * vy), np.float32(-9))
            doubt = (c >= max(2, min_overlap)) & ~sure & live[:, None] & alive
            same = pd.Index(other[0]).get_indexer(one[0])
            itself = np.nonzero(same >= 0)[0]
            sure[itself, same[itself]], doubt[itself, same[itself]], near[itself, same[itself]] = False, False, -9
            if doubt.sum() > OPEN * doubt.size:
                return self._in_full(one, other)
            margin = error + 1e-7  # and the rounding to 8 places
            may = near >= (np.maximum(near.max(1) - margin, self._top(one)) - margin)[:, None]
            if mirrored:
                may |= near >= np.maximum(near.max(0) - margin, self._top(other)) - margin
            i, j = np.nonzero((may & sure) | doubt)
            rho, rows = np.empty(len(i)), max(1, SLICE // one[1].shape[1])
            for at in range(0, len(i), rows):
                k = slice(at, at + rows)
                rho[k] = _rho_of(one[1][i[k]], other[1][j[k]], min_overlap)
            has = np.isfinite(rho)
            more = doubt[i, j] & has
            return i[has], j[has], rho[has], (sure.sum(1) + np.bincount(i[more], minlength=len(sure)), sure.sum(0) + np.bincount(j[more], minlength=sure.shape[1]))

        def _in_full(self, one, other):
            rho = _rho(one, other, min_overlap)[1]
            has = np.isfinite(rho)
            top = np.where(has, np.abs(rho), -1.0)
            may = top >= top.max(1)[:, None]
            if mirrored:
                may |= top >= top.max(0)
            i, j = np.nonzero(may & has)
            return i, j, rho[i, j], (has.sum(1), has.sum(0))

        def _top(self, chunk):
            return self.best[chunk[2]][1] if chunk[2] in self.best else np.full(len(chunk[0]), -1.0)

        def _keep(self, chunk, i, name, rho, compared):
            if not compared.any():
                return
            n = len(chunk[0])
            if chunk[2] not in self.best:
                self.best[chunk[2]] = chunk[0], np.full(n, -1.0), np.full(n, None, object), np.full(n, np.nan), np.zeros(n, np.int64)
            _, top, nearest, its, count = self.best[chunk[2]]
            count += compared
            rank = np.argsort(np.argsort(name, kind="stable"), kind="stable")
            order = np.lexsort((rank, -np.abs(rho), i))
            order = order[np.r_[True, np.diff(i[order]) > 0]] if len(order) else order
            for k in order:
                r, v = i[k], abs(rho[k])
                if v > top[r] or (v == top[r] and name[k] < nearest[r]):
                    top[r], nearest[r], its[r] = v, name[k], rho[k]

        def rows(self):
            for runs, top, nearest, its, count in self.best.values():
                has = top >= 0
                if has.any():
                    yield pd.DataFrame({"run_id": runs[has], "nearest": nearest[has], "rho": its[has], "compared": count[has]})

    return Nearest


def nearest_blocks(a: DataFrame, b: DataFrame, min_overlap: int = 5, block: int = BLOCK) -> DataFrame:
    """(run_id, nearest, rho, compared) of a's runs among b's by cells of blocks: a hot key becomes many even tasks and pairs are never rows. Ties go to the smallest run_id."""
    return _nearest(_met(a, b.select("*"), block, _nearest_of(min_overlap, False), NEAREST))  # two sides, also of one table


NEAREST = "run_id string, nearest string, rho double, compared long"


def _nearest(found: DataFrame) -> DataFrame:
    return found.groupBy("run_id").agg(F.min(F.struct((-F.abs("rho")).alias("neg"), "nearest", "rho")).alias("b"), F.sum("compared").alias("compared")).select("run_id", "b.nearest", "b.rho", "compared")


def novelty(candidates: DataFrame, pool: DataFrame, threshold: float = 0.95, min_overlap: int = 5) -> DataFrame:
    """(run_id, status, score, nearest, correlation, compared, duplicate) of each candidate; ties go to the smallest run_id."""
    one = candidates is pool
    candidates = stored(candidates, "deltas")  # read for the numbers of days and for the pairs
    pool = candidates if one else stored(pool, "deltas")
    best = _nearest(_met(candidates, pool, BLOCK, _nearest_of(min_overlap, one), NEAREST, lies=True)).withColumnRenamed("run_id", "a_run")
    counted = lambda d, label: stored(d.groupBy("run_id", "key").agg(F.count("*").alias("days")), label)  # noqa: E731  a row for each run
    days = counted(candidates, "days")
    members = days if one else counted(pool, "members")
    others = members.groupBy("key").agg(F.count("run_id").alias("members"))
    own = members.select("run_id", "key").withColumn("own", F.lit(1))
    d = days.join(others, "key", "left").join(own, ["run_id", "key"], "left").join(best, F.col("run_id") == F.col("a_run"), "left")
    rest = F.coalesce("members", F.lit(0)) - F.coalesce("own", F.lit(0))
    status = F.when(F.col("days") < 2, "empty_candidate").when(rest == 0, "empty_pool").when(F.col("a_run").isNull(), "insufficient_overlap").otherwise("resolved")
    top, ok = F.abs("rho"), status == "resolved"
    return d.select("run_id", status.alias("status"), F.when(ok, 1 - top).alias("score"), F.when(ok, F.col("nearest")).alias("nearest"), F.when(ok, F.col("rho")).alias("correlation"), F.when(ok, F.col("compared")).alias("compared"), F.when(ok, top >= threshold).alias("duplicate"))


def novelty_blocks(deltas: DataFrame, min_overlap: int = 5, block: int = BLOCK) -> DataFrame:
    """(run_id, nearest, rho, compared) of every run among the others of its comparability key. Each unordered pair of blocks is one cell, which answers for both."""
    return _nearest(_met(deltas, deltas, block, _nearest_of(min_overlap, True), NEAREST))


def verdict(sharpe: float = 0, drawdown: float = 1, win_rate: float = 0, trades: int = 1) -> Column:
    """passed or failed; a missing metric fails."""
    ok = (F.col("sharpe") > sharpe) & (F.col("max_drawdown") < drawdown) & (F.col("win_rate") > win_rate) & (F.col("total_trades") >= trades)
    return F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed")


def promotion_gate(candidates: DataFrame, min_warmup: int = 10, min_trades: int = 1) -> DataFrame:
    """candidates (run_id, ts_from, ts_to, holdout_from, holdout_to, complete, timeframe_equal, warmup_steps, points and metrics of the hold-out)
    with outcome: the first reason to reject, else the verdict."""
    reason = F.when(~((F.col("ts_from") <= F.col("holdout_from")) & (F.col("holdout_to") <= F.col("ts_to"))), "holdout_not_covered")
    reason = reason.when(~F.coalesce(F.col("complete") & F.col("timeframe_equal"), F.lit(False)), "evaluation_insufficient")
    reason = reason.when(F.coalesce("warmup_steps", F.lit(0)) < min_warmup, "warmup_insufficient")
    reason = reason.when((F.coalesce("points", F.lit(0)) < 2) | (F.coalesce("total_trades", F.lit(0)) < min_trades), "evaluation_insufficient")
    return candidates.withColumn("outcome", reason.otherwise(verdict(trades=min_trades)))


def attempt_number(attempts: DataFrame, span: int | None = None) -> DataFrame:
    """attempts (epoch_key, attempt_id, created_at) with attempt_no: distinct attempts of an epoch in the order of their first record; replays keep theirs.
    span: a stretch of created_at, a number, that makes a piece of an epoch too large for one task."""
    first = attempts.groupBy("epoch_key", "attempt_id").agg(F.min("created_at").alias("first_at"))
    numbered = running(first, {"attempt_no": ("count", F.lit(1))}, ["epoch_key"], "first_at", span, ["attempt_id"])
    return attempts.join(numbered.withColumn("attempt_no", F.col("attempt_no").cast("int")), ["epoch_key", "attempt_id"])
