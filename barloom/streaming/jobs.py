"""Structured Streaming jobs for live bars; each equals its batch operator on replayed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.recurrence import Recurrence
from ..operators.tape import kinds_long


def stream_minutes(rows: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Rows with an event time `ts`, one for each (symbol, minute_ts): the first to come within the watermark. (The batch
    operator keeps the last; a stream can't wait for it.)"""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "minute_ts"])


def stream_coverage(rows: DataFrame, width: str = "1 day", delay: str = "2 minutes") -> DataFrame:
    """(window, symbol, kind, covered, bars) in tumbling windows, sent when the watermark has passed them."""
    w = kinds_long(rows.withColumn("minute_ts", F.unix_millis("ts"))).withColumn("ts", F.timestamp_millis("minute_ts")).withWatermark("ts", delay)
    return w.groupBy(F.window("ts", width), "symbol", "kind").agg(F.count_if("covered").alias("covered"), F.count("*").alias("bars"))


#: Typed state with timers needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Bars of a symbol in the order of time, one at a time, to step(own, values) -> (own, results).

    A bar waits as one entry of a map by its minute, so a batch writes what is new in it and takes out what is done, and nothing else. A timer
    at the first waiting minute fires when the watermark has passed it. `own` is a row of numbers; it and the newest minute done go when a
    symbol has been idle for ttl_ms of event time.
    """

    def __init__(self, columns: list[str], own: str, start: tuple, made: list[str], step: Callable[[tuple, tuple], tuple[tuple, tuple]], ttl_ms: int):
        self.columns, self.own_schema, self.start, self.made, self.step, self.ttl_ms = columns, own, start, made, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "minute_ts long", ", ".join(f"v{i} double" for i in range(len(self.columns))))
        self.own = handle.getValueState("own", self.own_schema)
        self.last = handle.getValueState("last", "minute_ts long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else -1
        first = None
        for g in rows:
            for t, *values in g[["minute_ts", *self.columns]].drop_duplicates("minute_ts").astype(object).itertuples(index=False):
                t = int(t)
                if t > last and not self.waiting.containsKey((t,)):  # of equal minutes the first to come counts
                    self.waiting.updateValue((t,), tuple(None if v is None or v != v else float(v) for v in values))
                    first = t if first is None else min(first, t)
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())
        own = tuple(self.own.get()) if self.own.exists() else self.start
        last = self.last.get()[0] if self.last.exists() else -1
        out = []
        for t, values in held:
            if t > mark:
                break
            own, made = self.step(own, values)
            out.append((key[0], t, *made))
            self.waiting.removeKey((t,))
            last = t
        if out:
            self.own.update(own)
            self.last.update((last,))
        if len(held) > len(out):
            self.handle.registerTimer(held[len(out)][0])
        elif last + self.ttl_ms > mark:
            self.handle.registerTimer(last + self.ttl_ms)
        else:
            self.own.clear()
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["symbol", "minute_ts", *self.made])

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, columns: list[str], schema: str, own: str, start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]], delay: str, ttl_ms: int) -> DataFrame:
    """(symbol, minute_ts, <schema>): for each symbol, step over its bars' values of `columns` in the order of time.

    Bars wait in the state until the watermark of the event time `ts` has passed them, so those up to `delay` late take their place; of equal
    minutes the first to come counts. Later ones Spark itself leaves out and counts (numRowsDroppedByWatermark in the query's progress).
    """
    processor = InOrder(columns, own, start, [f.split()[0] for f in schema.split(", ")], step, ttl_ms)
    rows = rows.select("symbol", "minute_ts", "ts", *dict.fromkeys(columns)).withWatermark("ts", delay)
    return rows.groupBy("symbol").transformWithStateInPandas(processor, f"symbol string, minute_ts long, {schema}", "append", "eventTime")


def stream_recurrences(rows: DataFrame, specs: list[Recurrence], delay: str = "2 minutes", ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """(symbol, minute_ts, <out of each spec>) for rows (symbol, minute_ts, ts, <x of each spec>): the linear recurrences of the batch operator,
    with three numbers of state for each."""

    def step(own: tuple, values: tuple) -> tuple[tuple, tuple]:
        after, out = [], []
        for i, (s, x) in enumerate(zip(specs, values, strict=True)):
            n, total, y = own[3 * i : 3 * i + 3]
            if x is not None:
                n += 1
                if n <= s.n:
                    total += x
                    y = total / (s.n if s.seed == "mean" else 1)
                else:
                    y = s.a * y + s.b * x
            after += [n, total, y]
            out.append(y if n >= s.n else None)
        return tuple(after), tuple(out)

    own = ", ".join(f"n{i} long, total{i} double, y{i} double" for i in range(len(specs)))
    return _in_order(rows, [s.x for s in specs], ", ".join(f"{s.out} double" for s in specs), own, (0, 0.0, 0.0) * len(specs), step, delay, ttl_ms)


def stream_signals(rows: DataFrame, delay: str = "2 minutes", ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """(symbol, minute_ts, signal) of the momentum condition for rows (symbol, minute_ts, ts, close); state: the last two closes."""

    def step(own: tuple, values: tuple) -> tuple[tuple, tuple]:
        a, b = own
        return (b, values[0]), (a is not None and b is not None and b > a,)

    return _in_order(rows, ["close"], "signal boolean", "a double, b double", (None, None), step, delay, ttl_ms)


def run_available(stream: DataFrame, path: str) -> StreamingQuery:
    """Runs a stream over all there is, into Parquet files at path; checkpoints lie beside them, so a later run goes on where this one ended."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def admit_window(requests: DataFrame, closed: DataFrame) -> DataFrame:
    """requests (request_id, dataset, ts_from, ts_to) cut to the dataset's closed interval (dataset, closed_from, closed_to): effective_from and
    effective_to, clamped, admitted (false if nothing is left or the dataset has no closed interval)."""
    j = requests.join(closed, "dataset", "left")
    a, b = F.greatest("ts_from", "closed_from"), F.least("ts_to", "closed_to")
    ok = F.coalesce(F.col("closed_from").isNotNull() & (a < b), F.lit(False))
    j = j.withColumn("admitted", ok).withColumn("effective_from", F.when(ok, a)).withColumn("effective_to", F.when(ok, b))
    return j.withColumn("clamped", F.coalesce((F.col("effective_from") != F.col("ts_from")) | (F.col("effective_to") != F.col("ts_to")), F.lit(False))).drop("closed_from", "closed_to")


def still_admitted(decisions: DataFrame, closed: DataFrame) -> DataFrame:
    """admit_window's decisions with `confirmed`: the window it gave comes back whole against the interval as it is now."""
    again = admit_window(decisions.select("request_id", "dataset", F.col("effective_from").alias("ts_from"), F.col("effective_to").alias("ts_to")), closed)
    return decisions.join(again.select("request_id", (F.col("admitted") & ~F.col("clamped")).alias("confirmed")), "request_id")
