"""Linear recurrences y[t] = a * y[t-1] + b * x[t], seeded by the mean or the sum of the first n values, as window sums.

The seed is part of the sum: the first n values weigh 1 / n (or 1) and don't decay until the n-th. From there on a symbol's
values are cut into blocks so long that a to the power of a block's length is below e^-REACH. Within a block the recurrence
is a running sum, y[o] = a^o * sum(c[k] * a^-k), and of all that lies before a block only the end of the one before it counts:
what lies further back is below the rounding of a double.

A symbol too long for one task is cut into pieces (pieces.py). Each value is an affine map of the one before, and so is a whole piece:
y_out = a^m * y_in + z, where z is what the piece gives from nothing. The maps of the pieces, one row each, are composed in
order, and what comes in is added to the piece's own values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pieces import PIECE, cut, running
from .tape import KEYS, PAST

#: e^REACH is far from the largest double, and e^-REACH far below its rounding.
REACH = 200.0


@dataclass(frozen=True)
class Recurrence:
    """counts: a column that is NULL where x is; recurrences that name the same one share their windows."""

    out: str
    x: str
    n: int
    a: float
    b: float
    seed: str = "mean"
    counts: str | None = None

    def block(self) -> int:
        """Values of a block."""
        return max(2, math.floor(REACH / -math.log(self.a))) if 0 < self.a < 1 else 1 << 60


def ema(out: str, x: str, period: int, counts: str | None = None) -> Recurrence:
    k = 2 / (period + 1)
    return Recurrence(out, x, period, 1 - k, k, "mean", counts)


def rma(out: str, x: str, period: int, counts: str | None = None) -> Recurrence:
    return Recurrence(out, x, period, 1 - 1 / period, 1 / period, "mean", counts)


def wilder_sum(out: str, x: str, period: int, counts: str | None = None) -> Recurrence:
    return Recurrence(out, x, period, 1 - 1 / period, 1.0, "sum", counts)


def linear_recurrences(df: DataFrame, specs: list[Recurrence], span: int | None = None) -> DataFrame:
    """df with a column for each spec, NULL before its seed. Where x is NULL the recurrence stands still.

    span: a stretch of minute_ts that makes a piece; None for whole symbols."""
    kept = df.columns
    groups: dict[tuple, list[Recurrence]] = {}
    for r in specs:
        groups.setdefault((r.counts or r.x, r.n, r.a), []).append(r)
    counted = {c: f"_n{i}" for i, c in enumerate(dict.fromkeys(g[0] for g in groups))}
    keys = KEYS if span is None else [*KEYS, PIECE]
    df = running(cut(df, "minute_ts", span), {n: ("count", F.col(c)) for c, n in counted.items()}, KEYS, "minute_ts", span)
    own: dict[str, str] = {}
    for g, ((counts, n, a), members) in enumerate(groups.items()):
        at, present, block, place = F.col(counted[counts]), F.col(counts).isNotNull(), f"_b{g}", f"_o{g}"
        own |= {r.out: f"_y{g}_{i}" for i, r in enumerate(members)}
        size = members[0].block()
        # a row without a value stands where the next one will, and is read one step back
        steps = F.greatest(at - n + F.when(present, 0).otherwise(1), F.lit(0))
        df = df.withColumns({block: F.floor(steps / size), place: steps % size, f"_d{g}": F.greatest(at - n, F.lit(0)) - steps})
        within = Window.partitionBy(*keys, block).orderBy(F.asc_nulls_last("minute_ts")).rowsBetween(PAST, 0)
        before = Window.partitionBy(*keys).orderBy(block, F.asc_nulls_last("minute_ts")).rowsBetween(PAST, -1)  # blocks follow time, so the order of `within` serves
        if a == 0:  # no memory: only the newest value
            value = {r.out: F.when(present, F.when(at <= n, F.col(r.x) / (n if r.seed == "mean" else 1)).otherwise(r.b * F.col(r.x))) for r in members}
            df = df.withColumns({own[r.out]: F.when(at <= n, F.sum(value[r.out]).over(before.rowsBetween(PAST, 0))).otherwise(F.last(value[r.out], ignorenulls=True).over(before.rowsBetween(PAST, 0))) for r in members})
            continue
        power = F.pow(F.lit(a), F.col(place))
        sums, ends, made = {}, {}, {}
        for r in members:
            weight = F.when(at <= n, 1.0 / n if r.seed == "mean" else 1.0).otherwise(r.b)
            sums[own[r.out]] = F.coalesce(F.sum(F.col(r.x) * weight * F.pow(F.lit(a), -F.col(place))).over(within) * power, F.lit(0.0))
        df = df.withColumns(sums)
        end = F.when(present & (F.col(place) == size - 1), F.struct(*(F.col(own[r.out]).alias(own[r.out]) for r in members)))
        ends[f"_e{g}"] = F.last(end, ignorenulls=True).over(before)
        df = df.withColumns(ends)
        for r in members:
            carried = F.when(F.col(block) > 0, F.col(f"_e{g}.{own[r.out]}")) * power * a
            made[own[r.out]] = (F.col(own[r.out]) + F.coalesce(carried, F.lit(0.0))) * F.pow(F.lit(a), F.col(f"_d{g}"))
        df = df.withColumns(made)
    if span is not None:
        df = _with_pieces_before(df, groups, counted, own, keys)
    ready = {r.out: F.when(F.col(counted[r.counts or r.x]) >= r.n, F.col(own[r.out])) for r in specs}
    return df.select(*(F.col(f"`{c}`") for c in kept if c not in ready), *(v.alias(k) for k, v in ready.items()))


def _composed(y: str, c: str, n: int, a: float):
    """The affine maps of two stretches as one; `at` counts the steps taken."""

    def compose(acc: Column, piece: Column) -> Column:
        at = F.greatest(piece[c] - n, F.lit(0)).cast("long")
        faded = acc.y * F.pow(F.lit(a), at - acc.at) if a else F.when(at == acc.at, acc.y).otherwise(0.0)
        return F.struct(at.alias("at"), (piece[y] + faded).alias("y"))

    return compose


def _with_pieces_before(df: DataFrame, groups: dict, counted: dict[str, str], own: dict[str, str], keys: list[str]) -> DataFrame:
    """Each piece's values with what comes in from the pieces before it."""
    steps = lambda counts, n: F.greatest(F.col(counted[counts]) - n, F.lit(0))
    last = F.max_by(F.struct(*(F.col(n) for n in counted.values()), *(F.col(y) for y in own.values())), "minute_ts")
    pieces = df.groupBy(*keys).agg(last.alias("_end"))
    earlier = Window.partitionBy(*KEYS).orderBy(PIECE).rowsBetween(PAST, -1)
    pieces = pieces.withColumn("_ends", F.collect_list("_end").over(earlier))
    incoming = {}
    for (counts, n, a), members in groups.items():
        for r in members:
            y, c = own[r.out], counted[counts]
            incoming[f"_in_{y}"] = F.aggregate("_ends", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("y")), _composed(y, c, n, a))
    df = df.join(pieces.select(*keys, *(v.alias(k) for k, v in incoming.items())), keys, "left")
    total = {}
    for (counts, n, a), members in groups.items():
        for r in members:
            y = own[r.out]
            since = steps(counts, n) - F.col(f"_in_{y}.at")
            faded = F.col(f"_in_{y}.y") * F.pow(F.lit(a), since) if a else F.when(since == 0, F.col(f"_in_{y}.y")).otherwise(0.0)
            total[y] = F.coalesce(F.col(y), F.lit(0.0)) + F.coalesce(faded, F.lit(0.0))
    return df.withColumns(total)
