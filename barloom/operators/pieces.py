"""Long keys in pieces: windows over one symbol, run or family that no single task has to hold.

A piece is a stretch of the ordering column, `floor(order / span)`, so rows find theirs without any pass over the data, and
windows partitioned by key and piece meet an exchange on both. Two ways lead over a piece's edge:

- `running`: what a row takes from all rows before it is what its own piece gives and what the pieces before carry. The
  totals of the pieces are a table of one row each, scanned by key and joined back.
- `in_pieces`: a frame of n rows needs n rows of the pieces before. Rows are numbered by `running`, cut into pieces of equal
  length, and those near an edge are copied to the next piece; any function over windows of that length then runs unchanged.

The data are read twice and three times, so what is costly to make is better stored first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAST = Window.unboundedPreceding
#: Rows of a piece, about.
ROWS = 100_000


def piece_span(df: DataFrame, keys: list[str], order: str, rows: int = ROWS) -> int:
    """A span of `order` in which the densest key has about `rows` rows: one aggregation, of which one number reaches the driver."""
    per = df.groupBy(*keys).agg(F.count(order).alias("n"), (F.max(order) - F.min(order) + 1).alias("length"))
    dense = per.agg(F.max(F.col("n") / F.col("length"))).first()[0]
    return max(1, int(rows / dense)) if dense else 1


#: The column of a row's piece.
PIECE = "_piece"


def cut(df: DataFrame, order: str, span: int | None) -> DataFrame:
    """df with each row's piece, for calls in a row that share their exchange; as it is where it has that already, or without a span."""
    return df if span is None or PIECE in df.columns else df.withColumn(PIECE, F.floor(F.col(order) / span))


def _present(x: Column) -> Column:
    return F.struct(x.alias("x"))


def running(df: DataFrame, values: dict[str, tuple[str, Column]], keys: list[str], order: str, span: int | None, then: list[str] | None = None) -> DataFrame:
    """df with a column for each of values, name -> (kind, x), over a key's rows up to and with each row in the order of (order, *then).

    Kinds: sum, count, max and min of x; last: the newest x that is not NULL; lag: x of the row before; moments: a struct (n, mean, m2) of
    the x that are not NULL, m2 being the sum of squared distances from the mean, by pairwise merging of pieces (Chan). `order` is a number that is
    not NULL; with span None a key is one piece. With a span no key is NULL. Sums of nothing are NULL, counts 0.

    Rows are exchanged by key and piece, once for any number of calls that share cut()'s column; the totals are a second reading of df.
    """
    kept = df.columns
    local_keys = list(keys)
    if span is not None:
        df, local_keys = cut(df, order, span), [*keys, PIECE]
    by = [order, *(then or [])]
    w = Window.partitionBy(*local_keys).orderBy(F.asc_nulls_last(order), *by[1:])  # the order of tape.grid()
    upto = w.rowsBetween(PAST, 0)
    x = {name: f"_x{i}" for i, name in enumerate(values)}
    df = df.withColumns({x[n]: v for n, (_, v) in values.items()})
    own, total, carry, merged, scanned = {}, {}, {}, {}, []
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(PAST, -1)
    newest = F.struct(*by)
    for i, (name, (kind, _)) in enumerate(values.items()):
        c, t, o, b = F.col(x[name]), f"_t{i}", F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind in ("sum", "max", "min", "count"):
            f = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind]
            own[f"_l{i}"], total[t] = f(c).over(upto), f(c)
            carry[f"_c{i}"] = (F.sum if kind == "count" else f)(t).over(earlier)
            merged[name] = {"sum": F.coalesce(o + b, o, b), "count": o + F.coalesce(b, F.lit(0)), "max": F.greatest(o, b), "min": F.least(o, b)}[kind]
        elif kind == "last":
            own[f"_l{i}"], total[t] = F.last(c, ignorenulls=True).over(upto), F.max_by(c, F.when(c.isNotNull(), newest))
            carry[f"_c{i}"] = F.last(t, ignorenulls=True).over(earlier)
            merged[name] = F.coalesce(o, b)
        elif kind == "lag":  # structs, so that a NULL in the row before is told from no row
            own[f"_l{i}"], total[t] = F.lag(_present(c)).over(w), F.max_by(_present(c), newest)
            carry[f"_c{i}"] = F.last(t, ignorenulls=True).over(earlier)
            merged[name] = F.when(o.isNotNull(), o.x).otherwise(b.x)
        elif kind == "moments":
            three = lambda f: F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")) if f is None else F.struct(F.count(c).over(f).alias("n"), F.avg(c).over(f).alias("mean"), (F.var_pop(c).over(f) * F.count(c).over(f)).alias("m2"))
            own[f"_l{i}"], total[t] = three(upto), three(None)
            scanned.append((f"_c{i}", t))
            merged[name] = chan(F.coalesce(b, _nothing()), o)
        else:
            raise ValueError(f"unknown kind {kind}")
    if span is None:
        merged = {n: F.col(f"_l{i}").x if values[n][0] == "lag" else F.col(f"_l{i}") for i, n in enumerate(values)}
        out = df.withColumns(own)
    else:
        totals = df.groupBy(*local_keys).agg(*(a.alias(n) for n, a in total.items()))
        carried = totals.select(*local_keys, *(c.alias(n) for n, c in carry.items()), *(t for _, t in scanned))
        for name, t in scanned:
            carried = _moments_before(carried, t, name, keys)
        out = df.join(carried, local_keys, "left").withColumns(own)  # by the columns that the windows need
    rest = [c for c in kept if c not in values]
    return out.select(*(F.col(f"`{c}`") for c in rest), *(m.alias(n) for n, m in merged.items()))


#: Pieces of a stretch, and stretches of a longer one, that moments are merged over; levels of these.
FAN, LEVELS = 64, 3


def _moments_before(totals: DataFrame, t: str, name: str, keys: list[str]) -> DataFrame:
    """totals (keys, PIECE, ...), a row for each piece, with `name` in place of the moments t: those of all pieces before. A piece merges the pieces before it in its
    stretch of FAN, these the stretches before in theirs, and so on: FAN * LEVELS at most for each piece, however many there are; above the levels, all that is left."""
    merge = lambda c: F.reduce(c, _nothing(), chan)
    parts, below, at = [], totals.select(*keys, F.col(PIECE).alias("_at0"), F.col(t).alias("_m")), totals
    for level in range(LEVELS):
        up, here = f"_at{level + 1}", f"_at{level}"
        stretch = [*keys, up] if level < LEVELS - 1 else keys
        rows = below.withColumn(up, F.floor(F.col(here) / FAN))
        before = F.collect_list("_m").over(Window.partitionBy(*stretch).orderBy(here).rowsBetween(PAST, -1))
        found = rows.select(*keys, here, merge(before).alias(f"_b{level}"))
        at = at.withColumn(here, F.col(PIECE)) if level == 0 else at.withColumn(here, F.floor(F.col(f"_at{level - 1}") / FAN))
        at = at.join(found, [*keys, here])
        parts.append(F.col(f"_b{level}"))
        of = F.transform(F.array_sort(F.collect_list(F.struct(here, "_m"))), lambda p: p["_m"])
        below = rows.groupBy(*keys, up).agg(merge(of).alias("_m"))
    all_before = reduce(chan, reversed(parts))
    return at.withColumn(name, all_before).drop(t, *(f"_{x}{k}" for x in ("at", "b") for k in range(LEVELS)))


def _nothing() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))


def chan(a: Column, b: Column) -> Column:
    """The moments (n, mean, m2) of two sets together."""
    n = a.n + b.n
    step = b.mean - a.mean
    mean = F.when(a.n == 0, b.mean).when(b.n == 0, a.mean).otherwise(a.mean + step * b.n / n)
    m2 = F.when(a.n == 0, b.m2).when(b.n == 0, a.m2).otherwise(a.m2 + b.m2 + step * step * a.n * b.n / n)
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def var_samp(moments: Column) -> Column:
    return F.when(moments.n > 1, moments.m2 / (moments.n - 1))


def in_pieces(df: DataFrame, make: Callable[[DataFrame], DataFrame], before: int, after: int = 0, rows: int = ROWS, span: int | None = None) -> DataFrame:
    """make(df) for a make whose windows over the symbols' bars reach `before` rows back and `after` rows ahead, at most; it may add columns
    and drop rows. A row stands in its own piece of `rows` bars and in those whose first bars look back on it, so a symbol of any length is
    dealt over many tasks. Columns of the result are make's."""
    keys = ["dataset", "symbol"]
    span = span or piece_span(df, keys, "minute_ts", rows)
    d = running(df, {"_at": ("count", F.lit(1))}, keys, "minute_ts", span).withColumn("_at", F.col("_at") - 1)
    own = F.floor(F.col("_at") / rows)
    first, last = F.greatest(F.floor((F.col("_at") - after) / rows), F.lit(0).cast("long")), F.floor((F.col("_at") + before) / rows)
    d = d.withColumn("_in", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_in") == own)
    d = d.withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("_in").alias("piece"))).drop("_at", "_in")
    return make(d).where("_own").withColumn("symbol", F.col("symbol.name")).drop("_own")
