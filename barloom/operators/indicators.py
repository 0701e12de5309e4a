"""The eight indicators, as of each bar, that bar included; NULL during warm-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .pieces import PIECE, cut, running
from .recurrence import ema as _ema
from .recurrence import linear_recurrences, rma, wilder_sum
from .tape import KEYS, grid, source_column

#: Defaults of each indicator's parameters.
CATALOG: dict[str, dict[str, float]] = {"sma": {"period": 20}, "ema": {"period": 20}, "rsi": {"period": 14}, "atr": {"period": 14}, "adx": {"period": 14}, "macd": {"fast": 12, "slow": 26, "signal": 9}, "bollinger": {"period": 20, "stddev": 2}, "stochastic": {"k": 14, "d": 3, "smooth": 1}}
SOURCES = ("close", "open", "high", "low", "volume", "hlc3", "ohlc4")
RANGED = ("atr", "adx", "stochastic")  # these read high, low and close, whatever the source


def _full(value: Column, x: Column, n: int) -> Column:
    return F.when(F.count(x).over(grid(1 - n, 0)) == n, value)


def sma(period: int = 20, source: str = "close") -> Column:
    x = source_column(source)
    return _full(F.avg(x).over(grid(1 - period, 0)), x, period)


def bollinger(period: int = 20, stddev: float = 2, source: str = "close") -> Column:
    x = source_column(source)
    mean, sigma = F.avg(x).over(grid(1 - period, 0)), F.stddev_pop(x).over(grid(1 - period, 0))
    return _full(F.struct((mean - stddev * sigma).alias("lower"), mean.alias("middle"), (mean + stddev * sigma).alias("upper")), x, period)


def stochastic(df: DataFrame, k: int = 14, d: int = 3, smooth: int = 1, out: str = "stochastic") -> DataFrame:
    """df with a struct (k, d): the close's place in the range of the last k bars, smoothed; 50 in a flat range."""
    low, high = F.min("low").over(grid(1 - k, 0)), F.max("high").over(grid(1 - k, 0))
    raw = F.when(high == low, F.lit(50.0)).otherwise(100 * F.try_divide(F.col("close") - low, high - low))
    df = df.withColumn("_raw", _full(raw, F.col("close"), k))
    df = df.withColumn("_k", _full(F.avg("_raw").over(grid(1 - smooth, 0)), F.col("_raw"), smooth))
    ready = _full(F.avg("_k").over(grid(1 - d, 0)), F.col("_k"), d)
    df = df.withColumn("_d", ready)
    return df.withColumn(out, F.when(F.col("_d").isNotNull(), F.struct(F.col("_k").alias("k"), F.col("_d").alias("d")))).drop("_raw", "_k", "_d")


def ema(df: DataFrame, period: int = 20, source: str = "close", out: str = "ema", span: int | None = None) -> DataFrame:
    """span, here and below: the stretch of minute_ts that makes a piece of a symbol too long for one task (pieces.piece_span() finds one)."""
    return linear_recurrences(df.withColumn("_x", source_column(source)), [_ema(out, "_x", period)], span).drop("_x")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, source: str = "close", out: str = "macd", span: int | None = None) -> DataFrame:
    """df with a struct (macd, signal, histogram), NULL until the signal is ready."""
    df, hidden = _cut(df, span)
    df = linear_recurrences(df.withColumn("_x", source_column(source)), [_ema("_f", "_x", fast), _ema("_s", "_x", slow)], span)
    df = linear_recurrences(_kept(df.withColumn("_line", F.col("_f") - F.col("_s")), span), [_ema("_sig", "_line", signal)], span)
    value = F.struct(F.col("_line").alias("macd"), F.col("_sig").alias("signal"), (F.col("_line") - F.col("_sig")).alias("histogram"))
    return df.withColumn(out, F.when(F.col("_sig").isNotNull(), value)).drop("_x", "_f", "_s", "_line", "_sig", *hidden)


def _cut(df: DataFrame, span: int | None) -> tuple[DataFrame, list[str]]:
    """df with its pieces, so that the steps of an indicator share one exchange, and what to drop in the end."""
    return cut(df, "minute_ts", span), [] if span is None or PIECE in df.columns else [PIECE]


def _kept(df: DataFrame, span: int | None) -> DataFrame:
    """In pieces each step reads what the one before gives several times, so it is stored."""
    return df if span is None else stored(df, "pieces")


def _before(df: DataFrame, columns: dict[str, Column], span: int | None) -> DataFrame:
    """df with columns of the bar before."""
    return running(df, {name: ("lag", c) for name, c in columns.items()}, KEYS, "minute_ts", span)


def rsi(df: DataFrame, period: int = 14, source: str = "close", out: str = "rsi", span: int | None = None) -> DataFrame:
    df, hidden = _cut(df, span)
    df = _before(df, {"_x": source_column(source)}, span)
    change = source_column(source) - F.col("_x")
    df = df.withColumns({"_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))})
    df = linear_recurrences(_kept(df, span), [rma("_g", "_up", period, "_up"), rma("_l", "_down", period, "_up")], span)
    value = F.when(F.col("_l") == 0, 100.0).when(F.col("_g") == 0, 0.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("_g"), F.col("_l"))))
    return df.withColumn(out, F.when(F.col("_l").isNotNull(), value)).drop("_x", "_up", "_down", "_g", "_l", *hidden)


def _true_range(before: Column, first: bool) -> Column:
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before.isNotNull(), tr).otherwise(F.col("high") - F.col("low") if first else F.lit(None).cast("double"))


def atr(df: DataFrame, period: int = 14, out: str = "atr", span: int | None = None) -> DataFrame:
    df, hidden = _cut(df, span)
    df = _before(df, {"_x": F.col("close")}, span).withColumn("_tr", _true_range(F.col("_x"), False))
    return linear_recurrences(_kept(df, span), [rma(out, "_tr", period)], span).drop("_x", "_tr", *hidden)


def adx(df: DataFrame, period: int = 14, out: str = "adx", span: int | None = None) -> DataFrame:
    df, hidden = _cut(df, span)
    df = _before(df, {"_x": F.col("close"), "_high": F.col("high"), "_low": F.col("low")}, span)
    up, down = F.col("high") - F.col("_high"), F.col("_low") - F.col("low")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = df.withColumns({"_tr": _true_range(F.col("_x"), True), "_pdm": zero(F.when((up > down) & (up > 0), up)), "_mdm": zero(F.when((down > up) & (down > 0), down))})
    df = linear_recurrences(_kept(df, span), [wilder_sum("_t", "_tr", period, "_tr"), wilder_sum("_p", "_pdm", period, "_tr"), wilder_sum("_m", "_mdm", period, "_tr")], span)
    p, m = (zero(100 * F.try_divide(F.col(c), F.col("_t"))) for c in ("_p", "_m"))
    dx = zero(100 * F.try_divide(F.abs(p - m), p + m))
    df = linear_recurrences(_kept(df.withColumn("_dx", F.when(F.col("_t").isNotNull(), dx)), span), [rma(out, "_dx", period)], span)
    return df.drop("_x", "_high", "_low", "_tr", "_pdm", "_mdm", "_t", "_p", "_m", "_dx", *hidden)


def indicator_key(name: str, params: dict[str, float], source: str) -> str:
    return f"{name}|{','.join(f'{k}={params[k]}' for k in sorted(params))}|{source}"


def resolve(request: dict) -> tuple[str, dict[str, float], str]:
    return request["name"], CATALOG[request["name"]] | request.get("params", {}), request.get("source", "close")


def validate_requests(requests: list[dict]) -> list[tuple[str, str]]:
    """All issues as (path, code), sorted; empty if the requests can be computed."""
    issues = []
    for i, r in enumerate(requests):
        at = f"requests[{i}]"
        if r.get("name") not in CATALOG:
            issues.append((f"{at}.name", "unsupported_indicator"))
            continue
        if r.get("source", "close") not in SOURCES:
            issues.append((f"{at}.source", "unsupported_source"))
        given = r.get("params", {})
        for k, v in given.items():
            whole = isinstance(v, int) and not isinstance(v, bool) and v >= 1
            if k not in CATALOG[r["name"]]:
                issues.append((f"{at}.params.{k}", "unknown_param"))
            elif not (whole or k == "stddev" and isinstance(v, (int, float)) and v > 0):
                issues.append((f"{at}.params.{k}", "invalid_param"))
        p = CATALOG[r["name"]] | given
        if r["name"] == "macd" and isinstance(p["fast"], int) and isinstance(p["slow"], int) and p["fast"] >= p["slow"]:
            issues.append((f"{at}.params", "fast_not_below_slow"))
    return sorted(issues)


def indicator_requests(df: DataFrame, requests: list[dict]) -> DataFrame:
    """df with one column for each distinct request, named by its canonical key. All share one partitioning."""
    if issues := validate_requests(requests):
        raise ValueError(str(issues))
    wanted = {indicator_key(*r): r for r in map(resolve, requests)}
    emas = {k: r for k, r in wanted.items() if r[0] == "ema"}
    for key, (name, p, source) in wanted.items():
        if name == "sma":
            df = df.withColumn(key, sma(p["period"], source))
        elif name == "bollinger":
            df = df.withColumn(key, bollinger(p["period"], p["stddev"], source))
        elif name == "stochastic":
            df = stochastic(df, p["k"], p["d"], p["smooth"], key)
    if emas:
        for _, _, source in emas.values():
            df = df.withColumn(f"_x_{source}", source_column(source))
        df = linear_recurrences(df, [_ema(k, f"_x_{s}", p["period"]) for k, (_, p, s) in emas.items()])
        df = df.drop(*{f"_x_{s}" for _, _, s in emas.values()})
    for key, (name, p, source) in wanted.items():
        if name == "rsi":
            df = rsi(df, p["period"], source, key)
        elif name == "macd":
            df = macd(df, p["fast"], p["slow"], p["signal"], source, key)
        elif name in ("atr", "adx"):
            df = {"atr": atr, "adx": adx}[name](df, p["period"], key)
    return df


