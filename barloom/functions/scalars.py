"""Scalar functions as column expressions. ANSI-safe: divisions go through try_divide; undefined is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS, DAY_MS = 60_000, 86_400_000
YEAR_MS = 365.25 * DAY_MS


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantize(x: Column | str) -> Column:
    """8 places, half to even, without negative zero."""
    return F.bround(col(x), 8) + F.lit(0.0)


def ieee_divide(a: Column | str, b: Column | str) -> Column:
    """a / b of doubles as IEEE 754 and the SQL have it: over zero an infinity, or NaN for zero and NaN."""
    a, b = col(a), col(b)
    over_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def pct_change(a: Column | str, b: Column | str) -> Column:
    """(a - b) / b * 100; 0 where b is 0 or NULL."""
    return F.coalesce(F.try_divide(col(a) - col(b), col(b)) * 100, F.lit(0.0))


def pct_drop(start: Column | str, end: Column | str) -> Column:
    return F.when(col(start) > 0, (col(start) - col(end)) / col(start) * 100).otherwise(0.0)


def pct_rise(start: Column | str, end: Column | str) -> Column:
    return F.when(col(start) > 0, (col(end) - col(start)) / col(start) * 100).otherwise(0.0)


def clamp(x: Column | str, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(col(x), lit(low)), lit(high))


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def parse_timeframe(x: Column | str) -> Column:
    """`<n><s|m|h|d|w>` to ms; NULL for any other form."""
    c = col(x)
    unit = F.regexp_extract(c, r"^[1-9][0-9]*([smhdw])$", 1)
    ms = F.when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", DAY_MS).when(unit == "w", 7 * DAY_MS)
    return F.when(unit != "", F.regexp_extract(c, r"^([1-9][0-9]*)", 1).try_cast("long") * ms.cast("long"))


def day_of(ms: Column | str) -> Column:
    """UTC day label of a time in ms."""
    return F.date_format(F.timestamp_millis(F.floor(col(ms) / DAY_MS).cast("long") * F.lit(DAY_MS).cast("long")), "yyyy-MM-dd")


def iso_of(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ms_of(iso: Column | str) -> Column:
    return F.unix_millis(F.try_to_timestamp(col(iso)))


def minute_of(ms: Column | str) -> Column:
    return col(ms) - F.pmod(col(ms), F.lit(MINUTE_MS))


def symbol_form(x: Column | str) -> Column:
    return F.upper(F.trim(col(x)))


def fill_price(side: Column, action: Column, base: Column, bps: Column | float) -> Column:
    """Opening a long and closing a short buy, dearer by the slippage; the others sell, cheaper by it."""
    buys = ((side == "long") & (action == "open")) | ((side == "short") & (action == "close"))
    slip = (bps if isinstance(bps, Column) else F.lit(float(bps))) / 1e4
    return base * F.when(buys, 1 + slip).otherwise(1 - slip)


def fee(notional: Column, bps: Column | float) -> Column:
    return notional * (bps if isinstance(bps, Column) else F.lit(float(bps))) / 1e4


def protection_levels(entry: Column, side: Column, stop: Column, take: Column) -> tuple[Column, Column]:
    """(stop price, take price); shorts are mirrored."""
    sign = F.when(side == "long", 1.0).otherwise(-1.0)
    return entry * (1 - sign * stop), entry * (1 + sign * take)


#: Raw close reasons by what they mean.
TAKE_PROFIT = ["take_profit", "take_profit_final", "tp1", "tp2", "take_hit"]
STOP_LOSS = ["stop_loss", "sl", "hard_stop", "stop_hit"]
TIME_EXIT = ["time_exit", "max_hold", "watch_expire"]


def normalize_close_reason(raw: Column | str) -> Column:
    r = F.lower(col(raw))
    return F.when(r.isin(TAKE_PROFIT), "take_profit").when(r.isin(STOP_LOSS), "stop_loss").when(r.isin(TIME_EXIT), "time_exit").otherwise("other")


def trade_key(symbol: Column | str, entry_ts: Column | str, side: Column | str) -> Column:
    return F.concat_ws("|", col(symbol), col(entry_ts).cast("string"), col(side))


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner's rule; the highest power comes first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


#: Numerical Recipes' erfc polynomial in t, and Acklam's rational approximations, highest powers first.
ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
ACKLAM_A = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.38357751867269e2, -3.066479806614716e1, 2.506628277459239]
ACKLAM_B = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0]
ACKLAM_C = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
ACKLAM_D = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0]
ACKLAM_LOW = 0.02425


def normal_cdf(x: Column | str) -> Column:
    z = -col(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * F.abs(z))
    tail = t * F.exp(-z * z + _polynomial(t, ERFC))
    return 0.5 * F.when(z >= 0, tail).otherwise(2 - tail)


def normal_inv_cdf(p: Column | str) -> Column:
    """Inverse of the normal CDF; NULL outside (0, 1)."""
    p = col(p)
    tail = lambda q: F.try_divide(_polynomial(q, ACKLAM_C), _polynomial(q, ACKLAM_D))
    low = tail(F.sqrt(-2 * F.log(F.when(p < ACKLAM_LOW, p))))
    high = -tail(F.sqrt(-2 * F.log(F.when(p > 1 - ACKLAM_LOW, 1 - p))))
    q = p - 0.5
    middle = F.try_divide(_polynomial(q * q, ACKLAM_A) * q, _polynomial(q * q, ACKLAM_B))
    return F.when((p > 0) & (p < 1), F.when(p < ACKLAM_LOW, low).when(p > 1 - ACKLAM_LOW, high).otherwise(middle))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 over JSON with the fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def seeded_draw(seed: Column | str, index: int = 0) -> Column:
    """The index-th draw in [0, 1) of the 32-bit mulberry generator started with the seed, in 64-bit column arithmetic."""
    mask = F.lit(0xFFFFFFFF)

    def times(a: Column, b: Column) -> Column:  # low 32 bits of a product, without leaving 64 bits
        high, low = F.shiftright(b, 16), b.bitwiseAND(F.lit(0xFFFF))
        return (F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16) + a * low).bitwiseAND(mask)

    state = (col(seed).cast("long").bitwiseAND(mask) + F.lit(0x6D2B79F5 * (index + 1) & 0xFFFFFFFF)).bitwiseAND(mask)
    t = times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    mixed = (t + times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask).bitwiseXOR(t)
    return mixed.bitwiseXOR(F.shiftright(mixed, 14)).cast("double") / 4294967296.0
