"""Small column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import Window


def within(x: Column, low: float, high: float, half_open: bool = False) -> Column:
    return (x >= low) & ((x < high) if half_open else (x <= high))


def strictly_between(x: Column, low: Column, high: Column) -> Column:
    return (x > low) & (x < high)


def in_window(time: Column, window: Window) -> Column:
    return within(time, window.low, window.high, window.half_open)


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def at_rail(x: Column, rail: float) -> Column:
    """False for null and NaN, as comparisons with NaN are."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) >= rail), F.lit(False))


def sign_match(a: Column, b: Column) -> Column:
    """Null when either side is missing."""
    return F.signum(a) == F.signum(b)


def side_of(value: Column) -> Column:
    """``R`` above zero, ``L`` below, else the empty string."""
    return F.when(value > 0, "R").when(value < 0, "L").otherwise("")


def flag_code(flag: Column) -> Column:
    """Unknown, false and true as -1, 0 and 1."""
    return F.coalesce(flag.cast("int"), F.lit(-1)).cast("tinyint")


def flag_of_text(text: Column) -> Column:
    """Texts ``true`` and ``1`` are true, all others false."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1"), F.lit(False))


def reasons(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order, joined by semicolons."""
    joined = F.concat_ws(";", *[F.when(condition, name) for name, condition in named])
    return F.when(joined == "", "none").otherwise(joined)


def decibels(part: Column, base: Column, epsilon: float) -> Column:
    return 10 * F.log10((part + epsilon) / (base + epsilon))


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def keyed_seed(seed: int, *parts: Column) -> Column:
    """A seed that depends on the key alone, not on the order of work."""
    return (F.crc32(F.concat_ws("|", *parts).cast("binary")) + F.lit(seed)) % F.lit(2**32 - 1)


def array_quantile(ordered: Column, q: Column) -> Column:
    """Quantile of an ascending array, linear between ranks; null of none."""
    rank = q * (F.size(ordered) - 1)
    low = F.floor(rank).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, below + (above - below) * (rank - low))


def neat(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
