"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lenient_int(text) -> Column:
    """Whole number in a text, truncated; anything unreadable (or null) is 0."""
    text = _c(text)
    # A trailing d or f is a Java number suffix, not part of a plain number.
    plain = F.when(~text.rlike(r"[dDfF]\s*$"), text)
    return F.coalesce(plain.try_cast("double").try_cast("bigint"), F.lit(0))


def truncate(value) -> Column:
    """Whole part of a number, toward zero."""
    return _c(value).cast("bigint")


def cyclic(position: Column, period: int) -> tuple[Column, Column]:
    """A position in a cycle as (sine, cosine)."""
    angle = F.lit(2.0) * F.pi() * position / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def hour_cycle(ts) -> tuple[Column, Column]:
    return cyclic(F.hour(_c(ts)), 24)


def weekday_cycle(ts) -> tuple[Column, Column]:
    """Monday is day 0."""
    return cyclic(F.weekday(_c(ts)), 7)


def guarded_ratio(part, whole, scale: float = 1.0) -> Column:
    """part / whole * scale where whole is positive, else 0."""
    part, whole = _c(part), _c(whole)
    return F.when(whole > 0, part / whole * F.lit(scale)).otherwise(F.lit(0.0))


def percent_of(used, capacity) -> Column:
    """Null where the capacity is zero or missing."""
    return F.try_divide(_c(used), _c(capacity)) * F.lit(100.0)


def hours_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(3.6e9)


def days_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(8.64e10)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 otherwise (null counts as not holding)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def at_least_zero(value) -> Column:
    """Clamp below at zero and keep nulls."""
    value = _c(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def softmax_positive(logit0, logit1) -> Column:
    """Probability of the second of two classes."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(logit0) - _c(logit1)))


def logistic(score) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(score)))


def first_set_flag(flags: list[str], none: str = "none") -> Column:
    """Name of the first column (in list order) that equals 1."""
    picks = [F.when(F.col(name) == 1, F.lit(name)) for name in flags]
    return F.coalesce(*picks, F.lit(none))


def column_or(df, name: str, default) -> Column:
    """The column if the table has it, else a constant; a null in the column stays null."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def risk_status(risk) -> Column:
    risk = _c(risk)
    return F.when(risk, F.lit("At Risk")).when(~risk, F.lit("Safe")).otherwise(F.lit("No Data"))


def fixed(value, digits: int) -> Column:
    """The number with so many decimals, rounded from its exact binary value, ties to even."""
    return F.regexp_replace(F.format_number(_c(value), digits), ",", "")


def _one_decimal(value: Column) -> Column:
    """As `fixed` with one decimal, for values from 0 on, but ties go up."""
    is_tie = (value * 4) % 2 == 1
    return fixed(F.when(is_tie, value + F.lit(0.01)).otherwise(value), 1)


def percent_text(share) -> Column:
    share = _c(share)
    return F.when(share.isNotNull(), F.concat(_one_decimal(share * 100), F.lit("%"))
                  ).otherwise(F.lit("—"))


def days_text(days) -> Column:
    days = _c(days)
    return F.when(days.isNotNull(), F.concat(_one_decimal(days), F.lit(" days"))
                  ).otherwise(F.lit("—"))


def or_dash(text) -> Column:
    """The text, or a dash where it is missing or empty."""
    text = _c(text)
    return F.when(text.isNotNull() & (text != ""), text).otherwise(F.lit("—"))


def contains_ignoring_case(text, needle: str) -> Column:
    """Literal substring test; % and _ have no special meaning."""
    return F.lower(_c(text)).contains(F.lit(needle.lower()))
