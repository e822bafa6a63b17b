"""IEEE 754 arithmetic and comparisons, and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.plans.logql_syntax import BYTE_POWERS, DURATION_NS

NAN, INF = float("nan"), float("inf")


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """+ - * / % ^ atan2 on doubles; no error on division by zero."""
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) == ~is_negative_zero(b), F.lit(INF)).otherwise(F.lit(-INF))
        return F.when(F.isnan(b), F.lit(NAN)).when(b == 0, by_zero).otherwise(F.try_divide(a, b))
    if op == "%":
        odd = F.isnan(a) | F.isnan(b) | (b == 0) | F.abs(a).isin(INF)
        return F.when(odd, F.lit(NAN)).when(F.abs(b).isin(INF), a).otherwise(F.try_mod(a, b))
    if op == "^":
        one = (a == 1) & ~F.isnan(a) | (b == 0) & ~F.isnan(b)
        unit = (a == -1) & F.abs(b).isin(INF)
        return F.when(one | unit, F.lit(1.0)).otherwise(F.pow(a, b))
    if op == "atan2":
        return F.atan2(a, b)
    raise ValueError(f"unknown operator {op}")


def is_negative_zero(x: Column) -> Column:
    return (x == 0) & (F.atan2(x, F.lit(-1.0)) < 0)


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison as IEEE has it: NaN is unequal to all, itself included."""
    number = ~F.isnan(a) & ~F.isnan(b)
    held = {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    return ~number | held if op == "!=" else number & held


def nan_min(x: Column) -> Column:
    """Aggregate: the least number; NaN only if there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(x), x)), F.min(x))


def nan_max(x: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x))


def float_of(text: Column) -> Column:
    """Number written in decimal, or null."""
    plain = text.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")
    low = F.lower(text)
    special = F.when(low.rlike(r"\A\+?inf(?:inity)?\z"), F.lit(INF)).when(low.rlike(r"\A-inf(?:inity)?\z"), F.lit(-INF)).when(low == "nan", F.lit(NAN))
    return F.when(plain, text.try_cast("double")).otherwise(special)


_TERM = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"


def duration_of(text: Column) -> Column:
    """Go duration in nanoseconds, or null."""
    units = F.create_map(*[F.lit(x) for k in ("ns", "us", "µs", "μs", "ms", "s", "m", "h") for x in (k, float(DURATION_NS[k]))])
    terms = F.zip_with(F.regexp_extract_all(text, F.lit(_TERM), 1), F.regexp_extract_all(text, F.lit(_TERM), 2), lambda n, u: n.try_cast("double") * F.element_at(units, u))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(text.rlike(r"\A[+-]?0\z"), F.lit(0.0)).when(text.rlike(rf"\A[+-]?(?:{_TERM})+\z"), sign * total)


def bytes_of(text: Column) -> Column:
    """Byte size with a decimal or binary unit, or null."""
    number = F.regexp_replace(F.regexp_extract(text, r"\A\s*([\d.,]+)", 1), ",", "").try_cast("double")
    unit = F.lower(F.trim(F.regexp_extract(text, r"\A\s*[\d.,]+\s*([a-zA-Z]*)\s*\z", 1)))
    power = F.instr(F.lit(BYTE_POWERS), F.substring(unit, 1, 1))
    known = unit.rlike(rf"\A(?:[{BYTE_POWERS}](?:i?b?)|b?)\z")
    base = F.when(F.substring(unit, 2, 1) == "i", F.lit(1024.0)).otherwise(F.lit(1000.0))
    scale = F.when(unit.isin("", "b"), F.lit(1.0)).otherwise(F.pow(base, power.cast("double")))
    return F.when(text.rlike(r"\A\s*[\d.,]+\s*[a-zA-Z]*\s*\z") & known, F.floor(number * scale).cast("double"))
