"""Sizes in text: parsing, greedy matching within a tolerance, units and formatting, in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import norm, strip

SIZES = "array<array<double>>"
TOLERANCE_MM = 5.0


def _segment(text: Column) -> Column:
    """[[a]] or [[a, b]] in millimetres of one segment, else []: a segment with x or * gives its first two numbers in
    order of size, one without must hold exactly one. Without a unit it is centimetres."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double"))
    factor = F.when(F.contains(text, F.lit("mm")), 1.0).otherwise(10.0)
    scaled = F.transform(numbers, lambda n: n * factor)
    none = F.array().cast(SIZES)
    pair = F.contains(text, F.lit("x")) | F.contains(text, F.lit("*"))
    return F.when(pair, F.when(F.size(scaled) >= 2, F.array(F.array_sort(F.slice(scaled, 1, 2)))).otherwise(none)).otherwise(F.when(F.size(scaled) == 1, F.array(scaled)).otherwise(none))


def parse_sizes(value: Column) -> Column:
    """All sizes of a text, segments between '/'."""
    return F.flatten(F.transform(F.split(norm(value), "/"), lambda s: _segment(strip(s))))


def greedy_match(gt: Column, pred: Column, tolerance_mm: float = TOLERANCE_MM) -> Column:
    """struct(missing, remaining): each true size in order takes the first remaining predicted one of as many dimensions
    that is within the tolerance in each. First fit, not a maximum matching."""
    none = F.array().cast(SIZES)

    def fits(a: Column, b: Column) -> Column:
        near = F.zip_with(a, b, lambda p, q: F.coalesce(F.abs(p - q) <= tolerance_mm, F.lit(False)))
        return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)

    def step(state: Column, size: Column) -> Column:
        rest = state["remaining"]
        at = F.array_position(F.transform(rest, lambda p: fits(size, p)), True)
        return F.struct(
            F.when(at == 0, F.concat(state["missing"], F.array(size))).otherwise(state["missing"]).alias("missing"),
            F.when(at == 0, rest).otherwise(F.filter(rest, lambda x, i: i + 1 != at)).alias("remaining"),
        )

    return F.aggregate(gt, F.struct(none.alias("missing"), pred.cast(SIZES).alias("remaining")), step)


def plain_text(value: Column) -> Column:
    """A double as text with all its digits: powers of ten stand from 1e16 on alone (a cast writes 1.0E7)."""
    text = value.cast("string")
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(text, r"(?:\.0)?E(?=\d)", "e+")
    return F.when((F.abs(value) >= 1e7) & (F.abs(value) < 1e16), plain).when(F.abs(value) >= 1e16, power).otherwise(text)


def size_text(size: Column) -> Column:
    """``4.0mm`` or ``4.0x5.0mm``."""
    return F.concat(F.array_join(F.transform(size, lambda x: F.format_string("%.1f", x)), "x"), F.lit("mm"))


# Names of units.
_MILLIMETRE, _CENTIMETRE = ["mm", "millimeter", "millimetre"], ["cm", "centimeter", "centimetre"]


def to_cm(value: Column, unit: Column) -> Column:
    """A value in centimetres; null stays null, and a value with a missing or unknown unit is an error."""
    name = norm(unit)
    factor = F.when(name.isin(_MILLIMETRE), 0.1).when(name.isin(_CENTIMETRE), 1.0).when(name.isin("", "nan"), F.raise_error(F.lit("a measurement has no unit")).cast("double")).otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), name)).cast("double"))
    return F.when(value.isNotNull(), value * factor)


def pair_text(values: Column) -> Column:
    """Consecutive values in pairs, ``a x b cm``, a last odd one alone, joined with '/'; null for none."""
    text = lambda i: plain_text(F.element_at(values, i.cast("int")))
    n = F.size(values)
    starts = F.sequence(F.lit(1), n, F.lit(2))
    pairs = F.transform(starts, lambda i: F.when(i < n, F.concat(text(i), F.lit(" x "), plain_text(F.try_element_at(values, (i + 1).cast("int"))), F.lit(" cm"))).otherwise(F.concat(text(i), F.lit(" cm"))))
    return F.when(n > 0, F.array_join(pairs, "/"))
