"""x01-x18: arithmetic over numbers, formulas and sample maps; formats; numeric helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """x01: division by zero gives 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def arith(op: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b)}[op]()


def map_map(op: str, a: Column, b: Column) -> Column:
    """x01: per sample; samples that one side lacks count as 0."""
    z = F.lit(0.0)
    return F.map_zip_with(a, b, lambda _, x, y: arith(op, F.coalesce(x, z), F.coalesce(y, z)))


def map_num(op: str, m: Column, k: Column, flipped: bool = False) -> Column:
    """x01: every sample against one number."""
    return F.transform_values(m, lambda _, v: arith(op, k, v) if flipped else arith(op, v, k))


def average(*args: Column) -> Column:
    """x04: mean of numbers."""
    s = args[0]
    for a in args[1:]:
        s = s + a
    return s / len(args)


def map_average(m: Column) -> Column:
    """x04: sum over the number of samples, zeros counted."""
    return divide(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v), F.size(m).cast("double"))


def median_upper(values: Column) -> Column:
    """x05: of an array; of two middle values the larger."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def median_lower(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) / 2).cast("int"))


def map_abs(m: Column) -> Column:
    """x06."""
    return F.transform_values(m, lambda _, v: F.abs(v))


def sum_intensity(*maps: Column) -> Column:
    """x07: sum of maps, each different map once; -1 (used up by the isotope correction) counts as 0."""
    entries = F.array_distinct(F.array(*[F.array_sort(F.map_entries(m)) for m in maps]))
    flat = F.flatten(entries)
    keys = F.array_sort(F.array_distinct(F.transform(flat, lambda e: e["key"])))
    total = lambda k: F.aggregate(F.filter(flat, lambda e: e["key"] == k), F.lit(0.0), lambda a, e: a + F.greatest(e["value"], F.lit(0.0)))
    return F.map_from_arrays(keys, F.transform(keys, total))


def score(accuracy_ppm: float, *errors: Column) -> Column:
    """x09: one less the mean absolute error over the accuracy, with two decimals."""
    return F.format_string("%.2f", 1 - average(*[F.abs(e) for e in errors]) / accuracy_ppm)


def relative_to_standard(value: Column, standard: Column) -> Column:
    """x11: the ratio to the standard of the same sample."""
    return divide(value, standard)


def is_even(x: Column) -> Column:
    """x12."""
    return F.pmod(F.floor(x), F.lit(2)) == 0


def is_odd(x: Column) -> Column:
    return F.pmod(F.floor(x), F.lit(2)) == 1


def square(x: Column) -> Column:
    return F.pow(x, F.lit(2.0))


_SPEC = re.compile(r"%(?:%|[-+ 0#]*\d*(?:\.\d+)?([dfsgeix]))")


def printf(fmt: str, args: list[tuple[Column, str]]) -> Column:
    """x13: printf of typed arguments (Column, "num" or "str"); ``%d`` cuts decimals off.

    The format is checked on the driver: known specifiers only, one for each argument.
    """
    kinds = [m.group(1) for m in _SPEC.finditer(fmt) if m.group(1)]
    if len(kinds) != len(args) or "%" in _SPEC.sub("", fmt):
        raise ValueError(f"format {fmt!r} does not fit {len(args)} arguments")
    cols = []
    for k, (c, t) in zip(kinds, args, strict=True):
        if k in "di":
            cols.append(c.cast("double").cast("long"))
        elif k == "s":
            cols.append(c.cast("string"))
        else:
            cols.append(c.cast("double"))
    return F.format_string(fmt.replace("%i", "%d"), *cols)


def join_names(names: Column, sep: str = " @ ") -> Column:
    """x14."""
    return F.array_join(F.array_sort(names), sep)


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    """x17: to the unit interval; 0 where all values are equal."""
    return divide(x - lo, hi - lo)


def minkowski(a: Column, b: Column, p: float) -> Column:
    """x17: distance of two arrays of like length."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(p))), F.lit(0.0), lambda acc, v: acc + v)
    return F.pow(s, F.lit(1.0 / p))


def cell(x: Column) -> Column:
    """x18: a report cell as a number: what is missing, no number or negative is 0."""
    return F.greatest(F.coalesce(x.try_cast("double"), F.lit(0.0)), F.lit(0.0))
