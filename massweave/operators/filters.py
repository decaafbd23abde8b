"""Filters of peaks and scans, and predicates over sample maps."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_range(df: DataFrame, start_s: float, end_s: float, minutes: str = "time") -> DataFrame:
    """f01: seconds against minutes, inclusive."""
    return df.where((F.col(minutes) * 60).between(start_s, end_s))


def polarity(df: DataFrame, sign: int, col: str = "polarity") -> DataFrame:
    """f02."""
    return df.where(F.col(col) == sign)


def assert_one_polarity(df: DataFrame, keys: list[str], col: str = "polarity") -> DataFrame:
    """f02: a file with mixed polarity is an error, raised when the result is computed."""
    g = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias(col))
    return g.select(*keys, F.when(F.col("_lo") == F.col(col), F.col(col)).otherwise(F.raise_error(F.lit("mixed polarity")).cast("int")).alias(col))


def ms_level(df: DataFrame, level: int, col: str = "ms_level") -> DataFrame:
    """f03."""
    return df.where(F.col(col) == level)


def mass_range(df: DataFrame, low: float, high: float, col: str = "mz") -> DataFrame:
    """f04: inclusive."""
    return df.where(F.col(col).between(low, high))


def relative_intensity(df: DataFrame, keys: list[str], col: str = "i", out: str = "rel_i") -> DataFrame:
    """f05: share of the largest intensity of a scan.  The maxima are aggregated first and joined, so that no scan is sorted."""
    top = df.groupBy(*keys).agg(F.max(col).alias("_top"))
    return df.join(top, keys).withColumn(out, F.col(col) / F.col("_top")).drop("_top")


def min_intensity(df: DataFrame, least: float, col: str = "i") -> DataFrame:
    """f06: strict."""
    return df.where(F.col(col) > least)


def round_mz(df: DataFrame, digits: int, col: str = "mz") -> DataFrame:
    """f07: half to even."""
    return df.withColumn(col, F.bround(col, digits))


def scan_threshold(df: DataFrame, threshold: float, scans: str = "n_scans", col: str = "i", base: str | None = None) -> DataFrame:
    """f08: absolute, or relative to ``base``, loosened by the root of the number of scans."""
    t = F.lit(threshold) * (F.col(base) if base else F.lit(1.0)) / F.sqrt(F.col(scans))
    return df.where(F.col(col) >= t)


def occupation(long: DataFrame, keys: list[str], threshold: float, least: float, n_samples: DataFrame, factor: float = 1.0) -> DataFrame:
    """f09: keys whose share of samples above the threshold reaches ``least`` in any group.

    long: keys, sample, grp, i, n_scans (only observed intensities); n_samples: grp, n (all
    samples of a group, so that absent ones count as below).
    """
    g = occupation_value(long, keys, threshold, n_samples, factor)
    return g.groupBy(*keys).agg(F.max("occ").alias("occ")).where(F.col("occ") >= least)


def occupation_value(long: DataFrame, keys: list[str], threshold: float, n_samples: DataFrame, factor: float = 1.0) -> DataFrame:
    """f10: share of samples above an absolute threshold per group."""
    ok = F.sum((F.col("i") * factor > F.lit(threshold) / F.sqrt("n_scans")).cast("int"))
    return long.groupBy(*keys, "grp").agg(ok.alias("_ok")).join(n_samples, "grp").select(*keys, "grp", (F.col("_ok") / F.col("n")).alias("occ"))


def occupation_percent(long: DataFrame, keys: list[str], percent: float, least: float, n_samples: DataFrame) -> DataFrame:
    """f11: threshold in percent of the sample's base peak."""
    ok = F.sum((F.col("i") * 100 > F.lit(percent) * F.col("base_peak")).cast("int"))
    g = long.groupBy(*keys, "grp").agg(ok.alias("_ok")).join(n_samples, "grp").select(*keys, (F.col("_ok") / F.col("n")).alias("occ"))
    return g.groupBy(*keys).agg(F.max("occ").alias("occ")).where(F.col("occ") >= least)


def scan_repetition(bins: DataFrame, keys: list[str], n_scans: Column, least: float) -> DataFrame:
    """f12: bins with enough peaks for their scans."""
    return bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_peaks")).where(F.col("n_peaks") / n_scans >= least)


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a shell pattern."""
    return "(?s)^" + re.sub(r"\\Z$|\\z$|\)\\Z$", "", fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")) + "$"


def select_glob(m: Column, pattern: str) -> Column:
    """f13: the samples of a map whose name fits a shell pattern."""
    return F.map_filter(m, lambda k, _: F.regexp_like(k, F.lit(glob_regex(pattern))))


def select_regex(m: Column, pattern: str) -> Column:
    """f14: the samples whose name begins with a match."""
    return F.map_filter(m, lambda k, _: F.regexp_like(k, F.lit(f"^(?:{pattern})")))


def all_of(m: Column, op: str, k: Column | float) -> Column:
    """f16: a comparison that holds for every sample; a missing map is false."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    test = {"<": lambda v: v < k, "<=": lambda v: v <= k, ">": lambda v: v > k, ">=": lambda v: v >= k, "==": lambda v: v == k}[op]
    return F.coalesce(F.forall(F.map_values(m), test), F.lit(False))


def both_of(a: Column, b: Column, op: str, crossed: bool = False) -> Column:
    """f16: maps compared per sample, or with ``crossed`` (a selection by name took part) each with each."""
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y}[op]
    if crossed:
        c = F.forall(F.map_values(a), lambda x: F.forall(F.map_values(b), lambda y: test(x, y)))
    else:
        c = F.forall(F.map_keys(a), lambda k: F.coalesce(test(F.element_at(a, k), F.try_element_at(b, k)), F.lit(False)))
    return F.coalesce(c, F.lit(False))


def contained(counts: dict[str, Column], allowed: dict[str, tuple[int, ...]]) -> Column:
    """f17: every element of a formula is allowed and in range."""
    c = F.lit(True)
    for e, col in counts.items():
        c = c & (col.isin(list(allowed[e])) if e in allowed else col == 0)
    for e, v in allowed.items():
        if e not in counts:
            c = c & F.lit(0 in v)
    return c


def blank_suppressed(df: DataFrame, sample: str = "sample", col: str = "i", keys: tuple[str, ...] = ("mz",)) -> DataFrame:
    """f21: rows of keys that have no signal in the sample with the least total."""
    least = df.groupBy(sample).agg(F.sum(col).alias("_s")).agg(F.min_by(sample, F.struct("_s", sample)).alias("_blank"))
    blank = df.join(F.broadcast(least), F.col(sample) == F.col("_blank")).where(F.col(col) > 0).select(*keys).distinct()
    return df.join(blank, list(keys), "left_anti")


def mutual_mask(df: DataFrame, a: str, b: str) -> DataFrame:
    """f22: what is absent on one side counts as absent on the other."""
    dead = (F.coalesce(F.col(a), F.lit(0.0)) <= 0) | (F.coalesce(F.col(b), F.lit(0.0)) <= 0)
    return df.withColumns({a: F.when(dead, F.lit(0.0)).otherwise(F.col(a)), b: F.when(dead, F.lit(0.0)).otherwise(F.col(b))})


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """o02."""
    return df.orderBy(*order).limit(k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """o04: the first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def nearest_solution(hits: DataFrame, key: str, mz: str = "mz", target: str = "target_mz", name: str = "chemsc") -> DataFrame:
    """o05: of the hits of each key that with the least absolute error; ties go to the first name."""
    cols = hits.columns
    best = F.min_by(F.struct(*cols), F.struct(F.abs(F.col(mz) - F.col(target)), F.col(name)))
    return hits.groupBy(F.col(key).alias("_k")).agg(best.alias("_r")).select("_r.*")


def meets_occupation(long: DataFrame, keys: list[str], n_samples: int, least: float) -> DataFrame:
    """i07: the rows of entries that, with the intensities they have now, are in a share ``least`` of the samples."""
    per = long.where("i > 0").groupBy(*keys).agg(F.countDistinct("sample").alias("_n"))
    return long.join(per.where(F.col("_n") >= F.lit(least * n_samples)).select(*keys), keys, "left_semi")
