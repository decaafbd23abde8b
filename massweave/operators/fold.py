"""Greedy anchor binning (alignment): exact, and parallel along gaps.

A bin opens at its first mass and takes what follows while ``m - anchor < window(anchor)``.
Masses are folded in blocks of bounded size, whose descriptions are chained (see :mod:`.blocks`), so
no frame grows with the density of the masses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..chem import Tolerance
from ..scratch import drop, materialise
from . import blocks


def greedy(m: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bin number of each of the sorted masses; width: the window of each as an anchor."""
    out = np.zeros(len(m), np.int64)
    at = n = 0
    while at < len(m):
        end = int(np.searchsorted(m, m[at] + width[at], "left"))
        # m - anchor < width can round apart from m < anchor + width at the very border.
        while end > at + 1 and not m[end - 1] - m[at] < width[at]:
            end -= 1
        while end < len(m) and m[end] - m[at] < width[at]:
            end += 1
        end = max(end, at + 1)
        out[at:end] = n
        n += 1
        at = end
    return out


def fold(m: np.ndarray, i: np.ndarray, tol: Tolerance, passes: int = 3, weighted: bool = False) -> np.ndarray:
    """Bin of each of the sorted masses after several passes, the later ones over bin centres."""
    member = greedy(m, np.asarray(tol.width_of(m), float))
    for _ in range(passes - 1):
        n = int(member.max()) + 1 if len(member) else 0
        c = np.bincount(member, m * i, n) / np.bincount(member, i, n) if weighted else np.bincount(member, m, n) / np.bincount(member, minlength=n)
        member = greedy(c, np.asarray(tol.width_of(c), float))[member]
    return member


def islands(df: DataFrame, keys: list[str], tol: Tolerance, block: float, mz: str = "mz", out: str = "island") -> DataFrame:
    """Add the first mass of the island (run without a gap of a window) of each row."""
    b = df.withColumn("_b", F.floor(F.col(mz) / block))
    per = b.groupBy(*keys, "_b").agg(F.min(mz).alias("_lo"), F.max(mz).alias("_hi"))
    o = Window.partitionBy(*keys).orderBy("_b")
    per = per.withColumn("_before", F.lag("_hi").over(o)).select(*keys, "_b", "_before")
    w = Window.partitionBy(*keys, "_b").orderBy(mz)
    j = b.join(per, [*keys, "_b"])
    prev = F.coalesce(F.lag(mz).over(w), F.col("_before"))
    j = j.withColumn("_p", prev).withColumn("_s", F.when(F.col("_p").isNull() | (F.col(mz) - F.col("_p") >= tol.width(F.col("_p"))), F.col(mz)))
    j = j.withColumn("_i", F.last("_s", True).over(w))
    # Rows before the first gap of a block belong to the last island of the blocks before.
    last = j.groupBy(*keys, "_b").agg(F.max("_s").alias("_l")).withColumn("_carry", F.last("_l", True).over(o.rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_b", "_carry")
    return j.join(last, [*keys, "_b"]).withColumn(out, F.coalesce("_i", "_carry")).drop("_b", "_before", "_p", "_s", "_i", "_carry")


def align(df: DataFrame, keys: list[str], tol: Tolerance, passes: int = 3, weighted: bool = False, mz: str = "mz", i: str = "i", rows: int | None = None) -> DataFrame:
    """a01, a02: the rows with ``bin_mz`` (mean of the members' masses, or weighted) and ``bin_first`` (least mass).

    Each pass is a fold in blocks (see :mod:`.blocks`); later passes run over the centres of the
    bins.  Null masses must be filtered before.
    """
    n, s = ("_w", "_ws") if weighted else ("_n", "_s")
    first = materialise(blocks.anchored(df, keys, tol, mz, "_bin", rows), "anchored")  # read for the bins and for the result
    cur = first.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), _exact(F.col(mz)).alias("_s"), _exact(F.col(i)).alias("_w"), _exact(F.col(mz) * F.col(i)).alias("_ws"))
    cur, of = materialise(cur.withColumn("bin_first", F.col("_bin")), "bins"), None
    for _ in range(passes - 1):
        step = materialise(blocks.anchored(cur.withColumn("_c", F.col(s) / F.col(n)), keys, tol, "_c", "_next", rows), "bins")
        drop(cur)
        # What each bin of the first pass has become.
        went = step.select(*keys, "_bin", "_next")
        of = went if of is None else _matched(of.withColumnRenamed("_next", "_top"), went, keys, "_top", "_bin").select(*keys, "_bin", "_r__next").withColumnRenamed("_r__next", "_next")
        sums = [F.sum("_n").alias("_n"), *[_exact(F.col(c)).alias(c) for c in ("_s", "_w", "_ws")]]
        cur = materialise(step.groupBy(*keys, F.col("_next").alias("_bin")).agg(*sums, F.min("bin_first").alias("bin_first")), "bins")
    found = cur.select(*keys, "_bin", (F.col(s) / F.col(n)).alias("bin_mz"), "bin_first")
    if of is not None:
        found = _matched(of, found, keys, "_next", "_bin").select(*keys, "_bin", F.col("_r_bin_mz").alias("bin_mz"), F.col("_r_bin_first").alias("bin_first"))
    return _matched(first, found, keys, "_bin", "_bin").select(*df.columns, F.col("_r_bin_mz").alias("bin_mz"), F.col("_r_bin_first").alias("bin_first"))


def _exact(c) -> Column:
    """A sum that no order of the rows changes, so that bins are the same however rows are dealt."""
    return F.sum(c.cast("decimal(32,12)")).cast("double")


def _matched(left: DataFrame, right: DataFrame, keys: list[str], a: str | None, b: str | None) -> DataFrame:
    """Rows with equal keys (null equals null) and ``a = b``; columns of the right side get the prefix ``_r_``."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    return left.join(right, [*[F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], *([F.col(a) == F.col(f"_r_{b}")] if a else [])])


def survey(df: DataFrame, tol: Tolerance, keys: list[str], passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """a05: aligned table over samples: (entries with cluster statistics, long intensities).

    Intensities of one sample in a bin are summed; the centre is the mean of the peaks.
    """
    a = align(df, keys, tol, passes)
    stats = a.groupBy(*keys, "bin_first").agg(*cluster_statistics("mz"), F.count(F.lit(1)).alias("n_peaks"))
    long = a.groupBy(*keys, "bin_first", "sample").agg(F.sum("i").alias("i"))
    return stats, long


def cluster_statistics(mz: str = "mz") -> list:
    """a21: mean, midrange ("median"), population variance and deviation, window of a cluster."""
    return [
        F.avg(mz).alias("mean"),
        (F.min(mz) + (F.max(mz) - F.min(mz)) / 2).alias("midrange"),
        F.var_pop(mz).alias("variance"),
        F.stddev_pop(mz).alias("stddev"),
        (F.max(mz) - F.min(mz)).alias("window"),
    ]


def single_linkage(df: DataFrame, keys: list[str], gap: float, block: float = 10.0, mz: str = "mz") -> DataFrame:
    """a15: single-linkage clusters in one dimension are the islands of a constant gap."""
    return islands(df, keys, Tolerance("da", gap), block, mz, "cluster")


def collapse(m: np.ndarray, samples: list[frozenset], most: float) -> np.ndarray:
    """a07: neighbours at most ``most`` apart with disjoint sample sets become one, from the left."""
    out = np.zeros(len(m), np.int64)
    have: frozenset = samples[0] if len(samples) else frozenset()
    for k in range(1, len(m)):
        if m[k] - m[k - 1] <= most and not have & samples[k]:
            out[k] = out[k - 1]
            have = have | samples[k]
        else:
            out[k] = out[k - 1] + 1
            have = samples[k]
    return out


def collapse_clusters(entries: DataFrame, keys: list[str], most: float, mz: str = "mz", samples: str = "samples", rows: int | None = None) -> DataFrame:
    """a07 over a table: entries with ``merged`` (least mass of the merged cluster); the open cluster passes from block to block."""

    def run(t: pa.Table, state: tuple | None) -> tuple[list, tuple]:
        out = []
        for m, have in zip(t[mz].to_pylist(), t[samples].to_pylist(), strict=True):
            if state is not None and m - state[1] <= most and not state[2] & {*have}:
                state = (state[0], m, state[2] | {*have})
            else:
                state = (m, m, {*have})
            out.append(state[0])
        return out, (state[0], state[1], _Sorted(state[2]))

    return blocks.relay(blocks.pack(entries, keys, [mz], rows, True), keys, run, "merged", DoubleType())


class _Sorted(set):
    """A set that is pickled in order, so that equal sets give equal bytes."""

    def __reduce__(self):
        return _Sorted, (sorted(self),)


@dataclass(frozen=True)
class Learnt:
    """How a window is learnt: full bins narrow it to ``factor`` times their span.

    start: ``smallest`` (a03: twice the mean of the smallest gaps, as many as samples, among those between ``noise`` and 0.1)
    or ``below_mean`` (a06: mean of the gaps below their mean); gaps are those of the ten times as many largest masses.
    least_gap: the start without such gaps.
    """

    factor: float = 7.0
    start: str = "smallest"
    noise: float = 1e-4
    least_gap: float = 2e-4


#: Share of the samples that makes a bin full; narrower spans teach nothing.
FULL, NARROWEST = 0.95, 1e-5


def start_width(masses: list[float], n_samples: int, how: Learnt) -> float:
    """The first window, from the largest masses in descending order."""
    gaps = sorted(a - b for a, b in zip(masses[:-1], masses[1:], strict=True))
    if how.start == "below_mean":
        low = [g for g in gaps if g < sum(gaps) / len(gaps)]
        return sum(low) / len(low) if low else how.least_gap
    if n_samples < 2:
        return how.least_gap * 0.99
    some = [g for g in gaps if how.noise < g < 0.1][:n_samples]
    return 2 * sum(some) / len(some) if some else how.least_gap * 0.99


def learnt_bins(t: pa.Table, state: tuple | None, n_samples: int, how: Learnt, mz: str) -> tuple[list, tuple]:
    """A fold over descending masses: (anchor, learnt window) of each; state: anchor, last mass, elements, window, learnt.

    A row stands for ``_c`` elements of one mass; those after the first are inside its window.
    """
    out = []
    for m, n, w0, copies in zip(t[mz].to_pylist(), t["_n"].to_pylist(), t["_w0"].to_pylist(), t["_c"].to_pylist(), strict=True):
        anchor, last, count, width, first = state or (None, None, 0, w0, None)
        inside = anchor is not None and anchor - m < width and not (n_samples > 1 and n >= FULL * n_samples)
        if inside:
            state = (anchor, m, count + 1, width, first)
        else:
            if anchor is not None and count >= FULL * n_samples:
                new = how.factor * (anchor - last)
                if NARROWEST < new < width:
                    width, first = new, first or new
            state = (m, m, 1, width, first)
        if copies > 1 and width > 0:
            state = (state[0], m, state[2] + copies - 1, width, first)
        out.append({"anchor": state[0], "first": state[4]})
    return out, state


def learnt_align(df: DataFrame, keys: list[str], n_samples: int, how: Learnt = Learnt(), passes: int = 3, mz: str = "mz", rows: int | None = None) -> DataFrame:
    """a03, a06: the rows with ``bin_mz`` (mean of the members) and ``bin_first`` (least mass) of bins whose window is learnt.

    Masses come in descending order; a bin takes what is nearer than the window, and later passes run over
    the means of bins, of which a full one joins no other.  A pass begins with the window that the one
    before learnt first.  The anchor and the window pass from block to block.
    """
    top = Window.partitionBy(*keys).orderBy(F.desc(mz))
    largest = df.select(*keys, mz).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= 10 * n_samples + 1)

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:1].assign(_w0=start_width(sorted(pdf[mz], reverse=True), n_samples, how))

    width = largest.groupBy(*keys).applyInPandas(begin, StructType([*[df.schema[k] for k in keys], StructField("_w0", DoubleType())]))
    width = materialise(width, "widths")
    kind = StructType([StructField("anchor", DoubleType()), StructField("first", DoubleType())])
    cur = materialise(df.groupBy(*keys, F.col(mz).alias("_m")).agg(F.count(F.lit(1)).alias("_c")), "bins")
    # Equal masses are elements of their own, counted by their row; a bin counts its peaks.
    cur = cur.select(*keys, F.col("_m").alias("_bin"), "_m", F.lit(1).cast("long").alias("_n"), (F.col("_m") * 1.0).alias("bin_first"), "_c")
    of = None
    for k in range(passes):
        own = _matched(cur, width, keys, None, None).withColumn("_w0", F.col("_r__w0")).select(*cur.columns, "_w0").withColumn("_down", -F.col("_m"))
        step = blocks.relay(blocks.pack(own, keys, ["_down"], rows, True), keys, lambda t, state: learnt_bins(t, state, n_samples, how, "_m"), "_to", kind)
        step = materialise(step.select(*keys, "_bin", "_m", "_n", "_c", "bin_first", F.col("_to.anchor").alias("_next"), F.col("_to.first").alias("_first")), "bins")
        went = step.select(*keys, "_bin", "_next").distinct()
        of = went if of is None else _matched(of.withColumnRenamed("_next", "_top"), went, keys, "_top", "_bin").select(*keys, "_bin", F.col("_r__next").alias("_next"))
        masses = F.sum((F.col("_m") * F.col("_n")).cast("decimal(26,12)") * F.col("_c").cast("decimal(10,0)")).cast("double")
        total = step.groupBy(*keys, F.col("_next").alias("_bin")).agg(F.sum(F.col("_n") * F.col("_c")).alias("_n"), (masses / F.sum(F.col("_n") * F.col("_c"))).alias("_m"), F.min("bin_first").alias("bin_first"), F.lit(1).cast("long").alias("_c"))
        cur = materialise(total, "bins")
        learnt = step.groupBy(*keys).agg(F.max("_first").alias("_f"))
        width = materialise(_matched(width, learnt, keys, None, None).select(*keys, F.coalesce("_r__f", F.lit(how.least_gap * 0.99) if how.start == "smallest" else F.col("_w0")).alias("_w0")), "widths")
    found = _matched(of, cur.select(*keys, "_bin", F.col("_m").alias("bin_mz"), "bin_first"), keys, "_next", "_bin").select(*keys, F.col("_bin").alias("_of"), F.col("_r_bin_mz").alias("bin_mz"), F.col("_r_bin_first").alias("bin_first"))
    return _matched(df, found, keys, mz, "_of").select(*df.columns, F.col("_r_bin_mz").alias("bin_mz"), F.col("_r_bin_first").alias("bin_first"))


def chained_clusters(df: DataFrame, keys: list[str], resolution: float, mz: str = "mz", i: str = "i", rows: int | None = None) -> DataFrame:
    """a19: peaks at most ``mass / resolution`` above the first of their cluster (the border counts) become one.

    Result: keys, mz (weighted by intensity; the plain mean without any), i (sum), n.
    """
    a = blocks.anchored(df, keys, Closed("res", resolution), mz, "first_mz", rows)
    total, weighted = F.sum(i), F.sum(F.col(mz) * F.col(i))
    return a.groupBy(*keys, "first_mz").agg(F.when(total > 0, weighted / F.when(total > 0, total)).otherwise(F.avg(mz)).alias("mz"), total.alias("i"), F.count(F.lit(1)).alias("n"))


class Closed(Tolerance):
    """A window that takes its border."""

    def width_of(self, mass):
        return np.nextafter(super().width_of(mass), np.inf)


def collapse_msms(clusters: DataFrame, keys: list[str], mz: str = "mz", members: str = "members", rows: int | None = None) -> DataFrame:
    """a08: adjacent clusters of a spectrum become one, or change their members by intensity.

    clusters: keys, mz, members (array of sample, mass, intensity).  Neighbours whose means are at most
    twice the larger span apart join if no sample is in both; else, if the middles of their
    intensities lie clearly apart, the members are dealt anew into a low and a high cluster.
    Result: keys, members of each cluster that is left, the last one included.
    """
    last = clusters.groupBy(*keys).agg(F.max(F.struct(mz, members)).alias("_z"))
    own = _matched(clusters, last, keys, None, None).withColumn("_last", F.struct(mz, members) == F.col("_r__z")).select(*clusters.columns, "_last")

    def run(t: pa.Table, state: list | None) -> tuple[list, list | None]:
        out = []
        for c, end in zip(t[members].to_pylist(), t["_last"].to_pylist(), strict=True):
            closed, state = collapse_step(state, [(x["sample"], x["mass"], x["intensity"]) for x in c])
            if end:
                closed, state = [*closed, *([state] if state else [])], None
            out.append([[dict(zip(("sample", "mass", "intensity"), x, strict=True)) for x in g] for g in closed])
        return out, state

    kind = ArrayType(clusters.schema[members].dataType)
    done = blocks.relay(blocks.pack(own, keys, [mz, members], rows, True), keys, run, "_closed", kind)
    return done.select(*keys, F.explode("_closed").alias(members))


def collapse_step(current: list | None, c: list) -> tuple[list[list], list]:
    """One step of a08: (clusters that are closed, the open one); members are (sample, mass, intensity)."""
    if not current:
        return [], sorted(c)
    mass = lambda g: [m for _, m, _ in g]
    mean = lambda v: sum(v) / len(v)
    middle = lambda g: (max(i for _, _, i in g) + min(i for _, _, i in g)) / 2
    closed = []
    for again in (True, False):
        spans = max(max(mass(g)) - min(mass(g)) for g in (c, current))
        a, b = sorted((mean(mass(c)), mean(mass(current))))
        if not a > b - 2 * spans:
            return [*closed, current], sorted(c)
        if not {s for s, _, _ in c} & {s for s, _, _ in current}:
            return closed, sorted([*c, *current])
        split, off = (middle(c) + middle(current)) / 2, abs(middle(c) - middle(current))
        if not split or not again or any(split - off <= i <= split + off for _, _, i in [*c, *current]):
            return [*closed, current], sorted(c)
        # Of two members of a sample on one side that of the open cluster stays.
        side = lambda high: sorted({x[0]: x for x in [*c, *current] if (x[2] > split) == high}.values())  # noqa: E731, B023
        low, high = side(False), side(True)
        if not low or not high:
            return closed, sorted(low or high)
        current, c = low, high
    raise AssertionError("the second round returns")
