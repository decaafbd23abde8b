"""From scans and peaks to the aligned tables that queries run on.

MS1: the scans of a sample are averaged (a10), samples are aligned (a05) and entries with too
few samples go (f09).  MS2: scans of one precursor are merged within a sample (a12), then
precursors and their fragments are aligned over samples (a09) and meet the entries (j07).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..chem import Tolerance
from ..operators import fold
from ..operators.aggregates import calibration_points, recalibrate, scan_average
from ..operators.filters import scan_threshold
from ..operators.intervals import associate
from ..scratch import materialise
from .identify import Tables


@dataclass(frozen=True)
class Options:
    """Windows and limits of an import; shares are between 0 and 1, times in seconds."""

    ms1: Tolerance
    ms2: Tolerance
    selection: float = 0.5  # Da: precursors that belong together
    passes: int = 3
    repetition: float = 0.0  # share of a sample's scans that a peak must be in
    repetition2: float = 0.0
    occupation: float = 0.0  # share of the samples that an entry must be in
    occupation2: float = 0.0
    time: tuple[float, float] = (0.0, float("inf"))
    largest: float = 2000.0
    shift: float = 0.0  # Da, added to all masses
    calibration_ppm: float = 100.0  # reach of the reference masses
    threshold: float = 0.0  # least intensity of an averaged peak, divided by the root of the scans
    threshold2: float = 0.0


def average_ms1(peaks: DataFrame, tol: Tolerance, passes: int = 3, least: float = 0.0) -> DataFrame:
    """a10, f12: per sample and polarity the peaks of all scans as one averaged spectrum; peaks in too few scans go.

    peaks: polarity, sample, scan_id, mz, i.  Result: polarity, sample, mz, i, n_hit, n_scans.
    """
    keys = ["polarity", "sample"]
    total = peaks.groupBy(*keys).agg(F.countDistinct("scan_id").alias("n_scans"))
    binned = fold.align(peaks.select(*keys, "scan_id", "mz", "i"), keys, tol, passes, weighted=True)
    out = scan_average(binned, [*keys, "bin_first"], total, keys)
    return out.where(F.col("n_hit") >= F.lit(least) * F.col("n_scans")).drop("bin_first")


def merge_msms(peaks: DataFrame, window: float, tol: Tolerance, passes: int = 3, least: float = 0.0) -> DataFrame:
    """a12: the MS2 scans of a sample whose precursors lie in one window become one spectrum.

    peaks: polarity, sample, scan_id, prec_mz, mz, i.  Result: polarity, sample, prec_first (least
    precursor of the window), prec (mean precursor), bin_first, mz (weighted), i (over all
    scans of the window), n_hit, n_scans.
    """
    keys = ["polarity", "sample"]
    scans = peaks.select(*keys, "scan_id", "prec_mz").distinct().withColumn("i", F.lit(1.0))
    c = fold.align(scans, keys, Tolerance("da", window), 1, mz="prec_mz").select(*keys, "scan_id", "prec_mz", F.col("bin_first").alias("prec_first"))
    c = materialise(c, "precursors")
    total = c.groupBy(*keys, "prec_first").agg(F.countDistinct("scan_id").alias("n_scans"), F.avg("prec_mz").alias("prec"))
    mine = [*keys, "prec_first"]
    binned = fold.align(peaks.join(c, [*keys, "scan_id", "prec_mz"]).select(*mine, "scan_id", "mz", "i"), mine, tol, passes, weighted=True)
    g = binned.groupBy(*mine, "bin_first").agg((F.sum(F.col("mz") * F.col("i")) / F.sum("i")).alias("mz"), F.sum("i").alias("_s"), F.countDistinct("scan_id").alias("n_hit"))
    out = g.join(total, mine).where(F.col("n_hit") >= F.lit(least) * F.col("n_scans"))
    return out.select(*mine, "prec", "bin_first", "mz", (F.col("_s") / F.col("n_scans")).alias("i"), "n_hit", "n_scans")


def align_msms(merged: DataFrame, window: float, tol: Tolerance, n_samples: int, passes: int = 3, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """a09: spectra of :func:`merge_msms` over samples: (fragments, their long intensities).

    Precursors of all samples are clustered by the window, the fragments of a cluster are aligned;
    fragments in less than a share ``least`` of the samples go.  fragments: fr_id, polarity,
    cluster_mz (mean precursor), cluster_first, mz, win; long: fr_id, sample, i.
    """
    merged = materialise(merged, "merged")  # read for the precursors and for the fragments
    of = merged.select("polarity", "sample", "prec_first", "prec").distinct().withColumn("i", F.lit(1.0))
    c = fold.align(of, ["polarity"], Tolerance("da", window), 1, mz="prec").select("polarity", "sample", "prec_first", F.col("bin_mz").alias("cluster_mz"), F.col("bin_first").alias("cluster_first"))
    c = materialise(c, "clusters")
    keys = ["polarity", "cluster_first"]
    peaks = merged.join(c, ["polarity", "sample", "prec_first"]).select(*keys, "cluster_mz", "sample", "mz", "i")
    a = fold.align(peaks, keys, tol, passes).withColumn("fr_id", F.xxhash64(*keys, "bin_first"))
    a = materialise(a, "fragments")
    frag = a.groupBy("fr_id").agg(
        *[F.first(x).alias(x) for x in ("polarity", "cluster_mz", "cluster_first")], F.avg("mz").alias("mz"), (F.max("mz") - F.min("mz")).alias("win"), F.countDistinct("sample").alias("_n")
    )
    frag = frag.where(F.col("_n") >= F.lit(least * n_samples)).drop("_n")
    long = a.groupBy("fr_id", "sample").agg(F.sum("i").alias("i")).join(frag.select("fr_id"), "fr_id", "left_semi")
    return frag, long


def import_spectra(scans: DataFrame, peaks: DataFrame, o: Options, references: DataFrame | None = None, groups: DataFrame | None = None) -> Tables:
    """The tables of :func:`..sources.spectra.scans_and_peaks` to query tables.

    scans: sample, scan_id, time (minutes), ms_level, polarity, target_mz; peaks: sample, scan_id, mz, i.
    Masses are shifted by ``o.shift`` and, with ``references`` (target_mz), recalibrated per sample by its MS1
    peaks.  With ``groups`` (sample, grp) an entry must be in a share of the samples of some group.  Peaks
    without intensity do not count.  Aligned tables are written, so jobs run when this is called.
    """
    s = scans.where((F.col("time") * 60).between(*o.time)).select("sample", "scan_id", "ms_level", "polarity", F.col("target_mz").alias("prec_mz"))
    p = peaks.where("i > 0").select("sample", "scan_id", (F.col("mz") + o.shift).alias("mz"), "i").join(s, ["sample", "scan_id"])
    p = materialise(p, "peaks")  # read several times, and files are decoded once
    if references is not None:
        points = calibration_points(p.where("ms_level = 1"), references.select("target_mz").distinct(), o.calibration_ppm, o.largest, ["sample"])
        p = recalibrate(p, materialise(points, "points"), ["sample"], o.largest)
    n = s.select("sample").distinct().count()
    own = s.select("sample").distinct().join(groups, "sample") if groups is not None else None
    one = scan_threshold(average_ms1(p.where("ms_level = 1"), o.ms1, o.passes, o.repetition), o.threshold)
    a = materialise(fold.align(one.select("polarity", "sample", "mz", "i"), ["polarity"], o.ms1, o.passes).withColumn("se_id", F.xxhash64("polarity", "bin_first")), "survey")
    held = occupied(a, "se_id", o.occupation, n, own)
    survey = materialise(a.groupBy("se_id").agg(F.first("polarity").alias("polarity"), F.avg("mz").alias("mz")).join(held, "se_id", "left_semi"), "survey")
    long = a.groupBy("se_id", "sample").agg(F.sum("i").alias("i")).join(survey.select("se_id"), "se_id", "left_semi")
    two = p.where("ms_level = 2 and prec_mz is not null").withColumn("prec_mz", F.col("prec_mz") + o.shift)
    merged = scan_threshold(merge_msms(two, o.selection, o.ms2, o.passes, o.repetition2), o.threshold2)
    frag, frag_long = align_msms(merged, o.selection, o.ms2, n, o.passes, 0.0 if own is not None else o.occupation2)
    if own is not None:
        held = occupied(frag_long, "fr_id", o.occupation2, n, own)
        frag, frag_long = frag.join(held, "fr_id", "left_semi"), frag_long.join(held, "fr_id", "left_semi")
    frag = materialise(frag, "frag")
    clusters = frag.select("polarity", "cluster_first", F.col("cluster_mz").alias("prec")).distinct()
    near = associate(clusters, survey, o.selection, keys=["polarity"]).select("se_id", "polarity", "cluster_first")
    bridge = near.join(frag.select("fr_id", "polarity", "cluster_first"), ["polarity", "cluster_first"]).select("se_id", "fr_id")
    return Tables(survey, materialise(long, "survey_long"), frag, materialise(frag_long, "frag_long"), materialise(bridge, "bridge"), o.largest)


def occupied(long: DataFrame, key: str, least: float, n: int, groups: DataFrame | None) -> DataFrame:
    """Keys that are in a share ``least`` of the samples, or with ``groups`` of the samples of some group."""
    have = long.select(key, "sample").distinct()
    if groups is None:
        return have.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= F.lit(least * n)).select(key)
    size = groups.groupBy("grp").agg(F.countDistinct("sample").alias("_all"))
    share = have.join(groups, "sample").groupBy(key, "grp").agg(F.count(F.lit(1)).alias("_n")).join(size, "grp")
    return share.where(F.col("_n") >= F.lit(least) * F.col("_all")).select(key).distinct()


def save(t: Tables, path: str) -> None:
    """k04: the aligned tables under one folder."""
    for name in ("survey", "survey_long", "frag", "frag_long", "survey_frag"):
        getattr(t, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str, largest: float = 2000.0) -> Tables:
    """s15: what :func:`save` has written."""
    return Tables(*[spark.read.parquet(f"{path}/{name}") for name in ("survey", "survey_long", "frag", "frag_long", "survey_frag")], largest)
