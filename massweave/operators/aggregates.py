"""Averaging, ranking, statistics, merging, quantification and similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import few, materialise


def scan_average(binned: DataFrame, keys: list[str], total_scans: DataFrame, on: list[str]) -> DataFrame:
    """a10: per bin, intensity-weighted m/z and intensity over all scans (those without the peak too)."""
    g = binned.groupBy(*keys).agg((F.sum(F.col("mz") * F.col("i")) / F.sum("i")).alias("mz"), F.sum("i").alias("_s"), F.countDistinct("scan_id").alias("n_hit"))
    return g.join(total_scans, on).select(*keys, "mz", (F.col("_s") / F.col("n_scans")).alias("i"), "n_hit", "n_scans")


def merge_within_scan(binned: DataFrame, keys: list[str]) -> DataFrame:
    """a11: weighted m/z, mean intensity and number of the peaks that one scan merges."""
    return binned.groupBy(*keys).agg((F.sum(F.col("mz") * F.col("i")) / F.sum("i")).alias("mz"), F.avg("i").alias("i"), F.count(F.lit(1)).alias("n"))


def candidate_ranking(long: DataFrame, key: str, n_samples: int, k: int = 25) -> DataFrame:
    """a23: share of samples with signal plus their mean relative intensity, the best k."""
    g = long.groupBy(key).agg((F.countDistinct(F.when(F.col("i") > 0, F.col("sample"))) / F.lit(n_samples)).alias("ratio"), F.avg(F.when(F.col("i") > 0, F.col("rel_i"))).alias("mean_rel"))
    return g.withColumn("rank_score", F.col("ratio") + F.coalesce("mean_rel", F.lit(0.0))).orderBy(F.desc("rank_score"), key).limit(k)


def nearest_hits(df: DataFrame, keys: list[str], err: str, most: float) -> DataFrame:
    """a24: rows with the least absolute error of their key, within the bound."""
    least = df.groupBy(*keys).agg(F.min(F.abs(err)).alias("_least"))
    return df.join(least, keys).where((F.abs(err) == F.col("_least")) & (F.abs(err) <= most)).drop("_least")


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "idx", rows: int = 1 << 20) -> DataFrame:
    """o01: the rows with their place (from 1) in the order of their key; a key is cut into ranges of some ``rows`` rows.

    The ranges are written and numbered; a row's place is that in its range and the rows of the ranges before.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    cut = materialise(df.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    size = cut.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))  # few short rows
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")
    size = size.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), before.alias("_before"))
    placed = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)))
    on = [F.col("_p") == F.col("_q"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return placed.join(few(size), on).select(*df.columns, (F.col("_before") + F.col("_r")).alias(out))


def error_summary(df: DataFrame, keys: list[str], err: str, i: str, q: float = 0.25) -> DataFrame:
    """a25: mean error, mean intensity, RSD percent and count; groups up to the quantile of the mean errors."""
    g = df.groupBy(*keys).agg(F.avg(err).alias("mean_err"), F.avg(i).alias("mean_i"), (F.stddev_samp(i) / F.avg(i) * 100).alias("rsd"), F.count(F.lit(1)).alias("n"))
    cut = g.agg(F.percentile("mean_err", q).alias("_q"))
    return g.join(F.broadcast(cut), F.col("mean_err") <= F.col("_q")).drop("_q")


def ion_statistics(df: DataFrame, sample: str, i: str, keys: list[str]) -> DataFrame:
    """a27: total ion count per sample (distinct positive values), share of it, mean and deviation over samples."""
    tic = df.where(F.col(i) > 0).select(sample, i).distinct().groupBy(sample).agg(F.sum(i).alias("tic"))
    rel = df.join(tic, sample).withColumn("_r", F.col(i) / F.col("tic"))
    return rel.groupBy(*keys).agg(F.avg("_r").alias("mean_rel"), F.stddev_pop("_r").alias("std_rel"), F.count(F.lit(1)).alias("n"))


def run_sums(df: DataFrame, part: list[str], order: list[Column], name: str, value: str) -> DataFrame:
    """a28: sums over runs of rows with equal names in their order."""
    w = Window.partitionBy(*part).orderBy(*order)
    d = df.withColumn("_new", F.coalesce((F.lag(name).over(w) != F.col(name)).cast("int"), F.lit(1)))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*part, "run", name).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))


def with_total(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """a29: the rows and one row of sums."""
    total = df.agg(*[F.sum(F.col(v).try_cast("double")).alias(v) for v in values]).select(F.lit("total").alias(label), *values)
    return df.select(F.col(label).cast("string").alias(label), *values).unionByName(total)


def resolution_points(peaks: DataFrame, bins: int = 50) -> DataFrame:
    """a32: per equal-width bin of m/z the smallest gap of a scan as a resolution estimate."""
    span = peaks.agg(F.min("mz").alias("_lo"), F.max("mz").alias("_hi"))
    w = Window.partitionBy("scan_id").orderBy("mz", "peak_id")
    g = peaks.withColumn("gap", F.col("mz") - F.lag("mz").over(w)).where("gap > 0").join(F.broadcast(span))
    b = F.least(F.floor((F.col("mz") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("long")
    r = g.withColumn("bin", b).withColumn("res", F.col("mz") / (F.col("gap") * F.lit(2.355 / 3)))
    best = r.groupBy("bin").agg(F.max(F.struct("res", "mz")).alias("m")).select("bin", F.col("m.res").alias("res"), F.col("m.mz").alias("mz"))
    cut = best.agg(F.percentile("res", 0.95).alias("_q"))
    return best.join(F.broadcast(cut), F.col("res") <= F.col("_q")).drop("_q")


def quadratic_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """a32: least squares of a parabola by its normal equations, from one row of sums."""
    p = [F.sum(F.pow(F.col(x), F.lit(float(k)))).alias(f"s{k}") for k in range(5)]
    t = [F.sum(F.pow(F.col(x), F.lit(float(k))) * F.col(y)).alias(f"t{k}") for k in range(3)]
    a = df.agg(*p, *t)
    s = [F.col(f"s{k}") for k in range(5)]
    r = [F.col(f"t{k}") for k in range(3)]

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    m = [[s[i + j] for j in range(3)] for i in range(3)]
    d = det(m)
    out = []
    for k in range(3):
        mk = [[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
        out.append((det(mk) / d).alias(f"c{k}"))
    return a.select(*out)


def least_gap(peaks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """a33: smallest positive gap between neighbours of a scan."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return peaks.withColumn("_g", F.lead("mz").over(w) - F.col("mz")).where("_g > 0").groupBy(*keys).agg(F.min("_g").alias("gap"))


def spray_stability(scans: DataFrame, keys: list[str], tic: str, trim: int) -> DataFrame:
    """a34: trimmed range of the total ion current in percent of its median."""
    up, down = Window.partitionBy(*keys).orderBy(tic, "scan_id"), Window.partitionBy(*keys).orderBy(F.desc(tic), F.desc("scan_id"))
    t = scans.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down)).where((F.col("_a") > trim) & (F.col("_z") > trim))
    return t.groupBy(*keys).agg(((F.max(tic) - F.min(tic)) / F.median(tic) * 100).alias("stability"), F.count(F.lit(1)).alias("n"))


def similarity(a: DataFrame, b: DataFrame, key: str, i: str = "i") -> DataFrame:
    """a35: cosine, its angle in percent of a right angle, and Pearson correlation of two aligned spectra."""
    j = a.select(key, F.col(i).alias("_x")).join(b.select(key, F.col(i).alias("_y")), key, "full_outer").select(F.coalesce("_x", F.lit(0.0)).alias("x"), F.coalesce("_y", F.lit(0.0)).alias("y"))
    g = j.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.corr("x", "y").alias("pearson"), F.count(F.lit(1)).alias("n"))
    cos = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    return g.select(cos.alias("cosine"), ((1 - F.acos(F.least(cos, F.lit(1.0))) / F.lit(1.5707963267948966)) * 100).alias("angle_percent"), "pearson", "n")


def merge_tables(tables: list[tuple[str, DataFrame]], keys: list[str], full_only: bool = False) -> DataFrame:
    """j13: outer merge on key columns; what a table lacks is 0; value columns that collide get the table's name."""
    seen: dict[str, int] = {}
    for _, t in tables:
        for c in t.columns:
            if c not in keys:
                seen[c] = seen.get(c, 0) + 1
    named = [t.select(*keys, *[F.col(c).alias(f"{c}-{n}" if seen[c] > 1 else c) for c in t.columns if c not in keys]) for n, t in tables]
    out = reduce(lambda x, y: x.join(y, keys, "inner" if full_only else "full_outer"), named)
    return out.select(*keys, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in out.columns if c not in keys])


def quantify(df: DataFrame, standards: DataFrame, specie: str, cls: str, value: str) -> DataFrame:
    """j14: amounts from the class's internal standard: value / standard's value * spiked amount."""
    s = df.join(standards, df[specie] == standards["standard"]).select(F.col("std_class"), F.col(value).alias("_sv"), "amount")
    return df.join(s, df[cls] == F.col("std_class")).select(specie, cls, (F.col(value) / F.col("_sv") * F.col("amount")).alias("quantity"))


def previous_ms1(scans: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """j16: for each MS2 scan the last MS1 scan before it."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return scans.withColumn("trigger", F.last(F.when(F.col("ms_level") == 1, F.col("scan_id")), True).over(w)).where("ms_level = 2")


def trigger_peak(scans: DataFrame, peaks: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """j16: for each MS2 scan the peak of the MS1 scan before it that is nearest to its precursor (ties: the smaller mass).

    scans: scan_id, ms_level, target_mz; peaks: scan_id, mz, i.  A scan without such a peak has nulls.
    """
    found = previous_ms1(scans, part, order).select("scan_id", "target_mz", "trigger")
    j = found.join(peaks.select(F.col("scan_id").alias("trigger"), "mz", "i"), "trigger")
    near = j.groupBy("scan_id").agg(F.min(F.struct(F.abs(F.col("mz") - F.col("target_mz")).alias("off"), "mz", "i")).alias("_p"))
    return found.join(near, "scan_id", "left").select("scan_id", "trigger", "target_mz", F.col("_p.mz").alias("peak_mz"), F.col("_p.i").alias("peak_i"))


def shared_fragments(marks: DataFrame, key: list[str], entry: str) -> DataFrame:
    """j21: entries that share a mark."""
    return marks.groupBy(*key).agg(F.countDistinct(entry).alias("n_entries"), F.min(entry).alias("first_entry"), F.max(entry).alias("last_entry")).where("n_entries > 1")


def isobaric(marks: DataFrame, part: list[str], name: str) -> DataFrame:
    """i10: marks of equal measured mass list the names of the others."""
    names = marks.groupBy(*part).agg(F.array_sort(F.collect_set(name)).alias("_all"))
    return marks.join(names, part).withColumn("isobaric", F.array_join(F.array_remove("_all", F.col(name)), " @ ")).drop("_all")


def drop_permutations(bindings: DataFrame, key: list[str], score: Column, order: str) -> DataFrame:
    """i11: of bindings with the same set of compositions that with the best score stays."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), order)
    return bindings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def calibration_points(peaks: DataFrame, references: DataFrame, ppm: float, largest: float, part: list[str]) -> DataFrame:
    """i12: shift of the most intense peak near each reference mass."""
    from ..chem import Tolerance
    from .intervals import interval_join

    j = interval_join(peaks, references, Tolerance("ppm", ppm), largest)
    g = j.groupBy(*part, "target_mz").agg(F.max(F.struct("i", "mz")).alias("_m"))
    return g.select(*part, "target_mz", (F.col("_m.mz") - F.col("target_mz")).alias("shift"))


def shift_at(points: Column, mz: Column) -> Column:
    """i13: piecewise-linear shift from a sorted array of (x, y); constant outside; 0 without points."""
    below = F.try_element_at(F.filter(points, lambda p: p["x"] <= mz), F.lit(-1))
    above = F.get(F.filter(points, lambda p: p["x"] > mz), 0)
    line = below["y"] + (above["y"] - below["y"]) * (mz - below["x"]) / (above["x"] - below["x"])
    return F.when(F.size(points) == 0, F.lit(0.0)).when(below.isNull(), above["y"]).when(above.isNull(), below["y"]).otherwise(line)


def recalibrate(peaks: DataFrame, points: DataFrame, part: list[str], largest: float, block: float = 10.0) -> DataFrame:
    """i14: masses less the interpolated shift of their part.

    The points of a part cut the axis up to ``largest`` into segments, which meet the peaks by
    an equi-join on blocks of mass; outside the points the shift is constant, without points 0.
    """
    w = Window.partitionBy(*part).orderBy("target_mz")
    p = points.select(*part, F.col("target_mz").alias("x0"), F.col("shift").alias("y0"), F.lead("target_mz").over(w).alias("x1"), F.lead("shift").over(w).alias("y1"), F.lag("target_mz").over(w).alias("_b"))
    inner = p.select(*part, "x0", F.coalesce("x1", F.lit(largest + block)).alias("x1"), "y0", F.coalesce("y1", "y0").alias("y1"))
    first = p.where("_b is null").select(*part, F.lit(0.0).alias("x0"), F.col("x0").alias("x1"), "y0", F.col("y0").alias("y1"))
    seg = inner.unionByName(first).select("*", F.explode(F.sequence(F.floor(F.col("x0") / block), F.floor(F.col("x1") / block))).alias("_k"))
    names = peaks.columns
    j = peaks.withColumn("_k", F.floor(F.col("mz") / block)).alias("l").join(
        seg.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in part] + [F.col("l._k") == F.col("r._k"), F.col("l.mz") >= F.col("r.x0"), F.col("l.mz") < F.col("r.x1")], "left"
    )
    shift = F.coalesce(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("l.mz") - F.col("x0")) / (F.col("x1") - F.col("x0")), F.lit(0.0))
    return j.select(*[(F.col("l.mz") - shift).alias("mz") if c == "mz" else F.col(f"l.{c}") for c in names])
