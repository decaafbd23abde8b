"""Joins by nearness of masses, as equi-joins on mass buckets.

A pure range predicate would plan as a nested loop.  Both sides get the bucket
``floor(mz / width)``; one side is repeated for the neighbouring buckets, and the
exact test follows the equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..chem import Tolerance
from ..scratch import unsent

#: Ids in one row of a list at most.
RUN = 256


def bucketed(left: DataFrame, right: DataFrame, lm: Column, rm: Column, reach: float, keys: list[str] | None = None) -> DataFrame:
    """Rows of both sides with masses in the same or neighbouring buckets of ``reach``; right is repeated."""
    b = F.floor(rm / reach)
    r = right.select("*", F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    lhs = left.withColumn("_b", F.floor(lm / reach))
    return lhs.join(r, ["_b", *(keys or [])]).drop("_b")


def interval_join(peaks: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, mz: str = "mz", target: str = "target_mz", keys: list[str] | None = None) -> DataFrame:
    """j01, j03, j04: all pairs within the tolerance (inclusive, sized from the measured mass)."""
    j = bucketed(peaks, targets, F.col(mz), F.col(target), tol.most(largest), keys)
    return j.where(tol.fits(F.col(mz), F.col(target)))


def runs(df: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(keys, run, ids): the values of ``key`` for each of ``keys`` in ascending order (nulls last), ``RUN`` of them in a row, runs numbered from 0."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(key).asc_nulls_last())) - 1
    value = F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("v"))  # as lists leave out nulls
    parts = df.select(*keys, value.alias("_v"), F.floor(place / RUN).alias("run"))
    return parts.groupBy(*keys, "run").agg(F.transform(F.array_sort(F.collect_list("_v")), lambda x: x["v"]).alias("ids"))


def interval_pairs(peaks: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, peak_id: str, target_id: str, mz: str = "mz", target: str = "target_mz") -> DataFrame:
    """j01: the two ids of all pairs within the tolerance.

    Targets of one mass are met as one: the join finds peaks for runs of their ids, which are laid out last.  Only ids and masses are
    shuffled, never pairs, and nothing is broadcast.  A run meets one peak after the other, so files of the result hold repeated
    stretches of ids and pack well.
    """
    reach = tol.most(largest)
    b = F.floor(F.col(target) / reach)
    t = runs(targets.where(F.col(target).isNotNull()), [target], target_id).select(target, "ids", F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    p = peaks.select(F.col(peak_id), F.col(mz), F.floor(F.col(mz) / reach).alias("_b"))
    n = int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes make many pairs
    return unsent(t.repartition(n, "_b")).join(p.repartition(n, "_b"), "_b").where(tol.fits(F.col(mz), F.col(target))).select(peak_id, F.explode("ids").alias(target_id))


def ranked_pairs(peaks: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, scan: str, ties: list[str], peak_id: str, target_id: str, mz: str = "mz", target: str = "target_mz") -> DataFrame:
    """o03: the two ids of all pairs within the tolerance, and their place in the order of error, ties, peak and target in each scan.

    Targets of one mass have one error against a peak, so a scan ranks its peaks against distinct masses, each weighing as much as it has
    targets; the places of the targets follow by counting.  Pairs are laid out last, from runs of peaks with equal mass and place
    against runs of targets; they are never shuffled.  Only where equal peaks or two masses with equal errors mix their targets, pairs
    are ranked one by one.
    """
    n, reach = int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions")), tol.most(largest)
    targets = targets.where(F.col(target).isNotNull())
    key = ["_e", *ties, peak_id]
    hits = interval_join(unsent(peaks.select(scan, *ties, peak_id, mz)), targets.groupBy(target).agg(F.count(F.lit(1)).alias("_n")), tol, largest, mz, target)
    hits = hits.select(scan, *ties, peak_id, target, "_n", F.abs(F.col(mz) - F.col(target)).alias("_e"))
    so_far, equal = Window.partitionBy(scan).orderBy(*[F.col(c).asc_nulls_last() for c in key]), Window.partitionBy(scan, *key)  # with all that are equal
    hits = hits.withColumn("_before", F.sum("_n").over(so_far) - F.sum("_n").over(equal)).withColumn("_equal", F.count(F.lit(1)).over(equal))

    dealt = lambda df: df.withColumn("_b", F.floor(F.col(target) / reach)).repartition(n, "_b")  # noqa: E731  by number, as few bytes make many pairs
    p = runs(dealt(hits.where("_equal = 1").select(peak_id, target, "_before")), ["_b", target, "_before"], peak_id).select("_b", target, "_before", F.col("ids").alias("_p"))
    t = runs(dealt(targets.select(target_id, target)), ["_b", target], target_id).select("_b", F.col(target).alias("_t"), "run", F.col("ids").alias("_ids"))
    j = unsent(p).join(t, "_b").where(F.col(target) - F.col("_t") == 0)
    j = j.select(F.explode("_p").alias(peak_id), "_ids", (F.col("_before") + F.col("run") * RUN + 1).alias("_first"))
    alone = j.select(peak_id, "_first", F.posexplode("_ids").alias("_at", target_id)).select(peak_id, target_id, (F.col("_first") + F.col("_at")).alias("place"))

    mixed = unsent(hits.where("_equal > 1")).join(targets.select(target_id, target), target)
    mixed = mixed.select(peak_id, target_id, (F.col("_before") + F.row_number().over(Window.partitionBy(scan, *key).orderBy(F.col(target_id).asc_nulls_last()))).alias("place"))
    return alone.unionByName(mixed)


def nearest_join(peaks: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, peak_id: str, mz: str = "mz", target: str = "target_mz", keys: list[str] | None = None) -> DataFrame:
    """j02: the nearest target of each peak within the tolerance; ties go to the smaller target."""
    j = interval_join(peaks, targets, tol, largest, mz, target, keys)
    cols = j.columns
    best = F.min_by(F.struct(*cols), F.struct(F.abs(F.col(mz) - F.col(target)), F.col(target)))
    return j.groupBy(F.col(peak_id).alias("_pid")).agg(best.alias("_r")).select("_r.*")


def neutral_loss_join(frags: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, precursor: str = "prec_mz", mz: str = "mz") -> DataFrame:
    """j05: precursor less fragment against the target; the window is sized from the fragment."""
    f = frags.withColumn("nl_mz", F.col(precursor) - F.col(mz))
    j = bucketed(f, targets, F.col("nl_mz"), F.col("target_mz"), tol.most(largest))
    return j.where(F.abs(F.col("nl_mz") - F.col("target_mz")) <= tol.width(F.col(mz)))


def associate(clusters: DataFrame, survey: DataFrame, window: float, cluster: str = "prec", entry: str = "mz", keys: list[str] | None = None) -> DataFrame:
    """j07: each entry within the window of a cluster; on overlap the nearer precursor wins, ties go to the larger."""
    j = bucketed(survey, clusters, F.col(entry), F.col(cluster), window, keys).where(F.abs(F.col(entry) - F.col(cluster)) < window)
    w = Window.partitionBy(*(keys or []), *[c for c in survey.columns if c not in (keys or [])]).orderBy(F.abs(F.col(entry) - F.col(cluster)), F.desc(cluster))
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ladder(entries: DataFrame, tol: Tolerance, largest: float, spacing: float = 1.0033, steps: int = 4, charge: int = 1, key: str = "se_id", mz: str = "mz", keys: list[str] | None = None) -> DataFrame:
    """j15: entries one to ``steps`` isotope spacings above each entry: key, iso_key, step."""
    keys = keys or []
    base = entries.select(*keys, F.col(key).alias("base_key"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.col(mz).alias("base_mz"))
    base = base.withColumn("target_mz", F.col("base_mz") + F.col("step") * F.lit(spacing / charge))
    iso = entries.select(*keys, F.col(key).alias("iso_key"), F.col(mz).alias("iso_mz"))
    j = bucketed(iso, base, F.col("iso_mz"), F.col("target_mz"), tol.most(largest), keys)
    return j.where(tol.fits(F.col("iso_mz"), F.col("target_mz"))).select(*keys, "base_key", "iso_key", "step", "base_mz", "iso_mz")


def sibling(entries: DataFrame, diff: float, tol: Tolerance, largest: float, key: str = "se_id", mz: str = "mz", sign: str = "polarity") -> DataFrame:
    """j18: for each positive entry the negative entries at mz + diff."""
    pos = entries.where(F.col(sign) > 0).select(F.col(key).alias("pos_key"), F.col(mz).alias("pos_mz"), (F.col(mz) + diff).alias("target_mz"))
    neg = entries.where(F.col(sign) < 0).select(F.col(key).alias("neg_key"), F.col(mz).alias("neg_mz"))
    return bucketed(neg, pos, F.col("neg_mz"), F.col("target_mz"), tol.most(largest)).where(tol.fits(F.col("neg_mz"), F.col("target_mz"))).select("pos_key", "neg_key", "pos_mz", "neg_mz")


def charge_by_spacing(entries: DataFrame, tol: Tolerance, largest: float, key: str = "se_id", mz: str = "mz", most: int = 3) -> DataFrame:
    """j19: the highest charge with an entry at the first isotope of its spacing (null: none)."""
    parts = None
    for z in range(1, most + 1):
        p = ladder(entries, tol, largest, 1.0033, 1, z, key, mz).select(F.col("base_key").alias(key), F.lit(z).alias("z")).distinct()
        parts = p if parts is None else parts.unionByName(p)
    top = parts.groupBy(key).agg(F.max("z").alias("charge"))
    return entries.join(top, key, "left")


def nearest_any(left: DataFrame, right: DataFrame, left_id: str, lm: str = "mz", rm: str = "target_mz") -> DataFrame:
    """j17: the nearest right value of each left value, at any distance.

    Both sides go into one ordered stream per block of mass; the nearest value on each
    side comes from the block itself or from the border values of the blocks around it.
    """
    width = 1.0
    both = left.select(F.col(left_id).alias("_id"), F.col(lm).alias("_m"), F.lit(None).cast("double").alias("_t")).unionByName(
        right.select(F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), F.col(rm).alias("_m"), F.col(rm).alias("_t"))
    )
    both = both.withColumn("_b", F.floor(F.col("_m") / width))
    # Border values: blocks are few (the span of masses), so one ordered pass over them is small.
    per = both.groupBy("_b").agg(F.max("_t").alias("_hi"), F.min("_t").alias("_lo"))
    o = Window.orderBy("_b")
    per = per.select("_b", F.last("_hi", True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_under"), F.first("_lo", True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("_over"))
    w = Window.partitionBy("_b").orderBy("_m", F.col("_t").asc_nulls_last())
    w2 = Window.partitionBy("_b").orderBy(F.desc("_m"), F.col("_t").asc_nulls_last())
    j = both.withColumn("_u", F.last("_t", True).over(w)).withColumn("_o", F.last("_t", True).over(w2))
    j = j.where(F.col("_t").isNull()).join(per, "_b").select("_id", "_m", F.coalesce("_u", "_under").alias("_u"), F.coalesce("_o", "_over").alias("_o"))
    pick = F.when(F.col("_o").isNull(), F.col("_u")).when(F.col("_u").isNull(), F.col("_o")).when(F.col("_m") - F.col("_u") <= F.col("_o") - F.col("_m"), F.col("_u")).otherwise(F.col("_o"))
    return j.select(F.col("_id").alias(left_id), F.col("_m").alias(lm), pick.alias(rm))


def _neighbours(peaks: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, peak_id: str, mz: str, target: str) -> DataFrame:
    """Distinct target masses (_t) with the next mass on each side (_u at or below, _o at or above) as far as the tolerance goes: (_m, _p), the mass
    and its smallest peak.

    A mass beyond the next one fits only if the next one does, so these two decide what is nearest; no pairs are made. The ends of a
    bucket are copied to its neighbours.
    """
    reach = tol.most(largest)
    p = peaks.where(F.col(mz).isNotNull()).groupBy(F.col(mz).alias("_m")).agg(F.min(peak_id).alias("_p"))
    p = p.select(F.floor(F.col("_m") / reach).alias("_b"), "_m", F.struct("_m", "_p").alias("_s"))
    ends = p.groupBy("_b").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    p = p.unionByName(ends.select((F.col("_b") + 1).alias("_b"), F.col("_hi._m").alias("_m"), F.col("_hi").alias("_s")))
    p = p.unionByName(ends.select((F.col("_b") - 1).alias("_b"), F.col("_lo._m").alias("_m"), F.col("_lo").alias("_s")))
    t = targets.select(F.col(target).alias("_t")).where("_t is not null").distinct().select(F.floor(F.col("_t") / reach).alias("_b"), F.col("_t").alias("_m"), "_t")
    both = p.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy("_b")
    both = both.select("_t", F.last("_s", True).over(w.orderBy("_m")).alias("_u"), F.last("_s", True).over(w.orderBy(F.desc("_m"))).alias("_o")).where("_t is not null")
    return both.select("_t", *[F.when(tol.fits(F.col(f"{c}._m"), F.col("_t")), F.col(c)).alias(c) for c in ("_u", "_o")])


def lookup(peaks: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, peak_id: str, mz: str = "mz", target: str = "target_mz") -> DataFrame:
    """j20: the targets that have a peak within the tolerance, with the nearest one (ties: smaller mass, then smaller id)."""
    n = _neighbours(peaks, targets, tol, largest, peak_id, mz, target)
    sides = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._m") - F.col("_t")), F.col(f"{c}._m"), F.col(f"{c}._p").alias("_p"))) for c in ("_u", "_o")]
    best = n.select("_t", F.array_min(F.array(*sides))["_p"].alias(peak_id)).where(F.coalesce("_u", "_o").isNotNull())
    return targets.join(best, F.col(target) == F.col("_t")).drop("_t")


def nearest_hits_join(peaks: DataFrame, targets: DataFrame, tol: Tolerance, largest: float, most: float, digits: int = 6, peak_id: str = "peak_id", mz: str = "mz", target: str = "target_mz") -> DataFrame:
    """a24: all pairs within the tolerance whose error, rounded to ``digits``, is the least of the target and at most ``most``.

    The least errors come from the next masses; the masses that have them are found by an equi-join on the mass in
    units of the last digit. Only pairs of the result are made.
    """
    err = lambda m: F.abs(F.round(m - F.col("_t"), digits))
    n = _neighbours(peaks, targets, tol, largest, peak_id, mz, target)
    n = n.select("_t", F.least(err(F.col("_u._m")), err(F.col("_o._m"))).alias("_least")).where(F.col("_least") <= most)
    unit = 10**digits
    at = [F.floor((F.col("_t") + sign * F.col("_least")) * unit) + k for sign in (-1, 1) for k in (-1, 0, 1)]
    n = n.select("_t", "_least", F.explode(F.array_distinct(F.array(*at))).alias("_k"))
    masses = peaks.select(F.col(mz).alias("_m")).distinct().withColumn("_k", F.floor(F.col("_m") * unit))
    hits = masses.join(n, "_k").where((err(F.col("_m")) == F.col("_least")) & tol.fits(F.col("_m"), F.col("_t"))).select("_m", "_t")
    return peaks.join(targets.join(hits, F.col(target) == F.col("_t")), F.col(mz) == F.col("_m")).drop("_m", "_t")
