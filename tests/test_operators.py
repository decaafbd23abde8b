import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from massweave import catalog
from massweave.chem import Tolerance
from massweave.functions import scalar
from massweave.operators import aggregates, filters, fold, intervals, isotope


def brute_bins(m, width):
    out, anchor, n = [], None, -1
    for x in m:
        if anchor is None or not x - anchor < width(anchor):
            anchor, n = x, n + 1
        out.append(n)
    return out


@pytest.mark.parametrize("tol", [Tolerance("res", 200), Tolerance("ppm", 500), Tolerance("da", 0.3), Tolerance("res", 300, 1.5, 50)])
def test_greedy_is_the_sequential_fold(tol):
    rng = np.random.default_rng(5)
    m = np.sort(np.round(rng.uniform(50, 300, 3000), 2))
    assert fold.greedy(m, np.asarray(tol.width_of(m), float)).tolist() == brute_bins(m.tolist(), lambda a: tol.width_of(a))


def test_align_equals_one_task(spark):
    rng = np.random.default_rng(6)
    m = np.round(rng.uniform(50, 900, 2000), 3)
    df = spark.createDataFrame([(k % 2, float(x), 1.0 + k % 3) for k, x in enumerate(m)], "k int, mz double, i double")
    tol = Tolerance("res", 3000)
    got = {(r.k, r.mz): r.bin_mz for r in fold.align(df, ["k"], tol, 3).collect()}
    for k in (0, 1):
        s = np.sort(m[k::2])
        b = fold.fold(s, np.ones(len(s)), tol, 3)
        c = np.bincount(b, s) / np.bincount(b)
        assert all(abs(got[k, x] - c[j]) < 1e-9 for x, j in zip(s.tolist(), b.tolist(), strict=True))


def test_align_empty_and_single(spark):
    df = spark.createDataFrame([], "k int, mz double, i double")
    assert fold.align(df, ["k"], Tolerance("da", 1)).count() == 0
    one = spark.createDataFrame([(1, 5.0, 2.0)], "k int, mz double, i double")
    assert fold.align(one, ["k"], Tolerance("da", 1)).first().bin_mz == 5.0


def test_interval_join_at_the_very_tolerance(spark):
    p = spark.createDataFrame([(1, 100.0), (2, 100.5), (3, 101.0000001)], "id long, mz double")
    t = spark.createDataFrame([(10, 100.5)], "tid long, target_mz double")
    got = {r.id for r in intervals.interval_join(p, t, Tolerance("da", 0.5), 200.0).collect()}
    assert got == {1, 2}


def test_nearest_tie_takes_smaller(spark):
    p = spark.createDataFrame([(1, 10.0)], "id long, mz double")
    t = spark.createDataFrame([(9.5,), (10.5,)], "target_mz double")
    assert intervals.nearest_join(p, t, Tolerance("da", 1), 20.0, "id").first().target_mz == 9.5


def test_collapse_needs_disjoint_samples():
    m = np.array([1.0, 1.1, 1.2])
    assert fold.collapse(m, [frozenset("a"), frozenset("b"), frozenset("a")], 0.15).tolist() == [0, 0, 1]


def test_isotope_pattern_and_cascade(spark):
    p = isotope.pattern({"C": 100})
    assert p[0] == 1.0 and abs(p[1] - 100 * 0.0107 / 0.9893) < 1e-9
    rows = [(1, 100.0, "s", 100.0), (2, 101.0033, "s", 60.0), (3, 102.0066, "s", 5.0), (4, 300.0, "s", 7.0)]
    df = spark.createDataFrame(rows, "se_id long, mz double, sample string, i double").withColumn("pattern", F.array(*[F.lit(x) for x in (1.0, 0.5, 0.1, 0.0, 0.0)]))
    got = {r.se_id: r.corrected for r in isotope.correct(df, Tolerance("da", 0.01), []).collect()}
    # 60 - 50 = 10; 5 - 10 (from the first) is negative, so -1.
    assert got == {1: 100.0, 2: 10.0, 3: -1.0, 4: 7.0}


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 3.0},)], "m map<string,double>")
    r = df.select(
        scalar.map_average(F.col("m")).alias("avg"),
        scalar.median_upper(F.map_values("m")).alias("up"),
        scalar.median_lower(F.map_values("m")).alias("low"),
        filters.all_of(F.col("m"), ">", 0.5).alias("all"),
        F.size(filters.select_glob(F.col("m"), "*b*")).alias("n"),
        scalar.map_num("/", F.col("m"), F.lit(0.0))["a"].alias("zero"),
    ).first()
    assert (r.avg, r.up, r.low, r.all, r.n, r.zero) == (2.0, 3.0, 1.0, True, 1, 0.0)


def test_printf(spark):
    c = scalar.printf("CE %d:%d %.2f %%", [(F.lit(3.9), "num"), (F.lit(-1.5), "num"), (F.lit(2.345), "num")])
    assert spark.range(1).select(c.alias("x")).first().x.startswith("CE 3:-1 2.3")
    with pytest.raises(ValueError):
        scalar.printf("%d %d", [(F.lit(1), "num")])
    with pytest.raises(ValueError):
        scalar.printf("%n", [])


def test_mixed_polarity_is_an_error(spark):
    df = spark.createDataFrame([("f", 1), ("f", -1)], "file string, polarity int")
    with pytest.raises(Exception, match="mixed polarity"):
        filters.assert_one_polarity(df, ["file"]).collect()


def test_merge_tables_outer(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(2, 3.0)], "k int, x double")
    got = sorted(tuple(r) for r in aggregates.merge_tables([("a", a), ("b", b)], ["k"]).collect())
    assert got == [(1, 2.0, 0.0), (2, 0.0, 3.0)]


def _near_case(spark):
    import random

    rng = random.Random(5)
    mz = [round(rng.uniform(100, 101), 4) for _ in range(300)] + [100.5, 100.502, 100.501]
    peaks = [(9 - c + 10 * k, m) for k, m in enumerate(mz) for c in range(3)]
    targets = [(c + 10 * k, t) for k, t in enumerate([100.501, 99.999, 150.0] + [round(rng.uniform(99.9, 101.1), 4) for _ in range(60)]) for c in range(2)]
    p = spark.createDataFrame([*peaks, (7, None)], "peak_id int, mz double")
    return peaks, targets, p, spark.createDataFrame([*targets, (5, None)], "target_id int, target_mz double")


def test_lookup_of_copies(spark):
    """j20 against all pairs; copies on both sides, ties and borders of buckets."""
    peaks, targets, p, t = _near_case(spark)
    tol = Tolerance("ppm", 20)
    got = {r.target_id: r.peak_id for r in intervals.lookup(p, t, tol, 1100.0, "peak_id").collect()}
    want = {}
    for i, x in targets:
        fits = [(abs(m - x), m, k) for k, m in peaks if abs(m - x) <= m * 20 / 1e6]
        if fits:
            want[i] = min(fits)[2]
    assert got == want and len(want) > 20


def test_nearest_hits_of_copies(spark):
    """a24 against all pairs: every peak and target whose error is the least of its target."""
    peaks, targets, p, t = _near_case(spark)
    got = sorted((r.peak_id, r.target_id) for r in intervals.nearest_hits_join(p, t, Tolerance("ppm", 20), 1100.0, 0.0015).collect())
    want = []
    for i, x in targets:
        fits = [(round(abs(m - x), 6), k) for k, m in peaks if abs(m - x) <= m * 20 / 1e6]
        want += [(k, i) for e, k in fits if e == min(fits)[0] and e <= 0.0015]
    assert got == sorted(want) and len(want) > 100


def test_places_across_ranges(spark):
    """o01: a key that lies in several ranges is counted on."""
    df = spark.createDataFrame([(k % 2 and "a" or None, float(k % 37), k) for k in range(400)], "s string, mz double, id long")
    cut = aggregates.ranked(df, ["s"], ["mz", "id"], rows=40).collect()
    for s in ("a", None):
        mine = sorted((r.mz, r.id) for r in cut if r.s == s)
        assert [(r.mz, r.id) for r in sorted((r for r in cut if r.s == s), key=lambda r: r.idx)] == mine
        assert sorted(r.idx for r in cut if r.s == s) == list(range(1, 201))


def test_pairs_come_from_runs_of_ids(spark, tmp_path):
    """j01: equal to brute force with many copies of a mass, null ids and null masses; no pair is shuffled and no table broadcast."""
    rng = random.Random(4)
    peaks = [(rng.choice([k, k, None, 7]), rng.choice([950.0, 950.019, 950.0190001, 949.981, 20.0, None])) for k in range(60)]
    targets = [(rng.choice([k, k, None, 5]), 950.0) for k in range(600)] + [(k, rng.choice([949.99, 950.02, 20.0004, 20.0005, None])) for k in range(40)]
    p, t = spark.createDataFrame(peaks, "peak_id long, mz double"), spark.createDataFrame(targets, "target_id long, target_mz double")
    tol = Tolerance("ppm", 20)
    got = Counter(tuple(r) for r in intervals.interval_pairs(p, t, tol, 1100.0, "peak_id", "target_id").collect())
    assert got == Counter((i, j) for i, m in peaks for j, x in targets if m is not None and x is not None and abs(m - x) <= m * 20 / 1e6)
    run = intervals.runs(t.where("target_mz = 950"), ["target_mz"], "target_id").orderBy("run").collect()
    assert [len(r.ids) for r in run[:2]] == [intervals.RUN, intervals.RUN] and [r.run for r in run] == list(range(len(run)))
    for n in ("lineitem", "part"):
        (tmp_path / f"{n}.parquet").symlink_to(f"/root/testdata/sf0.001/{n}.parquet")
    plan = catalog.queries()["j01_interval"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.index("Generate explode(ids") < plan.index("SortMergeJoin")  # laid out above the join


def test_places_of_pairs_equal_a_full_ranking(spark, tmp_path):
    """o03: equal peaks, two masses at one error, null ids and ties; pairs are not shuffled to be ranked."""
    rng = random.Random(8)
    peaks = [(rng.choice([1, 2, None]), rng.choice([0.0, 3.0]), rng.choice([k, k, 7, None]), rng.choice([950.0, 950.0078125, 950.015625, 950.01, 20.0, None])) for k in range(80)]
    targets = [(rng.choice([k, k, 5, None]), 950.0) for k in range(300)] + [(1000 - k, 950.015625) for k in range(40)] + [(9, 20.0), (3, None)]
    p, t = spark.createDataFrame(peaks, "scan_id long, time double, peak_id long, mz double"), spark.createDataFrame(targets, "target_id long, target_mz double")
    got = Counter(tuple(r) for r in intervals.ranked_pairs(p, t, Tolerance("ppm", 20), 1100.0, "scan_id", ["time"], "peak_id", "target_id").collect())
    last = lambda v: (v is None, v or 0)
    pairs = defaultdict(list)
    for s, time, i, m in peaks:
        for j, x in targets:
            if m is not None and x is not None and abs(m - x) <= m * 20 / 1e6:
                pairs[s].append((abs(m - x), time, last(i), last(j), i, j))
    assert got == Counter((i, j, k + 1) for rows in pairs.values() for k, (*_, i, j) in enumerate(sorted(rows, key=lambda r: r[:4])))
    for n in ("lineitem", "part"):
        (tmp_path / f"{n}.parquet").symlink_to(f"/root/testdata/sf0.001/{n}.parquet")
    plan = catalog.queries()["o03_two_errors"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode(_ids" in plan and "Broadcast" not in plan
