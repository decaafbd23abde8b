"""Folds in blocks against their sequential form; blocks are made small, so that keys span many of them."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from massweave.chem import Tolerance
from massweave.operators import aggregates, blocks, fold, isotope


def bins_of(masses, width, closed=False):
    out, anchor = [], None
    for x in masses:
        if anchor is None or not (x - anchor <= width(anchor) if closed else x - anchor < width(anchor)):
            anchor = x
        out.append(anchor)
    return out


@pytest.mark.parametrize("tol", [Tolerance("res", 2000), Tolerance("da", 0.004), Tolerance("ppm", 400), Tolerance("da", 3.0), Tolerance("da", 1e-7)])
def test_dense_masses_over_many_blocks(spark, tol):
    rng = random.Random(1)
    data = [(rng.choice(["a", None]), rng.choice("xyz"), 100 + round(rng.uniform(0, 0.6), 4)) for _ in range(900)] + [("b", "x", 5.0), (None, "x", 900.0)]
    df = spark.createDataFrame(data, "k string, s string, mz double")
    got = sorted((str(r.k), r.mz, r.anchor) for r in blocks.anchored(df, ["k"], tol, rows=13).collect())
    want = []
    for k in {k for k, _, _ in data}:
        m = sorted(x for q, _, x in data if q == k)
        want += [(str(k), x, a) for x, a in zip(m, bins_of(m, tol.width_of), strict=True)]
    assert got == sorted(want)


def test_no_frame_is_larger_than_a_block(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.lit(100.0) + F.col("id") * 1e-6).alias("mz"), F.lit(1.0).alias("i"))
    packed = blocks.pack(df, ["k"], ["mz"], 100)
    assert packed.agg(F.max(F.size("rows"))).first()[0] == 100 and packed.count() >= 50
    assert fold.align(df, ["k"], Tolerance("da", 1.0), 3, rows=100).select("bin_first").distinct().count() == 1


def test_several_passes_over_many_blocks(spark):
    rng = random.Random(3)
    data = [(100 + rng.uniform(0, 1), float(rng.randint(1, 9))) for _ in range(700)]
    df = spark.createDataFrame([("q", m, i) for m, i in data], "k string, mz double, i double")
    groups = [[p] for p in sorted(data)]
    for _ in range(3):
        c = [sum(m * i for m, i in g) / sum(i for _, i in g) for g in groups]
        joined = defaultdict(list)
        for a, g in zip(bins_of(c, lambda m: m / 5000), groups, strict=True):
            joined[a] += g
        groups = list(joined.values())
    got = sorted((r.mz, round(r.bin_mz, 7), r.bin_first) for r in fold.align(df, ["k"], Tolerance("res", 5000), 3, True, rows=17).collect())
    assert got == sorted((m, round(sum(x * i for x, i in g) / sum(i for _, i in g), 7), min(g)[0]) for g in groups for m, _ in g)


@pytest.mark.parametrize("most", [0.02, 5.0])
def test_collapse_over_blocks(spark, most):
    rng = random.Random(4)
    data = sorted({round(rng.uniform(100, 104), 3): sorted(rng.sample("abcdef", rng.randint(1, 2))) for _ in range(400)}.items())
    df = spark.createDataFrame([("A", m, s) for m, s in data] + [("B", 1.0, ["a"])], "flag string, mz double, samples array<string>")
    want, have, first, last = {1.0: 1.0}, set(), None, None
    for m, s in data:
        if last is not None and m - last <= most and not have & set(s):
            have |= set(s)
        else:
            have, first = set(s), m
        want[m], last = first, m
    assert {r.mz: r.merged for r in fold.collapse_clusters(df, ["flag"], most, rows=11).collect()} == want


def learnt(masses, n_samples, how, passes):
    """Lists of members: the descending fold, all in one place."""
    elements = [(m, [m]) for m in sorted(masses, reverse=True)]
    gaps = sorted(a - b for (a, _), (b, _) in zip(elements[: 10 * n_samples + 1], elements[1 : 10 * n_samples + 1]))
    if how.start == "below_mean":
        low = [g for g in gaps if g < sum(gaps) / len(gaps)]
        start = sum(low) / len(low) if low else how.least_gap
    else:
        some = [g for g in gaps if how.noise < g < 0.1][:n_samples]
        start = 2 * sum(some) / len(some) if some else how.least_gap * 0.99
    for _ in range(passes):
        width, first, out = start, None, []
        for m, own in elements:
            if out and out[-1][0] - m < width and not len(own) >= 0.95 * n_samples:
                out[-1][1].append(m)
                out[-1][2].extend(own)
                continue
            if out and len(out[-1][1]) >= 0.95 * n_samples:
                new = how.factor * (out[-1][1][0] - out[-1][1][-1])
                if 1e-5 < new < width:
                    width, first = new, first or new
            out.append((m, [m], list(own)))
        elements = [(sum(own) / len(own), own) for _, _, own in out]
        start = first or (how.least_gap * 0.99 if how.start == "smallest" else start)
    return [own for _, own in elements]


@pytest.mark.parametrize("how", [fold.Learnt(), fold.Learnt(10.0, "below_mean")])
@pytest.mark.parametrize("passes", [1, 3])
def test_learnt_windows(spark, how, passes):
    rng = random.Random(9)
    masses = {k: [500 - 3 * j + rng.gauss(0, 0.002) for j in range(40) for _ in range(rng.choice([1, 4, 4, 4]))] for k in "ab"}
    df = spark.createDataFrame([(k, m, 1.0) for k in masses for m in masses[k]], "k string, mz double, i double")
    got = sorted((r.k, r.mz, round(r.bin_mz, 8), r.bin_first) for r in fold.learnt_align(df, ["k"], 4, how, passes, rows=9).collect())
    assert got == sorted((k, m, round(sum(g) / len(g), 8), min(g)) for k in masses for g in learnt(masses[k], 4, how, passes) for m in g)
    assert fold.learnt_align(df.limit(0), ["k"], 4, how, passes).count() == 0


def test_msms_collapse(spark):
    rng = random.Random(5)
    clusters = []
    for j in range(120):
        s = rng.sample("abcd", rng.randint(1, 3))
        clusters.append((round(100 + j * 0.01, 3), [(x, 100 + j * 0.01 + rng.uniform(-0.02, 0.02), float(rng.choice([1, 2, 900, 1000]))) for x in sorted(s)]))
    df = spark.createDataFrame([("k", m, c) for m, c in clusters], "k string, mz double, members array<struct<sample:string,mass:double,intensity:double>>")
    want, state = [], None
    for _, c in clusters:
        closed, state = fold.collapse_step(state, c)
        want += closed
    want.append(state)
    got = [[tuple(x) for x in r.members] for r in fold.collapse_msms(df, ["k"], rows=7).collect()]
    assert sorted(got) == sorted([tuple(x) for x in g] for g in want)
    # Members are dealt anew by intensity, none is made up.
    assert {x for g in got for x in g} <= {x for _, c in clusters for x in c}


def test_msms_collapse_steps():
    low, high = [("a", 100.0, 1.0), ("b", 100.1, 100.0)], [("a", 100.05, 99.0), ("b", 100.1, 2.0)]
    assert fold.collapse_step([("a", 100.0, 1.0)], [("b", 100.0, 9.0)])[0] == [[("a", 100.0, 1.0)]]  # no span, means are not nearer
    assert fold.collapse_step([("a", 100.0, 1.0), ("c", 100.2, 1.0)], [("b", 100.1, 9.0)]) == ([], [("a", 100.0, 1.0), ("b", 100.1, 9.0), ("c", 100.2, 1.0)])
    closed, current = fold.collapse_step(low, [("a", 100.05, 300.0), ("b", 100.1, 900.0)])
    assert sorted([*closed, current]) == [[("a", 100.0, 1.0), ("b", 100.1, 100.0)], [("a", 100.05, 300.0), ("b", 100.1, 900.0)]]
    closed, current = fold.collapse_step(low, high)  # no member near the middles: dealt anew
    assert (closed, current) == ([[("a", 100.0, 1.0), ("b", 100.1, 2.0)]], [("a", 100.05, 99.0), ("b", 100.1, 100.0)])


def test_chained_clusters(spark):
    rng = random.Random(6)
    data = [(round(100 + rng.uniform(0, 2), 3), float(rng.randint(0, 2))) for _ in range(300)]
    df = spark.createDataFrame([("k", m, i) for m, i in data], "k string, mz double, i double")
    groups = defaultdict(list)
    data.sort()
    for a, p in zip(bins_of([m for m, _ in data], lambda m: m / 4000, True), data, strict=True):
        groups[a].append(p)
    mean = lambda g: sum(m * i for m, i in g) / sum(i for _, i in g) if sum(i for _, i in g) else sum(m for m, _ in g) / len(g)
    got = sorted((round(r.mz, 8), r.i, r.n) for r in fold.chained_clusters(df, ["k"], 4000, rows=8).collect())
    assert got == sorted((round(mean(g), 8), sum(i for _, i in g), len(g)) for g in groups.values())


def corrected(rows, width, spacing=1.0033):
    """Entries (mz, i, pattern, charge, reach) in ascending order."""
    val = [r[1] for r in rows]
    for k, r in enumerate(rows):
        for b in range(k):
            for step in range(1, 5):
                if abs(r[0] - (rows[b][0] + step * spacing / rows[b][3])) <= width and rows[b][4] >= step and val[b] > 0 and val[k] > 0:
                    val[k] -= val[b] * rows[b][2][step]
                    val[k] = -1.0 if val[k] < 0 else val[k]
    return val


def test_ms1_correction_in_waves(spark):
    rng = random.Random(7)
    rows = []
    for s in "ab":
        for key, m in enumerate(sorted({round(rng.uniform(200, 230), 1) for _ in range(200)})):
            rows.append((key, m, s, float(rng.randint(1, 100)), [1.0, rng.uniform(0, 0.5), rng.uniform(0, 0.2), 0.05, 0.01], rng.choice([1, 1, 2]), rng.randint(0, 4)))
    df = spark.createDataFrame(rows, "se_id int, mz double, sample string, i double, pattern array<double>, charge int, reach int")
    got = {(r.sample, r.se_id): r.corrected for r in isotope.correct(df, Tolerance("da", 0.06), [], rows=20).collect()}
    for s in "ab":
        mine = [r for r in rows if r[2] == s]
        want = corrected([(r[1], r[3], r[4], r[5], r[6]) for r in mine], 0.06)
        assert all(abs(got[s, r[0]] - w) < 1e-9 for r, w in zip(mine, want, strict=True))


def test_reach_is_a_gate(spark):
    rows = [(1, s, i, [1.0, 0.5, 0.4, 0.01, 0.3]) for s, i in (("a", 100.0), ("b", 1.0))]
    df = spark.createDataFrame(rows, "se_id int, sample string, i double, pattern array<double>")
    assert isotope.reach(df, "se_id", 10.0, 0.5, 2).first().reach == 2
    assert isotope.reach(df, "se_id", 10.0, 1.0, 2).first().reach == 0


def test_msms_correction(spark):
    rng = random.Random(8)
    rows = []
    for s in "ab":
        for p in range(300, 316):
            for m in sorted({round(100 + j * 1.0033 + rng.choice([0, 0, 0.4]), 4) for j in range(5)}):
                rows.append((len(rows), round(p * 1.0033, 4), m, s, float(rng.randint(1, 60)), isotope.pattern({"C": rng.randint(1, 20)}).tolist(), isotope.pattern({"C": rng.randint(1, 20), "O": 2}).tolist()))
    df = spark.createDataFrame(rows, "fr_id int, prec_mz double, mz double, sample string, i double, fragment array<double>, loss array<double>")
    got = {r.fr_id: r.corrected for r in isotope.correct_msms(df, Tolerance("da", 0.01), [], rows=16).collect()}
    for s in "ab":
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[1], r[2]))
        val = [r[4] for r in mine]
        for k, r in enumerate(mine):
            for b in range(k):
                for a in range(1, 5):
                    for j in range(a + 1):
                        near = abs(r[1] - mine[b][1] - a * 1.0033) <= 0.01 and abs(r[2] - mine[b][2] - j * 1.0033) <= 0.01
                        if near and val[b] > 0 and val[k] > 0:
                            val[k] -= val[b] * mine[b][5][j] * mine[b][6][a - j] / (mine[b][5][0] * mine[b][6][0])
                            val[k] = -1.0 if val[k] < 0 else val[k]
        assert all(abs(got[r[0]] - v) < 1e-9 for r, v in zip(mine, val, strict=True))


def test_trigger_peak(spark):
    scans = spark.createDataFrame([(1, 0, 2, 5.0), (2, 0, 1, None), (3, 0, 2, 100.0), (4, 0, 1, None), (5, 0, 2, 100.0)], "scan_id int, run int, ms_level int, target_mz double")
    peaks = spark.createDataFrame([(2, 99.0, 1.0), (2, 101.0, 2.0), (2, 300.0, 9.0)], "scan_id int, mz double, i double")
    got = {r.scan_id: (r.trigger, r.peak_mz) for r in aggregates.trigger_peak(scans, peaks, ["run"], ["scan_id"]).collect()}
    assert got == {1: (None, None), 3: (2, 99.0), 5: (4, None)}


def test_overlap_matrix():
    f, n = isotope.pattern({"C": 10}), isotope.pattern({"C": 5, "O": 1})
    m = isotope.overlap_matrix(f, n)
    whole = isotope.pattern({"C": 15, "O": 1})
    assert np.allclose(m.sum(1), whole)  # a row sums up to the precursor's isotope
    assert m[2, 1] == f[1] * n[1] and m[1, 2] == 0


def test_rounds_follow_the_rows_not_the_partitions(spark):
    """i03, i05: a small table is one block, so its keys need one round."""
    df = spark.createDataFrame([(k % 2, float(k)) for k in range(40)], "k int, mz double")
    assert blocks.pack(df, ["k"], ["mz"], 100, True).count() == 1
    assert blocks.pack(df, ["k"], ["mz"], 5, True).selectExpr("max(size(rows))").first()[0] == 5


def test_entries_without_a_spacing_between_them_are_corrected_at_once():
    m = np.array([100.0, 100.5, 100.9, 101.0033, 101.2, 105.0])
    runs = list(isotope._independent(m, np.full(6, 0.01), 1.0033, 0))
    assert runs == [(0, 3), (3, 5), (5, 6)]
    val = np.array([10.0, 1.0, 5.0])
    isotope._subtract(val, np.array([0, 0, 1, 1, 2]), np.array([4.0, 3.0, 2.0, -9.0, 5.0]))
    assert val.tolist() == [3.0, -1.0, 0.0]  # what is below zero is no longer read


def test_copies_of_a_mass_are_one_row():
    """a03, a06: a row with a count folds as its copies did one by one, also over full bins and a window of zero."""
    import pyarrow as pa

    rng = random.Random(3)
    for w0 in (0.0, 0.5):
        rows = sorted(((round(rng.uniform(0, 20), 2), rng.randint(1, 5)) for _ in range(300)), reverse=True)
        rows = [(m, c) for k, (m, c) in enumerate(rows) if not k or rows[k - 1][0] != m]
        table = lambda r: pa.table({"_m": [m for m, _ in r], "_n": [1] * len(r), "_w0": [w0] * len(r), "_c": [c for _, c in r]})  # noqa: E731, B023
        for n in (1, 4):
            one, end = fold.learnt_bins(table(rows), None, n, fold.Learnt(), "_m")
            many, last = fold.learnt_bins(table([(m, 1) for m, c in rows for _ in range(c)]), None, n, fold.Learnt(), "_m")
            assert [x for x, (_, c) in zip(one, rows, strict=True) for _ in range(c)] == many and end == last
