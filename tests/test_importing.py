"""Import of spectra against plain Python."""

import random
from collections import defaultdict

import pytest

from massweave import chem
from massweave.chem import Tolerance
from massweave.plans import identify, importing, lang

RES = Tolerance("res", 20000)


def greedy(values, width):
    """Bins of sorted values: a bin opens at its first value and takes what is nearer than its window."""
    out = []
    for v in values:
        if out and v - out[-1][0] < width(out[-1][0]):
            out[-1].append(v)
        else:
            out.append([v])
    return out


def fold(peaks, width, passes, weighted):
    """Lists of (mz, i, ...) rows: bins after some passes over the centres."""
    groups = [[p] for p in sorted(peaks)]
    for k in range(passes):
        if not k:
            centre = lambda g: g[0][0]
        elif weighted:
            centre = lambda g: sum(p[0] * p[1] for p in g) / sum(p[1] for p in g)
        else:
            centre = lambda g: sum(p[0] for p in g) / len(g)
        c = [centre(g) for g in groups]
        new, anchor = [], None
        for x, g in zip(c, groups, strict=True):
            if anchor is not None and x - anchor < width(anchor):
                new[-1] += g
            else:
                anchor = x
                new.append(list(g))
        groups = new
    return groups


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for sample in "abc":
        for scan in range(6):
            prec = rng.choice([300.1, 300.3, 301.2, 555.0]) + rng.uniform(-0.05, 0.05)
            for m in (100.0, 100.008, 150.5, 200.25):
                for _ in range(rng.randint(0, 3)):
                    out.append((1, sample, scan, prec, m + rng.gauss(0, 0.002), rng.uniform(1, 9)))
    return out


@pytest.mark.parametrize("passes", [1, 3])
def test_merge_and_alignment_of_ms2_match_brute_force(spark, passes):
    data = rows()
    df = spark.createDataFrame(data, "polarity int, sample string, scan_id int, prec_mz double, mz double, i double")
    merged = importing.merge_msms(df, 0.5, RES, passes).collect()
    width = lambda m: m / 20000
    want, spectra = [], []
    for sample in "abc":
        mine = [r for r in data if r[1] == sample]
        precs = sorted({(r[3], r[2]) for r in mine})
        for b in greedy([p for p, _ in precs], lambda _: 0.5):
            scans = {s for p, s in precs if p in b}
            for g in fold([(r[4], r[5], r[2]) for r in mine if r[2] in scans], width, passes, True):
                mz, i = sum(p[0] * p[1] for p in g) / sum(p[1] for p in g), sum(p[1] for p in g) / len(scans)
                want.append((sample, round(b[0], 6), round(mz, 6), round(i, 6), len({p[2] for p in g}), len(scans)))
                spectra.append((sum(b) / len(b), sample, mz, i))
    assert sorted((r.sample, round(r.prec_first, 6), round(r.mz, 6), round(r.i, 6), r.n_hit, r.n_scans) for r in merged) == sorted(want)
    frag, long = importing.align_msms(importing.merge_msms(df, 0.5, RES, passes), 0.5, RES, 3, passes, 0.5)
    mz_of = {r.fr_id: (round(r.cluster_mz, 5), round(r.mz, 6)) for r in frag.collect()}
    got = defaultdict(float)
    for r in long.collect():
        got[(*mz_of[r.fr_id], r.sample)] += r.i
    want = {}
    precs = sorted({(p, s) for p, s, _, _ in spectra})
    for b in greedy([p for p, _ in precs], lambda _: 0.5):
        inside = [(m, i, s) for p, s, m, i in spectra if b[0] <= p <= b[-1]]
        for g in fold(inside, width, passes, False):
            if len({s for _, _, s in g}) >= 1.5:
                for s in {s for _, _, s in g}:
                    want[(round(sum(b) / len(b), 5), round(sum(m for m, _, _ in g) / len(g), 6), s)] = sum(i for _, i, t in g if t == s)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_from_scans_to_a_report(spark, tmp_path):
    rng = random.Random(1)
    head = chem.Formula(chem.parse_formula("C30 H60 N1 O2").n, 1).mass()
    tail = chem.Formula(chem.parse_formula("C9 H17 O1").n, 1).mass()
    scans, peaks = [], []
    for sample in "ab":
        for k in range(8):
            level = 1 if k % 2 == 0 else 2
            scans.append((sample, f"s{k}", float(k), level, 1, None if level == 1 else head + 0.1))
            near = lambda m: m * (1 + rng.uniform(-1e-6, 1e-6))
            peaks += [(sample, f"s{k}", near(head if level == 1 else tail), 100.0 if sample == "a" else 50.0), (sample, f"s{k}", 700.0 + rng.random(), 3.0)]
    s = spark.createDataFrame(scans, "sample string, scan_id string, time double, ms_level int, polarity int, target_mz double")
    p = spark.createDataFrame(peaks, "sample string, scan_id string, mz double, i double")
    t = importing.import_spectra(s, p, importing.Options(Tolerance("ppm", 10), Tolerance("ppm", 10), repetition=0.6, repetition2=0.6, occupation=1.0))
    importing.save(t, str(tmp_path / "aligned"))
    t = importing.load(spark, str(tmp_path / "aligned"))
    assert (t.survey.count(), t.frag.count()) == (1, 1)
    q = "QUERYNAME = Tail; DEFINE h = 'C[20..40] H[40..80] N1 O[1..3]' WITH CHG = +1; DEFINE t = 'C9 H17 O1' WITH CHG = +1; IDENTIFY h IN MS1+ AND t IN MS2+ REPORT F = h.chemsc; I = h.intensity; T = t.intensity;;"
    out = {r.F: r.asDict() for r in identify.run(lang.parse_query(q), t, None, Tolerance("ppm", 5)).collect()}
    r = out["C30 H60 N1 O2"]
    assert abs(r["I:a"] - 100) < 1e-6 and abs(r["T:b"] - 50) < 1e-6
    none = importing.import_spectra(s.where("false"), p, importing.Options(Tolerance("ppm", 10), Tolerance("ppm", 10)))
    assert none.survey.count() == 0 and none.frag.count() == 0


def mzml(spectra):
    """An mzML text of (index, level, precursor, [(mz, i), ...])."""
    import base64
    import struct

    numbers = lambda v: base64.b64encode(struct.pack(f"<{len(v)}d", *v)).decode()
    out = []
    for k, level, prec, peaks in spectra:
        own = f'<precursorList><precursor spectrumRef="s0"><isolationWindow><cvParam name="isolation window target m/z" value="{prec!r}"/></isolationWindow></precursor></precursorList>' if prec else ""
        arrays = "".join(f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="no compression"/><cvParam name="{name}"/><binary>{numbers(v)}</binary></binaryDataArray>' for name, v in (("m/z array", [m for m, _ in peaks]), ("intensity array", [i for _, i in peaks])))
        out.append(f'<spectrum index="{k}" id="s{k}"><cvParam name="ms level" value="{level}"/><cvParam name="positive scan"/><scanList><scan><cvParam name="scan start time" value="{k}" unitName="minute"/></scan></scanList>{own}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
    return '<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>' + "".join(out) + "</spectrumList></run></mzML>"


def test_from_files_to_a_report(spark, tmp_path):
    from massweave.sources import spectra as reader

    rng = random.Random(2)
    head = chem.Formula(chem.parse_formula("C30 H60 N1 O2").n, 1).mass()
    tail = chem.Formula(chem.parse_formula("C9 H17 O1").n, 1).mass()
    lock = 650.25
    for sample, drift in (("a", 4e-3), ("b", -6e-3), ("c", 5e-3)):
        near = lambda m: m + drift + rng.uniform(-1e-4, 1e-4)  # noqa: E731, B023
        scans = [(k, 1 + k % 2, head if k % 2 else None, [(near(tail), 40.0)] if k % 2 else [(near(head), 100.0), (near(lock), 500.0)]) for k in range(8)]
        (tmp_path / f"{sample}.mzML").write_text(mzml([x for x in scans if sample != "c" or x[1] == 1 or x[0] > 3]))
    scans, peaks = reader.scans_and_peaks(reader.read_raw(spark, str(tmp_path)))
    ppm = Tolerance("ppm", 6)
    groups = spark.createDataFrame([("a.mzML", "g"), ("b.mzML", "g"), ("c.mzML", "h")], "sample string, grp string")
    references = spark.createDataFrame([(lock,)], "target_mz double")
    o = importing.Options(ppm, ppm, repetition=0.6, repetition2=0.6, occupation=1.0, occupation2=1.0, threshold=50.0, calibration_ppm=20.0)
    t = importing.import_spectra(scans, peaks, o, references, groups)
    q = "QUERYNAME = Tail; DEFINE h = 'C[20..40] H[40..80] N1 O[1..3]' WITH CHG = +1; DEFINE t = 'C9 H17 O1' WITH CHG = +1; IDENTIFY h IN MS1+ AND t IN MS2+ REPORT F = h.chemsc; I = h.intensity; T = t.intensity;;"
    r = {r.F: r.asDict() for r in identify.run(lang.parse_query(q), t, None, ppm).collect()}["C30 H60 N1 O2"]
    assert all(abs(r[f"I:{s}.mzML"] - 100) < 1e-6 and abs(r[f"T:{s}.mzML"] - 40) < 1e-6 for s in "abc")
    # Without the references the drift of the samples keeps their masses apart.
    apart = importing.import_spectra(scans, peaks, o)
    assert apart.survey.count() == 0


def test_survey_passes_match_brute_force(spark):
    from massweave.operators import fold as operators

    rng = random.Random(7)
    data = [(f"s{rng.randrange(3)}", rng.uniform(100, 101), float(rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame(data, "sample string, mz double, i double").selectExpr("'A' AS flag", "*")
    tol = Tolerance("res", 20000)
    stats, long = operators.survey(df, tol, ["flag"], 3)
    want = fold([(m, i, s) for s, m, i in data], lambda m: m / 20000, 3, False)
    assert sorted((round(r.bin_first, 9), r.n_peaks, round(r.mean, 9)) for r in stats.collect()) == sorted((round(min(p[0] for p in g), 9), len(g), round(sum(p[0] for p in g) / len(g), 9)) for g in want)
    got = {(round(r.bin_first, 9), r.sample): r.i for r in long.collect()}
    expected = defaultdict(float)
    for g in want:
        for _, i, s in g:
            expected[(round(min(p[0] for p in g), 9), s)] += i
    assert got == dict(expected)


def test_collapse_over_a_table_matches_brute_force(spark):
    from massweave.operators import fold as operators

    rng = random.Random(3)
    data = sorted({round(rng.uniform(100, 130), 2): rng.sample("abcde", rng.randint(1, 2)) for _ in range(300)}.items())
    out = operators.collapse_clusters(spark.createDataFrame([("A", m, s) for m, s in data], "flag string, mz double, samples array<string>"), ["flag"], 0.15).collect()
    want, have, first, last = {}, set(), None, None
    for m, s in data:
        if last is not None and m - last <= 0.15 and not have & set(s):
            have |= set(s)
        else:
            have, first = set(s), m
        want[m], last = first, m
    assert {r.mz: r.merged for r in out} == want


def test_quadratic_fit_and_kmeans(spark):
    import numpy as np

    from massweave import catalog
    from massweave.operators import aggregates

    x = np.linspace(0.1, 1, 40)
    y = 3 - 2 * x + 0.5 * x * x + np.sin(50 * x) / 20
    r = aggregates.quadratic_fit(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), "x", "y").first()
    assert np.allclose([r.c2, r.c1, r.c0], np.polyfit(x, y, 2), atol=1e-6)
    d = "/root/testdata/sf0.001"
    counts = [r.n for r in catalog.queries()["a16_kmeans"](spark, d).collect()]
    assert 1 <= len(counts) <= 4 and sum(counts) == spark.read.parquet(f"{d}/embeddings.parquet").count()


def test_isotopes_are_subtracted_from_the_marks(spark):
    from massweave.operators import isotope

    formula = lambda c, h: chem.Formula(chem.parse_formula(f"C{c} H{h} N1 O2").n, 1)
    one, two, tail = formula(30, 60), formula(30, 62), chem.Formula(chem.parse_formula("C9 H17 O1").n, 1)
    p = isotope.pattern(one.counts).tolist()
    # The second entry is the first with two more hydrogens; its mass is within 0.02 Da of the first one's M+2.
    survey = spark.createDataFrame([(1, one.mass(), 1), (2, two.mass(), 1)], "se_id long, mz double, polarity int")
    long = spark.createDataFrame([(1, "a", 1000.0), (2, "a", 1000.0 * p[2] + 40.0), (1, "b", 1000.0), (2, "b", 1000.0 * p[2] / 2)], "se_id long, sample string, i double")
    m = isotope.overlap_matrix(isotope.pattern(tail.counts), isotope.pattern((one - tail).counts))
    frag = spark.createDataFrame([(7, tail.mass(), 1), (8, tail.mass(), 1)], "fr_id long, mz double, polarity int")
    frag_long = spark.createDataFrame([(7, "a", 500.0), (8, "a", 500.0 * float(m[2, 0]) + 9.0)], "fr_id long, sample string, i double")
    bridge = spark.createDataFrame([(1, 7), (2, 8)], "se_id long, fr_id long")
    t = identify.Tables(survey, long, frag, frag_long, bridge)
    q = lang.parse_query("QUERYNAME = Q; DEFINE h = 'C30 H[60..62] N1 O2' WITH CHG = +1; DEFINE t = 'C9 H17 O1' WITH CHG = +1; IDENTIFY h IN MS1+ AND t IN MS2+ REPORT F = h.chemsc; I = h.intensity; T = t.intensity;;")
    run = lambda flag: {r.F: r.asDict() for r in identify.run(q, t, None, Tolerance("da", 0.02), isotopes=flag).collect()}
    raw, done = run(False)["C30 H62 N1 O2"], run(True)
    assert raw["I:a"] > 50 and raw["T:a"] > 10
    r = done["C30 H62 N1 O2"]
    assert abs(r["I:a"] - 40) < 1e-6 and r["I:b"] == 0 and abs(r["T:a"] - 9) < 1e-6
    assert done["C30 H60 N1 O2"]["I:a"] == 1000 and done["C30 H60 N1 O2"]["T:a"] == 500
