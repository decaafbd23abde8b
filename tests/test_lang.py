import pytest

from massweave import chem
from massweave.chem import Tolerance
from massweave.plans import identify, lang
from massweave.scratch import materialise

#: A diamide of two acids: two acid tails on the second level, one doubly charged head on the first.
DIAMIDE = """
QUERYNAME = Diamides;  # comment
DEFINE whole = 'C[20..40] H[20..80] N[2] O[2..4]' WITH DBR = (2, 9), CHG = +2;
DEFINE left = 'C[6..18] H[8..36] O[1..2]' WITH CHG = -1;
DEFINE right = 'C[6..18] H[8..36] O[1..2]' WITH CHG = -1;
IDENTIFY whole IN MS1+ AND left in MS2- AND right IN MS2-
SUCHTHAT whole.chemsc[C] == left.chemsc[C] + right.chemsc[C] + 2 AND avg(left.intensity) < 7
REPORT TAILS = "%d+%d" % "(left.chemsc[C], right.chemsc[C])"; OFF = "%.2f" % "(whole.errppm)"; INV = whole.errres; N = nbsmpls();
  SEEN = left.occ; MEAN = avg(left.intensity); UP = medianU(left.intensity); LOW = medianL(left.intensity); ALSO = left.isobaric; A = left.intensity;;
"""


def mz(text, charge):
    return chem.Formula(chem.parse_formula(text).n, charge).mass()


def tables(spark, by_scan=False):
    mk = spark.createDataFrame
    whole, c10, c12 = mz("C24 H44 N2 O3", 2), mz("C10 H19 O2", -1), mz("C12 H23 O2", -1)
    survey = [(1, whole * (1 + 2e-6), 1), (2, mz("C26 H48 N2 O3", 2), 1), (3, 900.0, 1)]
    frag = [(11, c10, -1), (12, c12, -1), (13, c12 + 0.4, -1)]
    pairs = [(1, 11), (1, 12), (2, 13)]
    return identify.Tables(
        mk(survey, "se_id long, mz double, polarity int"),
        mk([(1, "a", 100.0), (1, "b", 50.0), (2, "a", 9.0), (3, "c", 10.0)], "se_id long, sample string, i double"),
        mk(frag, "fr_id long, mz double, polarity int"),
        mk([(11, "a", 18.0), (12, "a", 4.0), (12, "b", 8.0), (13, "b", 5.0)], "fr_id long, sample string, i double"),
        None if by_scan else mk(pairs, "se_id long, fr_id long"),
        1000.0,
        mk([(s, s) for s, _ in pairs], "se_id long, scan_id long") if by_scan else None,
        mk([(f, s) for s, f in pairs], "fr_id long, scan_id long") if by_scan else None,
    )


def report(spark, text, **more):
    return identify.run(lang.parse_query(text), tables(spark), None, Tolerance("ppm", 5), **more).collect()


@pytest.mark.parametrize("by_scan", [False, True])
def test_absent_samples_count_as_zero(spark, by_scan):
    out = identify.run(lang.parse_query(DIAMIDE), tables(spark, by_scan), None, Tolerance("ppm", 5)).collect()
    got = {r.TAILS: r.asDict() for r in out}
    assert set(got) == {"10+12", "12+10"} and all(r["se_id"] == 1 and r["N"] == 3 for r in got.values())
    r = got["10+12"]
    assert (r["MEAN"], r["UP"], r["LOW"], r["A:a"], r["A:b"], r["A:c"], r["ALSO"]) == (6.0, 0.0, 0.0, 18.0, 0.0, 0.0, "right")
    assert abs(r["SEEN"] - 1 / 3) < 1e-9 and got["12+10"]["UP"] == 4.0
    # Two charges double the error; its inverse is the resolution error.
    assert r["OFF"] == "4.00" and abs(r["INV"] - 250000) < 10


def test_permutations_keep_the_best(spark):
    out = report(spark, DIAMIDE, permutations=False)
    assert len(out) == 1


@pytest.mark.parametrize(("option", "n"), [("MINOCC = 0.6", 1), ("MAXOCC = 0.5", 1), ("MINOCC = 0.9", 0), ("MASSRANGE = (100, 180)", 1), ("MASSRANGE = (10, 20)", 0), ("TOLERANCE = 0.001 PPM", 2)])
def test_options_of_a_variable(spark, option, n):
    assert len(report(spark, DIAMIDE.replace("O[1..2]' WITH CHG = -1;\nDEFINE right", f"O[1..2]' WITH CHG = -1, {option};\nDEFINE right"))) == n


def test_exact_hit_has_the_largest_resolution_error(spark):
    q = "QUERYNAME = One; DEFINE x = 'C26 H48 N2 O3' WITH CHG = +2; IDENTIFY x IN MS1+ REPORT R = x.errres; D = x.errda;;"
    assert [(r.se_id, r.R, r.D) for r in report(spark, q)] == [(2, 1e6, 0.0)]


def test_conditions_over_all_samples(spark):
    every = DIAMIDE.replace("avg(left.intensity) < 7", "whole.intensity > 10")
    assert report(spark, every) == []  # sample c lacks the entry
    assert len(report(spark, every.replace("whole.intensity > 10", "whole.intensity >= 0"))) == 2


def test_formula_conditions(spark):
    more = lambda c: report(spark, DIAMIDE.replace("avg(left.intensity) < 7", c))
    assert len(more("left.chemsc + right.chemsc + 'C2 H2 N2' <~ 'C[20..30] H[30..60] N2 O[1..9]'")) == 2
    assert len(more("isOdd(whole.chemsc[C])")) == 0
    assert len(more("NOT isOdd(whole.chemsc[C]) AND (left.chemsc[C] < right.chemsc[C] OR 1 == 2)")) == 1


def test_complement_bounds_and_tags(spark):
    t, q = tables(spark), lang.parse_query(DIAMIDE)
    left = {r.se_id for r in identify.complement(t, [identify.run(q, t, None, Tolerance("ppm", 5))]).collect()}
    assert left == {2, 3}
    b = identify.mass_bounds(spark, q)
    assert b[1][0] < mz("C24 H44 N2 O3", 2) < b[1][1] and b[2][0] < 200 < b[2][1]
    one = spark.createDataFrame([(1, "C2"), (1, "C3")], "se_id long, chemsc string")
    tags = {(r.se_id, r.chemsc): r.tags for r in identify.with_tags({"b": one, "a": one.limit(1)}).collect()}
    assert sorted(tags.values()) == ["a,b", "b"]


SIGNS = {
    "a IN MS2- AND b IN MS2-": lambda a, b: a and b,
    "a IN MS2- OR b IN MS2-": lambda a, b: a or b,
    "a IN MS2- => b IN MS2-": lambda a, b: a or b,
    "a IN MS2- <= b IN MS2-": lambda a, b: a or b,
    "a IN MS2- <=> b IN MS2-": lambda a, b: a and b,
    "a IN MS2- -> b IN MS2-": lambda a, b: a,
    "a IN MS2- <- b IN MS2-": lambda a, b: b,
    "a IN MS2- AND NOT b IN MS2-": lambda a, b: a and not b,
    "NOT (a IN MS2- OR b IN MS2-)": lambda a, b: not (a or b),
    "NOT a IN MS2- OR NOT b IN MS2-": lambda a, b: not a or not b,
}


def marked_tables(spark):
    """Entry 0 has neither fragment, 1 has a, 2 has b, 3 both with two peaks of a; entry 4 is not of the precursor."""
    mk = spark.createDataFrame
    whole, a, b = mz("C24 H44 N2 O3", 2), mz("C10 H19 O2", -1), mz("C12 H23 O2", -1)
    frag = [(1, a, -1), (2, a * (1 + 2e-6), -1), (3, b, -1)]
    pairs = [(1, 1), (2, 3), (3, 1), (3, 2), (3, 3), (4, 1), (4, 3)]
    return identify.Tables(
        mk([(k, 900.0 if k == 4 else whole, 1) for k in range(5)], "se_id long, mz double, polarity int"),
        mk([(k, "s", 10.0 + k) for k in range(5)], "se_id long, sample string, i double"),
        mk(frag, "fr_id long, mz double, polarity int"),
        mk([(k, "s", 1.0 * k) for k, _, _ in frag], "fr_id long, sample string, i double"),
        mk(pairs, "se_id long, fr_id long"),
        1000.0,
    )


MARKED = """QUERYNAME = Marked; DEFINE p = 'C24 H44 N2 O3' WITH CHG = +2; DEFINE a = 'C10 H19 O2' WITH CHG = -1; DEFINE b = 'C12 H23 O2' WITH CHG = -1;
IDENTIFY p IN MS1+ AND ({}) {} REPORT A = a.chemsc; I = a.intensity; E = b.errda; T = "%d" % "(b.chemsc[C])"; L = b.nlsc; N = nbsmpls();;"""


HITS = {0: ([], []), 1: ([1], []), 2: ([], [3]), 3: ([1, 2], [3])}


def combined(sign):
    return [(k, x, y) for k, (a, b) in HITS.items() if SIGNS[sign](bool(a), bool(b)) for x in a or [None] for y in b or [None]]


@pytest.mark.parametrize("sign", SIGNS)
def test_signs_of_the_mark_algebra(spark, sign):
    hit = lambda n, rows: spark.createDataFrame([(k, (x,)) for k, x in rows], f"se_id int, {n} struct<i:int>")
    marked = {"p": hit("p", [(k, 0) for k in HITS]), "a": hit("a", [(k, x) for k, h in HITS.items() for x in h[0]]), "b": hit("b", [(k, x) for k, h in HITS.items() for x in h[1]])}
    rows = identify.bindings(lang.parse_query(MARKED.format(sign, "SUCHTHAT p.mass > 0")), marked).collect()
    key = lambda r: (r[0], r[1] or 0, r[2] or 0)
    assert sorted(((r.se_id, r.a and r.a.i, r.b and r.b.i) for r in rows), key=key) == sorted(combined(sign), key=key)
    # Without SUCHTHAT bindings are complete.
    rows = identify.bindings(lang.parse_query(MARKED.format(sign, "")), marked).collect()
    assert sorted((r.se_id, r.a.i, r.b.i) for r in rows) == [(k, x, y) for k, x, y in combined(sign) if x and y and SIGNS[sign](True, True)]


def test_conditions_and_reports_over_absent_marks(spark):
    either = "NOT a IN MS2- OR a IN MS2-"
    every = [(k, x, y) for k, (a, b) in HITS.items() for x in a or [None] for y in b or [None]]
    t, tol = marked_tables(spark), Tolerance("ppm", 5)
    q = lang.parse_query(MARKED.format(either + " OR b IN MS2-", "SUCHTHAT p.mass > 0"))
    got = sorted((r.se_id, r.A, r["I:s"], r.E is None, r["T"], r.L, r.N) for r in identify.run(q, t, None, tol).collect())
    row = lambda k, x, y: (k, "C10 H19 O2" if x else "", float(x or 0), y is None, "12" if y else "", "C12 H21 N2 O1" if y else "", 1.0)
    assert got == sorted(row(*x) for x in every)
    # A comparison with an absent mark does not hold, its negation does; maps, differences and calls too.
    b = materialise(identify.bindings(q, identify.marks(q, t, tol, tol)), "bindings")
    for such, keep in [
        ("a.intensity >= 0", lambda x, y: x),
        ("NOT a.intensity >= 0", lambda x, y: not x),
        ("a.mass <> 5", lambda x, y: x),
        ("b.nlsc[C] >= 0", lambda x, y: y),
        ("isEven(b.chemsc[C]) OR a.chemsc == 'C10 H19 O2'", lambda x, y: x or y),
        ("avg(a.intensity) < avg(b.intensity)", lambda x, y: x and y and x < y),
    ]:
        q = lang.parse_query(MARKED.format(either + " OR b IN MS2-", "SUCHTHAT " + such))
        left = b.where(identify.Compiler(q).cond(q.suchthat)).select("se_id", "a.fr_id", "b.fr_id").collect()
        assert sorted((r[0], r[1] or 0, r[2] or 0) for r in left) == sorted((k, x or 0, y or 0) for k, x, y in every if keep(x, y)), such


def test_one_variable_in_two_scopes(spark):
    q = "QUERYNAME = Two; DEFINE p = 'C[23..24] H[42..44] N2 O3' WITH CHG = +2; DEFINE a = 'C10 H19 O2' WITH CHG = -1; IDENTIFY p IN MS1+ AND (a IN MS2- OR a IN MS1-) SUCHTHAT p.mass > 0 REPORT M = a.mass; I = a.intensity;;"
    t = marked_tables(spark)
    assert len(lang.parse_query(q).scopes["a"]) == 2
    # The same variable also marks entries of the other polarity, which then have no p.
    t.survey = t.survey.unionByName(spark.createDataFrame([(9, mz("C10 H19 O2", -1), -1)], t.survey.schema))
    t.survey_long = t.survey_long.unionByName(spark.createDataFrame([(9, "s", 7.0)], t.survey_long.schema))
    either = q.replace("AND (a IN MS2- OR a IN MS1-) SUCHTHAT p.mass > 0", "OR a IN MS2- OR a IN MS1- SUCHTHAT a.mass > 0")
    assert lang.parse_query(either).scopes["a"] == [(2, -1), (1, -1)]
    for isotopes in (False, True):
        got = sorted((r.se_id, r["I:s"]) for r in identify.run(lang.parse_query(either), t, None, Tolerance("ppm", 5), isotopes=isotopes).collect())
        assert [k for k, _ in got] == [1, 3, 3, 9]
        assert isotopes or [i for _, i in got] == [1.0, 1.0, 2.0, 7.0]


@pytest.mark.parametrize("bad", ["QUERYNAME = a_b;", DIAMIDE.replace("AND right IN MS2-", ""), DIAMIDE.replace("REPORT", "REPORT X = ;"), DIAMIDE.replace("'C[6..18] H[8..36] O[1..2]'", "'C[6..18] H[8'")])
def test_errors(bad):
    with pytest.raises(ValueError):
        lang.parse_query(bad)
