import pytest

from massweave import chem

# m/z, composition, error in ppm, carbons and double bonds of known assignments.
GOLDEN = [
    (614.5880457819642, "C41 H76 O2 N1", "1.61", 14, 0),
    (642.619326247301, "C43 H80 O2 N1", "1.51", 16, 0),
    (666.6191890107873, "C45 H80 O2 N1", "1.25", 18, 2),
    (674.5847600354955, "C46 H76 O2 N1", "-3.40", 19, 5),
    (716.6347799842056, "C49 H82 O2 N1", "1.08", 22, 5),
]


@pytest.mark.parametrize(("mz", "text", "ppm", "carbons", "double"), GOLDEN)
def test_known_assignments(mz, text, ppm, carbons, double):
    f = chem.Formula(chem.parse_formula(text).n, 1)
    assert "%.2f" % ((mz - f.mass()) / mz * 1e6) == ppm
    assert (f.counts["C"] - 27, f.double_bonds() - 4.5) == (carbons, double)


def test_parse_ranges_and_options():
    c = chem.parse("C[30..32] H[2,4] O8 Na db(1,8) chg(-1)")
    assert dict(c.allowed) == {"C": (30, 31, 32), "H": (2, 4), "O": (8,), "Na": (1,)}
    assert c.dbr == (1.0, 8.0) and c.charge == -1
    assert c.covers(chem.parse_formula("C30 H4 O8 Na1")) and not c.covers(chem.parse_formula("C30 H3 O8 Na1"))
    with pytest.raises(ValueError):
        chem.parse("Q3")


def test_arithmetic_drops_negative():
    a, b = chem.parse_formula("C5 H2"), chem.parse_formula("C2 H4 O1")
    assert (a - b).counts == {"C": 3} and (a + b).counts == {"C": 7, "H": 6, "O": 1}
    assert a.scaled(2).counts == {"C": 10, "H": 4}


def test_lattice(spark):
    c = chem.Constraint(chem.parse("C[41..49] H[30..200] O2 N1").allowed, (4.5, 10.5), 1)
    assert chem.lattice(spark, c, parity=False).count() == 117
    rows = {r.chemsc for r in chem.lattice(spark, c).select("chemsc").collect()}
    assert "C45 H80 N1 O2" in rows or "C45 H80 O2 N1" in rows
