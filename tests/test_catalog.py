import duckdb
import pytest

D = "/root/testdata/sf0.001"
NAMES = ["f09_occupation", "m02_long_tails", "f13_glob", "f16_map_against_map", "j01_interval", "j02_nearest", "j07_association", "j15_ladder", "j17_nearest_any", "m09_lattice", "a01_greedy_members", "a05_survey", "a19_chained_clusters", "j16_trigger_peak", "a32_resolution", "i14_recalibrate", "x07_sum_intensity", "x13_format", "x02_formula_arithmetic", "x03_weight_dbr", "s16_target_list", "i06_monoisotopic", "a30_pivot", "j18_sibling", "j19_charge", "k06_mztab", "m02_identify", "m03_either_mark", "m03_absent_mark", "m08_tags", "st_event_windows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    import __spark_entry__ as e

    df, rel = e.queries()[name](spark, D), con.sql(e.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in rel.fetchall())


def test_isotope_patterns_equal_whole_polynomials(spark):
    """i01 against products of all terms, for every part."""
    import numpy as np

    import __spark_entry__ as e

    from massweave.operators.isotope import ABUNDANCE

    def power(p, n):
        out = np.ones(1)
        for _ in range(n):
            out = np.convolve(out, p)
        return out

    got = {r.p_partkey: [r[f"p{k}"] for k in range(5)] for r in e.queries()["i01_isotope_patterns"](spark, D).collect()}
    parts = spark.read.parquet(f"{D}/part.parquet").select("p_partkey", "p_size").collect()
    assert len(got) == len(parts)
    for r in parts:
        c = 20 + r.p_size
        p = np.convolve(np.convolve(power(ABUNDANCE["C"], c), power(ABUNDANCE["H"], 2 * c + 1 - 2 * (r.p_partkey % 6))), power(ABUNDANCE["O"], 2))
        assert np.allclose(got[r.p_partkey], p[:5] / p[0], atol=1e-5)


def test_isotope_correction_covers_all_rows(spark):
    """i03 has a value for every entry and sample."""
    import __spark_entry__ as e

    from massweave import views

    want = {(round(r.mz * 10) * r.polarity, r.sample) for r in views.peaks(spark, D).selectExpr("polarity", "sample", "round(mz, 1) AS mz").distinct().collect()}
    assert {(r.se_id, r.sample) for r in e.queries()["i03_isotope_correction"](spark, D).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_formula_queries_expand_a_constraint(spark):
    """x02, x03, x13, s16: every formula of the constraint of each part, the smallest table included."""
    import __spark_entry__ as e

    q = e.queries()
    formulas = {r.chemsc for r in q["s16_target_list"](spark, D).collect()}
    old = {f"C{c} H{h} O2" for c in range(30, 61) for h in range(30, 121) if 0.5 <= (2 + 2 * c - h) / 2 <= 12.5 and int(12 * c + 1.0078250321 * h + 2 * 15.9949146221) % 2}
    assert len(old - formulas) <= len(old) // 20 and len(formulas) > len(old)
    n = q["s16_target_list"](spark, D).count()
    assert n > 4000 and all(q[x](spark, D).count() == n for x in ("x02_formula_arithmetic", "x03_weight_dbr", "x13_format"))
