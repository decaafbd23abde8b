"""Queries over the driver's tables, one for each operator, with their DuckDB SQL.

Keys begin with the operator's id.  Queries without SQL are checked by tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chem, views
from .chem import Constraint, Tolerance
from .functions import scalar as X
from .operators import aggregates as A
from .operators import filters as O
from .operators import fold, intervals, isotope
from .plans import identify, importing, lang
from .sources import sinks, spectra
from .streaming import averages
from .views import LARGEST, MAPS_SQL, SQL

Fn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Fn] = {}
_SQL: dict[str, str] = {}
W = f"WITH {SQL} "
M = f"WITH {MAPS_SQL} "
PPM = Tolerance("ppm", 20)


def query(name: str, sql: str | None = None) -> Callable[[Fn], Fn]:
    def add(f: Fn) -> Fn:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def rd(c, n: int = 4):
    return F.round(c, n)


def mono(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet")


# --- filters -----------------------------------------------------------------

query("f01_time_range", W + "SELECT scan_id, time FROM scans WHERE time * 60 BETWEEN 300 AND 600")(lambda s, d: O.time_range(views.scans(s, d), 300, 600).select("scan_id", "time"))
query("f02_polarity", W + "SELECT scan_id FROM scans WHERE polarity = -1")(lambda s, d: O.polarity(views.scans(s, d), -1).select("scan_id"))
query("f02_one_polarity", W + "SELECT flag, max(polarity)::INT AS polarity FROM peaks GROUP BY flag")(lambda s, d: O.assert_one_polarity(views.peaks(s, d), ["flag"]))
query("f03_ms_level", W + "SELECT scan_id FROM scans WHERE ms_level = 2")(lambda s, d: O.ms_level(views.scans(s, d), 2).select("scan_id"))
query("f04_mass_range", W + "SELECT peak_id, mz FROM peaks WHERE mz BETWEEN 400 AND 410.5")(lambda s, d: O.mass_range(views.peaks(s, d), 400, 410.5).select("peak_id", "mz"))
query("f05_relative_intensity", W + "SELECT peak_id, round(i / max(i) OVER (PARTITION BY scan_id), 6) AS rel_i FROM peaks")(lambda s, d: O.relative_intensity(views.peaks(s, d), ["scan_id"]).select("peak_id", rd("rel_i", 6).alias("rel_i")))
query("f06_min_intensity", W + "SELECT peak_id FROM peaks WHERE i > 45")(lambda s, d: O.min_intensity(views.peaks(s, d), 45).select("peak_id"))
query("f07_round_mz", W + "SELECT round_even(mz, 1) AS mz, count(*) AS n FROM peaks GROUP BY 1")(lambda s, d: O.round_mz(views.peaks(s, d), 1).groupBy("mz").agg(F.count("*").alias("n")))
query("f08_scan_threshold", W + "SELECT peak_id FROM peaks WHERE i >= 60 / sqrt(n_scans)")(lambda s, d: O.scan_threshold(views.peaks(s, d), 60.0).select("peak_id"))

_OCC = """, long AS (SELECT l_partkey AS se_id, concat('s', l_suppkey % 4) AS sample, concat('g', l_suppkey % 2) AS grp, sum(l_quantity) AS i, max(l_linenumber) AS n_scans FROM lineitem GROUP BY ALL),
grps AS (SELECT grp, count(DISTINCT sample) AS n FROM long GROUP BY grp),
occs AS (SELECT se_id, grp, sum(CASE WHEN i > 100 / sqrt(n_scans) THEN 1 ELSE 0 END) / n AS occ FROM long JOIN grps USING (grp) GROUP BY se_id, grp, n)"""


def occupied(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = mono(s, d).groupBy(F.col("l_partkey").alias("se_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("sample"), F.concat(F.lit("g"), F.col("l_suppkey") % 2).alias("grp"))
    long = t.agg(F.sum("l_quantity").alias("i"), F.max("l_linenumber").alias("n_scans"))
    return long, long.groupBy("grp").agg(F.countDistinct("sample").alias("n"))


query("f09_occupation", W + _OCC + " SELECT se_id, max(occ) AS occ FROM occs GROUP BY se_id HAVING max(occ) >= 0.5")(lambda s, d: O.occupation(occupied(s, d)[0], ["se_id"], 100, 0.5, occupied(s, d)[1]))
query("f10_occupation_value", W + _OCC + " SELECT se_id, grp, occ FROM occs")(lambda s, d: O.occupation_value(occupied(s, d)[0], ["se_id"], 100, occupied(s, d)[1]))


@query("f11_occupation_percent", W + _OCC + """, base AS (SELECT sample, max(i) AS base_peak FROM long GROUP BY sample),
o AS (SELECT se_id, grp, sum(CASE WHEN i * 100 > 20 * base_peak THEN 1 ELSE 0 END) / n AS occ FROM long JOIN grps USING (grp) JOIN base USING (sample) GROUP BY se_id, grp, n)
SELECT se_id, max(occ) AS occ FROM o GROUP BY se_id HAVING max(occ) >= 0.5""")
def _f11(s, d):
    long, n = occupied(s, d)
    base = long.groupBy("sample").agg(F.max("i").alias("base_peak"))
    return O.occupation_percent(long.join(base, "sample"), ["se_id"], 20, 0.5, n)


query("f12_scan_repetition", W + "SELECT floor(mz)::BIGINT AS bin, count(*) AS n_peaks FROM peaks GROUP BY 1 HAVING count(*) / 100.0 >= 0.6")(
    lambda s, d: O.scan_repetition(views.peaks(s, d).withColumn("bin", F.floor("mz")), ["bin"], F.lit(100.0), 0.6)
)
query("f13_glob", M + "SELECT part, sum(i) AS total FROM long WHERE sample GLOB 's[13]' GROUP BY part")(
    lambda s, d: views.sample_maps(s, d).select("part", O.select_glob(F.col("m"), "s[13]").alias("m")).where(F.size("m") > 0).select("part", F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v).alias("total"))
)
query("f14_regex", M + "SELECT part, sum(i) AS total FROM long WHERE regexp_matches(sample, '^(?:s0|s2)') GROUP BY part")(
    lambda s, d: views.sample_maps(s, d).select("part", O.select_regex(F.col("m"), "s0|s2").alias("m")).where(F.size("m") > 0).select("part", F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v).alias("total"))
)
query("f15_boolean_algebra", W + "SELECT peak_id FROM peaks WHERE (mz > 500 AND NOT i > 25) OR (polarity = -1 AND mz < 20)")(
    lambda s, d: views.peaks(s, d).where(((F.col("mz") > 500) & ~(F.col("i") > 25)) | ((F.col("polarity") == -1) & (F.col("mz") < 20))).select("peak_id")
)
query("f16_all_samples", M + "SELECT part FROM long GROUP BY part HAVING min(i) > 150")(lambda s, d: views.sample_maps(s, d).where(O.all_of(F.col("m"), ">", 150)).select("part"))
query("f16_map_against_map", M + "SELECT a.part FROM long a LEFT JOIN (SELECT part - 1 AS part, sample, i AS j FROM long) b USING (part, sample) WHERE a.part IN (SELECT part - 1 FROM long) GROUP BY a.part HAVING bool_and(coalesce(a.i > b.j, false))")(
    lambda s, d: (lambda m: m.join(m.select((F.col("part") - 1).alias("part"), F.col("m").alias("b")), "part").where(O.both_of(F.col("m"), F.col("b"), ">")).select("part"))(views.sample_maps(s, d))
)
query("f17_containment", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey % 5 IN (1, 3)")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").where(O.contained({"C": F.col("p_size"), "H": (F.col("p_partkey") % 5).cast("int")}, {"C": tuple(range(10, 21)), "H": (1, 3)})).select("p_partkey")
)
query("f18_dbr", "SELECT p_partkey, (2 + 2 * p_size - (p_partkey % 7)) / 2 AS dbr FROM part WHERE (2 + 2 * p_size - (p_partkey % 7)) / 2 BETWEEN 4.5 AND 10.5")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", chem.dbr_column({"C": F.col("p_size"), "H": F.col("p_partkey") % 7}).alias("dbr")).where(F.col("dbr").between(4.5, 10.5))
)
query("f19_predicate_text", W + "SELECT peak_id FROM peaks WHERE mz > 900 AND i < 5")(lambda s, d: views.peaks(s, d).where("mz > 900 and i < 5").select("peak_id"))
query("f21_blank", W + ", p AS (SELECT floor(mz * 10)::BIGINT AS mz, sample, sum(i) AS i FROM peaks GROUP BY ALL), b AS (SELECT sample FROM p GROUP BY sample ORDER BY sum(i), sample LIMIT 1) SELECT mz, sample, i FROM p WHERE mz NOT IN (SELECT mz FROM p WHERE sample = (SELECT sample FROM b) AND i > 0)")(
    lambda s, d: O.blank_suppressed(views.peaks(s, d).groupBy(F.floor(F.col("mz") * 10).alias("mz"), "sample").agg(F.sum("i").alias("i"))).select("mz", "sample", "i")
)
query("f22_mutual_mask", "SELECT p_partkey, CASE WHEN a <= 0 OR b <= 0 THEN 0.0 ELSE a END AS a, CASE WHEN a <= 0 OR b <= 0 THEN 0.0 ELSE b END AS b FROM (SELECT p_partkey, (p_size % 3)::DOUBLE AS a, (p_partkey % 4)::DOUBLE AS b FROM part)")(
    lambda s, d: O.mutual_mask(s.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") % 3).cast("double").alias("a"), (F.col("p_partkey") % 4).cast("double").alias("b")), "a", "b")
)
query("f23_map_item", M + "SELECT part, coalesce(max(CASE WHEN sample = 's1' THEN i END), 0) AS s1 FROM long GROUP BY part")(lambda s, d: views.sample_maps(s, d).select("part", F.coalesce(F.try_element_at("m", F.lit("s1")), F.lit(0.0)).alias("s1")))

# --- joins -------------------------------------------------------------------

query("j01_interval", W + "SELECT peak_id, target_id FROM peaks JOIN targets ON abs(mz - target_mz) <= mz * 20 / 1e6")(lambda s, d: intervals.interval_pairs(views.peaks(s, d), views.targets(s, d), PPM, LARGEST, "peak_id", "target_id"))
query("j02_nearest", W + ", h AS (SELECT peak_id, target_mz, row_number() OVER (PARTITION BY peak_id ORDER BY abs(mz - target_mz), target_mz) AS r FROM peaks JOIN (SELECT DISTINCT target_mz FROM targets) t ON abs(mz - target_mz) <= 0.03) SELECT peak_id, target_mz FROM h WHERE r = 1")(
    lambda s, d: intervals.nearest_join(views.peaks(s, d), views.targets(s, d).select("target_mz").distinct(), Tolerance("da", 0.03), LARGEST, "peak_id").select("peak_id", "target_mz")
)
_LAT = """, lat AS (SELECT c, h, 12.0 * c + 1.0078250321 * h + 2 * 15.9949146221 AS mz0, (2.0 + 2 * c - h) / 2 AS dbr FROM range(30, 61) a(c), range(30, 121) b(h)),
ok AS (SELECT *, mz0 - 0.00055 AS mz1 FROM lat WHERE dbr BETWEEN 0.5 AND 12.5 AND floor(mz0)::BIGINT % 2 = 1)"""
_CONS = chem.parse("C[30..60] H[30..120] O2")


def _lattice(s: SparkSession) -> DataFrame:
    return chem.lattice(s, Constraint(_CONS.allowed, (0.5, 12.5), 1))


#: Compositions of parts, one for each row.
_COMP = """WITH comp AS (SELECT p_partkey, 20 + p_size AS c, 2 * (20 + p_size) + 1 - 2 * (p_partkey % 6) AS h FROM part),
full_comp AS (SELECT *, 'C' || c || ' H' || h || ' O2' AS chemsc, (12.0 * c + 1.0078250321 * h + 2 * 15.9949146221)::DOUBLE AS mz0, ((2.0 + 2 * c - h) / 2)::DOUBLE AS dbr FROM comp)"""


def _compositions(s: SparkSession, d: str) -> DataFrame:
    """p_partkey, C, H, O of each part, with chemsc, mass, m/z and double bonds."""
    c = F.col("p_size") + 20
    t = s.read.parquet(f"{d}/part.parquet").select("p_partkey", c.cast("int").alias("C"), (2 * c + 1 - 2 * (F.col("p_partkey") % 6)).cast("int").alias("H"), F.lit(2).alias("O"))
    n = {e: F.col(e) for e in "CHO"}
    return t.withColumns({"chemsc": chem.text_column(n), "mass": chem.mass_column(n, 0), "mz": chem.mass_column(n, 1), "dbr": chem.dbr_column(n)})


query("m09_lattice", _COMP + """, lat AS (SELECT p_partkey, c + a AS c, h + b AS h FROM comp, range(0, 3) x(a), range(0, 5) y(b)),
f AS (SELECT *, (12.0 * c + 1.0078250321 * h + 2 * 15.9949146221)::DOUBLE AS mz0, ((2.0 + 2 * c - h) / 2)::DOUBLE AS dbr FROM lat)
SELECT p_partkey, 'C' || c || ' H' || h || ' O2' AS chemsc, round(mz0 - 0.00055, 6) AS mz, dbr FROM f WHERE dbr BETWEEN 0.5 AND 12.5 AND (floor(mz0)::BIGINT % 2 = 1 OR h > 127)""")(
    lambda s, d: chem.lattice_of(_compositions(s, d).select("p_partkey", F.col("C").alias("_c"), F.col("H").alias("_h")), {"C": (F.col("_c"), F.col("_c") + 2), "H": (F.col("_h"), F.col("_h") + 4), "O": (F.lit(2), F.lit(2))}, 1, (0.5, 12.5)).select("p_partkey", "chemsc", rd("mz", 6).alias("mz"), "dbr")
)
#: The formulas of a constraint around the composition of each part.
_FORMULAS = _COMP + """, lat AS (SELECT p_partkey, c + a AS c, h + b AS h FROM comp, range(0, 3) x(a), range(-14, 5) y(b)),
f AS (SELECT *, 'C' || c || ' H' || h || ' O2' AS chemsc, (12.0 * c + 1.0078250321 * h + 2 * 15.9949146221)::DOUBLE AS mz0, ((2.0 + 2 * c - h) / 2)::DOUBLE AS dbr FROM lat),
ok AS (SELECT * FROM f WHERE dbr BETWEEN 0.5 AND 12.5 AND (floor(mz0)::BIGINT % 2 = 1 OR h > 127))"""


def _formulas(s: SparkSession, d: str) -> DataFrame:
    """p_partkey, C, H, O, chemsc, mass, m/z and double bonds of every formula of the constraint of each part."""
    c = _compositions(s, d).select("p_partkey", F.col("C").alias("_c"), F.col("H").alias("_h"))
    ranges = {"C": (F.col("_c"), F.col("_c") + 2), "H": (F.col("_h") - 14, F.col("_h") + 4), "O": (F.lit(2), F.lit(2))}
    return chem.lattice_of(c, ranges, 1, (0.5, 12.5)).withColumn("mass", chem.mass_column({e: F.col(e) for e in "CHO"}, 0))


query("j03_formula_interval", W + _LAT + " SELECT peak_id, 'C' || c || ' H' || h || ' O2' AS chemsc FROM peaks p JOIN ok ON abs(p.mz - mz1) <= p.mz * 20 / 1e6")(
    lambda s, d: intervals.interval_join(views.peaks(s, d), _lattice(s).select("chemsc", F.col("mz").alias("target_mz")), PPM, LARGEST).select("peak_id", "chemsc")
)


@query("j04_formula_list", W + ", f(chemsc, target_mz) AS (VALUES ('C45 H80 N1 O2', 12.0*45+1.0078250321*80+2*15.9949146221+14.0030740052-0.00055), ('C27 H45', 12.0*27+1.0078250321*45-0.00055)) SELECT peak_id, chemsc FROM peaks JOIN f ON abs(mz - target_mz) <= 0.05")
def _j04(s, d):
    fs = [chem.parse_formula(t) for t in ("C45 H80 O2 N1", "C27 H45")]
    rows = s.createDataFrame([(f.text(), chem.Formula(f.n, 1).mass()) for f in fs], "chemsc string, target_mz double")
    return intervals.interval_join(views.peaks(s, d), rows, Tolerance("da", 0.05), LARGEST).select("peak_id", "chemsc")


query("j05_neutral_loss", W + "SELECT peak_id, target_id FROM (SELECT peak_id, p.mz, s.target_mz - p.mz AS nl FROM peaks p JOIN scans s USING (scan_id) WHERE p.ms_level = 2) x JOIN targets ON abs(nl - targets.target_mz) <= mz * 200 / 1e6")(
    lambda s, d: intervals.neutral_loss_join(views.peaks(s, d).where("ms_level = 2").join(views.scans(s, d).select("scan_id", F.col("target_mz").alias("prec_mz")), "scan_id"), views.targets(s, d), Tolerance("ppm", 200), LARGEST).select("peak_id", "target_id")
)
query("j06_gate", W + "SELECT peak_id FROM peaks WHERE ms_level = 2 AND scan_id IN (SELECT scan_id FROM peaks WHERE ms_level = 1 AND mz BETWEEN 300 AND 301)")(
    lambda s, d: views.peaks(s, d).where("ms_level = 2").join(views.peaks(s, d).where("ms_level = 1 and mz between 300 and 301").select("scan_id").distinct(), "scan_id", "left_semi").select("peak_id")
)
query("j07_association", W + ", c AS (SELECT DISTINCT target_mz AS prec FROM targets), h AS (SELECT peak_id, prec, row_number() OVER (PARTITION BY peak_id ORDER BY abs(mz - prec), prec DESC) AS r FROM peaks JOIN c ON abs(mz - prec) < 0.25) SELECT peak_id, prec FROM h WHERE r = 1")(
    lambda s, d: intervals.associate(views.targets(s, d).select(F.col("target_mz").alias("prec")).distinct(), views.peaks(s, d), 0.25).select("peak_id", "prec")
)
query("j08_bindings", W + ", m AS (SELECT DISTINCT scan_id, flag, floor(mz / 100)::BIGINT AS b FROM peaks) SELECT a.scan_id, a.b AS pr, c.b AS fr FROM m a JOIN m c ON a.scan_id = c.scan_id AND a.flag = 'A' AND c.flag = 'R'")(
    lambda s, d: (lambda m: m.where("flag = 'A'").select("scan_id", F.col("b").alias("pr")).join(m.where("flag = 'R'").select("scan_id", F.col("b").alias("fr")), "scan_id"))(
        views.peaks(s, d).select("scan_id", "flag", F.floor(F.col("mz") / 100).alias("b")).distinct()
    )
)
query("j09_cross", "SELECT a.r_name AS pr_name, b.r_name AS fr_name FROM region a, region b")(lambda s, d: s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("pr_name")).crossJoin(s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("fr_name"))))
query("j10_complement", W + "SELECT target_id FROM targets WHERE target_id NOT IN (SELECT target_id FROM peaks JOIN targets ON abs(mz - target_mz) <= mz * 20 / 1e6)")(
    lambda s, d: views.targets(s, d).join(intervals.interval_join(views.peaks(s, d), views.targets(s, d), PPM, LARGEST).select("target_id").distinct(), "target_id", "left_anti").select("target_id")
)
query("j11_triggered", W + "SELECT peak_id FROM peaks WHERE scan_id IN (SELECT scan_id FROM scans WHERE ms_level = 2)")(lambda s, d: views.peaks(s, d).join(views.scans(s, d).where("ms_level = 2").select("scan_id"), "scan_id", "left_semi").select("peak_id"))
query("j12_peaks_scans", W + "SELECT peak_id, s.time FROM peaks p JOIN scans s ON p.scan_id = s.scan_id")(lambda s, d: views.peaks(s, d).drop("time").join(views.scans(s, d).select("scan_id", "time"), "scan_id").select("peak_id", "time"))


def _file(s, d, flag):
    return mono(s, d).where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("se_id")).agg(F.sum("l_quantity").alias("INT"))


query("j13_merge_outer", "WITH a AS (SELECT l_partkey AS se_id, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS se_id, sum(l_quantity) AS y FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT se_id, coalesce(x, 0) AS \"INT-a\", coalesce(y, 0) AS \"INT-n\" FROM a FULL JOIN b USING (se_id)")(
    lambda s, d: A.merge_tables([("a", _file(s, d, "A")), ("n", _file(s, d, "N"))], ["se_id"])
)
query("j13_merge_full_only", "WITH a AS (SELECT l_partkey AS se_id, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS se_id, sum(l_quantity) AS y FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT se_id, x AS \"INT-a\", y AS \"INT-n\" FROM a JOIN b USING (se_id)")(
    lambda s, d: A.merge_tables([("a", _file(s, d, "A")), ("n", _file(s, d, "N"))], ["se_id"], True)
)


@query("j14_quantify", "WITH q AS (SELECT p_partkey AS specie, p_type AS class, p_retailprice AS v FROM part), st AS (SELECT class, min(specie) AS standard FROM q GROUP BY class), sv AS (SELECT st.class, q.v AS sv FROM st JOIN q ON q.specie = st.standard) SELECT specie, class, round(v / sv * 10, 6) AS quantity FROM q JOIN sv USING (class)")
def _j14(s, d):
    q = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("specie"), F.col("p_type").alias("class"), F.col("p_retailprice").alias("v"))
    st = q.groupBy(F.col("class").alias("std_class")).agg(F.min("specie").alias("standard")).withColumn("amount", F.lit(10.0))
    return A.quantify(q, st, "specie", "class", "v").withColumn("quantity", rd("quantity", 6))


_ENT = W + ", e AS (SELECT DISTINCT polarity, round(mz, 1) AS mz FROM peaks)"


def _entries(s, d):
    e = views.peaks(s, d).select("polarity", F.round("mz", 1).alias("mz")).distinct()
    return e.withColumn("se_id", F.round(F.col("mz") * 10).cast("long") * F.col("polarity"))


query("j15_ladder", _ENT + " SELECT a.polarity, round(a.mz * 10)::BIGINT * a.polarity AS base_key, round(b.mz * 10)::BIGINT * b.polarity AS iso_key, k::INT AS step FROM e a JOIN range(1, 5) r(k) ON true JOIN e b ON a.polarity = b.polarity AND abs(b.mz - (a.mz + k * 1.0033)) <= 0.02")(
    lambda s, d: intervals.ladder(_entries(s, d), Tolerance("da", 0.02), LARGEST, keys=["polarity"]).select("polarity", "base_key", "iso_key", "step")
)
query("j16_previous_ms1", W + ", t AS (SELECT scan_id, run, ms_level, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (PARTITION BY run ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trigger FROM scans) SELECT scan_id, trigger FROM t WHERE ms_level = 2")(
    lambda s, d: A.previous_ms1(views.scans(s, d), ["run"], ["scan_id"]).select("scan_id", "trigger")
)
query("j16_trigger_peak", W + """, t AS (SELECT scan_id, target_mz, ms_level, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (PARTITION BY run ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trigger FROM scans),
h AS (SELECT t.scan_id, p.mz, p.i, row_number() OVER (PARTITION BY t.scan_id ORDER BY abs(p.mz - t.target_mz), p.mz, p.i) AS r FROM t JOIN peaks p ON p.scan_id = t.trigger WHERE t.ms_level = 2)
SELECT t.scan_id, trigger, h.mz AS peak_mz, h.i AS peak_i FROM t LEFT JOIN h ON t.scan_id = h.scan_id AND r = 1 WHERE t.ms_level = 2""")(
    lambda s, d: A.trigger_peak(views.scans(s, d), views.peaks(s, d), ["run"], ["scan_id"]).select("scan_id", "trigger", "peak_mz", "peak_i")
)
query("j17_nearest_any", W + ", t AS (SELECT DISTINCT target_mz FROM targets), lo AS (SELECT peak_id, mz, target_mz AS lo FROM peaks ASOF LEFT JOIN t ON mz >= target_mz), u AS (SELECT lo.*, target_mz AS hi FROM lo ASOF LEFT JOIN t ON lo.mz <= target_mz) SELECT peak_id, CASE WHEN hi IS NULL THEN lo WHEN lo IS NULL THEN hi WHEN mz - lo <= hi - mz THEN lo ELSE hi END AS target_mz FROM u")(
    lambda s, d: intervals.nearest_any(views.peaks(s, d), views.targets(s, d).select("target_mz").distinct(), "peak_id").select("peak_id", "target_mz")
)
query("j18_sibling", _ENT + " SELECT round(a.mz * 10)::BIGINT AS pos_key, -round(b.mz * 10)::BIGINT AS neg_key FROM e a JOIN e b ON a.polarity = 1 AND b.polarity = -1 AND abs(b.mz - (a.mz + 43.99)) <= 0.02")(
    lambda s, d: intervals.sibling(_entries(s, d), 43.99, Tolerance("da", 0.02), LARGEST).select("pos_key", "neg_key")
)
query("j19_charge", _ENT + ", x AS (SELECT round(a.mz * 10)::BIGINT * a.polarity AS se_id, max(z) AS charge FROM e a JOIN range(1, 4) r(z) ON true JOIN e b ON abs(b.mz - (a.mz + 1.0033 / z)) <= 0.02 AND a.polarity = b.polarity GROUP BY 1) SELECT round(mz * 10)::BIGINT * polarity AS se_id, charge::INT AS charge FROM e LEFT JOIN x ON x.se_id = round(mz * 10)::BIGINT * polarity")(
    lambda s, d: intervals.charge_by_spacing(_entries(s, d).where("polarity = 1"), Tolerance("da", 0.02), LARGEST).unionByName(intervals.charge_by_spacing(_entries(s, d).where("polarity = -1"), Tolerance("da", 0.02), LARGEST)).select("se_id", "charge")
)
query("j20_lookup", W + ", h AS (SELECT target_id, peak_id, row_number() OVER (PARTITION BY target_id ORDER BY abs(mz - target_mz), mz, peak_id) AS r FROM peaks JOIN targets ON abs(mz - target_mz) <= mz * 20 / 1e6) SELECT target_id, peak_id FROM h WHERE r = 1")(
    lambda s, d: intervals.lookup(views.peaks(s, d).select("peak_id", "mz"), views.targets(s, d), PPM, LARGEST, "peak_id").select("target_id", "peak_id")
)
query("j21_shared_fragments", W + "SELECT floor(mz * 10)::BIGINT AS mark, count(DISTINCT scan_id) AS n_entries, min(scan_id) AS first_entry, max(scan_id) AS last_entry FROM peaks GROUP BY 1 HAVING count(DISTINCT scan_id) > 1")(
    lambda s, d: A.shared_fragments(views.peaks(s, d).withColumn("mark", F.floor(F.col("mz") * 10)), ["mark"], "scan_id")
)

# --- alignment and aggregation ---------------------------------------------------

_FOLD = """, g AS (SELECT flag, list_sort(list(mz)) AS l FROM peaks GROUP BY flag),
r AS (SELECT flag, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] < acc[len(acc)] / 2000 THEN acc ELSE list_append(acc, x[1]) END) AS a FROM g),
b AS (SELECT flag, unnest(a) AS bin_first FROM r)"""
RES = Tolerance("res", 2000)
query("a01_greedy_bins", W + _FOLD + " SELECT flag, bin_first FROM b")(lambda s, d: fold.align(views.peaks(s, d).select("flag", "mz", "i"), ["flag"], RES, 1).select("flag", "bin_first").distinct())
query("a01_greedy_members", W + _FOLD + " SELECT p.flag, bin_first, count(*) AS n, sum(round(mz * 10000)::BIGINT)::BIGINT AS mz_sum FROM peaks p ASOF JOIN b ON p.flag = b.flag AND p.mz >= b.bin_first GROUP BY ALL")(
    lambda s, d: fold.align(views.peaks(s, d).select("flag", "mz", "i"), ["flag"], RES, 1).groupBy("flag", "bin_first").agg(F.count("*").alias("n"), F.round(F.first("bin_mz") * F.count("*") * 10000).cast("long").alias("mz_sum"))
)
query("a02_ppm_bins", W + _FOLD.replace("/ 2000", "* 0.0002") + " SELECT flag, bin_first FROM b")(lambda s, d: fold.align(views.peaks(s, d).select("flag", "mz", "i"), ["flag"], Tolerance("ppm", 200), 1).select("flag", "bin_first").distinct())
query("a01_three_passes")(lambda s, d: fold.align(views.peaks(s, d).select("flag", "mz", "i"), ["flag"], RES, 3).groupBy("flag", "bin_first").agg(F.count("*").alias("n"), rd(F.first("bin_mz"), 6).alias("bin_mz")))
query("a05_survey", W + _FOLD + " SELECT p.flag, bin_first, sample, sum(i) AS i FROM peaks p ASOF JOIN b ON p.flag = b.flag AND p.mz >= b.bin_first GROUP BY ALL")(
    lambda s, d: fold.survey(views.peaks(s, d).select("flag", "sample", "mz", "i"), RES, ["flag"], 1)[1]
)
query("a05_survey_passes")(lambda s, d: fold.survey(views.peaks(s, d).select("flag", "sample", "mz", "i"), RES, ["flag"], 3)[1])
query("a07_collapse")(
    lambda s, d: fold.collapse_clusters(views.peaks(s, d).groupBy("flag", F.round("mz", 1).alias("mz")).agg(F.array_sort(F.collect_set("sample")).alias("samples")), ["flag"], 0.15).groupBy("flag", "merged").agg(F.count("*").alias("n"))
)

def _msms(s: SparkSession, d: str) -> DataFrame:
    sc = views.scans(s, d).where("ms_level = 2").select("scan_id", F.col("target_mz").alias("prec_mz"))
    return views.peaks(s, d).select("polarity", "sample", "scan_id", "mz", "i").join(sc, "scan_id")


def _anchors(source: str, keys: str, value: str, name: str, window: str) -> str:
    """SQL of the first values of greedy bins."""
    return f"SELECT {keys}, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[len(acc)] < {window} THEN acc ELSE list_append(acc, v[1]) END)) AS {name} FROM (SELECT {keys}, list_sort(list({value})) AS l FROM {source} GROUP BY ALL)"


_MERGE_SQL = f"""{W}, x AS (SELECT p.polarity, p.sample, p.scan_id, s.target_mz AS prec_mz, p.mz, p.i FROM peaks p JOIN scans s USING (scan_id) WHERE s.ms_level = 2),
sx AS (SELECT DISTINCT polarity, sample, scan_id, prec_mz FROM x), sr AS ({_anchors("sx", "polarity, sample", "prec_mz", "prec_first", "20")}),
c AS (SELECT sx.*, prec_first FROM sx ASOF JOIN sr ON sx.polarity = sr.polarity AND sx.sample = sr.sample AND sx.prec_mz >= sr.prec_first),
t AS (SELECT polarity, sample, prec_first, count(DISTINCT scan_id) AS n_scans, avg(prec_mz) AS prec FROM c GROUP BY ALL),
y AS (SELECT x.polarity, x.sample, c.prec_first, x.scan_id, x.mz, x.i FROM x JOIN c USING (polarity, sample, scan_id, prec_mz)),
fb AS ({_anchors("y", "polarity, sample, prec_first", "mz", "bin_first", "acc[len(acc)] / 2000")}),
b AS (SELECT y.*, bin_first FROM y ASOF JOIN fb ON y.polarity = fb.polarity AND y.sample = fb.sample AND y.prec_first = fb.prec_first AND y.mz >= fb.bin_first),
g AS (SELECT polarity, sample, prec_first, bin_first, sum(round(mz * 10000)::BIGINT * i::BIGINT)::BIGINT AS mz_sum, sum(mz * i) / sum(i) AS mz, sum(i) AS si, count(DISTINCT scan_id) AS n_hit FROM b GROUP BY ALL)"""
query("a12_merge_msms", _MERGE_SQL + " SELECT polarity, sample, prec_first, bin_first, mz_sum, n_hit, n_scans FROM g JOIN t USING (polarity, sample, prec_first)")(
    lambda s, d: importing.merge_msms(_msms(s, d), 20.0, RES, 1).select("polarity", "sample", "prec_first", "bin_first", F.round(F.col("mz") * F.col("i") * F.col("n_scans") * 10000).cast("long").alias("mz_sum"), "n_hit", "n_scans")
)


def _a09(s: SparkSession, d: str, passes: int) -> DataFrame:
    frag, long = importing.align_msms(importing.merge_msms(_msms(s, d), 20.0, RES, passes), 20.0, RES, 4, passes, 0.5)
    return long.join(frag.select("fr_id", "polarity"), "fr_id").groupBy("polarity", "sample").agg(F.count("*").alias("n"), rd(F.sum("i"), 3).alias("total"))


query("a09_align_msms", _MERGE_SQL + f""", m AS (SELECT polarity, sample, prec_first, prec, mz, si / n_scans AS i FROM g JOIN t USING (polarity, sample, prec_first)),
mp AS (SELECT DISTINCT polarity, sample, prec_first, prec FROM m), pr AS ({_anchors("mp", "polarity", "prec", "cluster_first", "20")}),
pc AS (SELECT mp.*, cluster_first FROM mp ASOF JOIN pr ON mp.polarity = pr.polarity AND mp.prec >= pr.cluster_first),
z AS (SELECT m.polarity, cluster_first, m.sample, m.mz, m.i FROM m JOIN pc USING (polarity, sample, prec_first)),
zb AS ({_anchors("z", "polarity, cluster_first", "mz", "bin_first", "acc[len(acc)] / 2000")}),
zz AS (SELECT z.*, bin_first FROM z ASOF JOIN zb ON z.polarity = zb.polarity AND z.cluster_first = zb.cluster_first AND z.mz >= zb.bin_first),
ok AS (SELECT polarity, cluster_first, bin_first FROM zz GROUP BY ALL HAVING count(DISTINCT sample) >= 2),
l AS (SELECT polarity, cluster_first, bin_first, sample, sum(i) AS i FROM zz JOIN ok USING (polarity, cluster_first, bin_first) GROUP BY ALL)
SELECT polarity, sample, count(*) AS n, round(sum(i), 3) AS total FROM l GROUP BY ALL""")(lambda s, d: _a09(s, d, 1))
query("a09_align_msms_passes")(lambda s, d: _a09(s, d, 3))
query("a10_scan_average", W + ", n AS (SELECT sample, count(DISTINCT scan_id) AS ns FROM peaks GROUP BY 1) SELECT sample, floor(mz)::BIGINT AS bin, sum(round(mz * 10000)::BIGINT * i::BIGINT)::BIGINT AS mz_sum, round(sum(i) / ns, 6) AS i, count(DISTINCT scan_id) AS n_hit, ns AS n_scans FROM peaks JOIN n USING (sample) GROUP BY sample, bin, ns")(
    lambda s, d: A.scan_average(views.peaks(s, d).withColumn("bin", F.floor("mz")), ["sample", "bin"], views.peaks(s, d).groupBy("sample").agg(F.countDistinct("scan_id").alias("n_scans")), ["sample"]).select("sample", "bin", F.round(F.col("mz") * F.col("i") * F.col("n_scans") * 10000).cast("long").alias("mz_sum"), rd("i", 6).alias("i"), "n_hit", "n_scans")
)
query("a11_within_scan", W + "SELECT scan_id, floor(mz)::BIGINT AS bin, sum(round(mz * 10000)::BIGINT * i::BIGINT)::BIGINT AS mz_sum, round(avg(i), 6) AS i, count(*) AS n FROM peaks GROUP BY 1, 2")(
    lambda s, d: A.merge_within_scan(views.peaks(s, d).withColumn("bin", F.floor("mz")), ["scan_id", "bin"]).select("scan_id", "bin", F.round(F.col("mz") * F.col("i") * F.col("n") * 10000).cast("long").alias("mz_sum"), rd("i", 6).alias("i"), "n")
)
query("a15_single_linkage", W + ", x AS (SELECT flag, mz, CASE WHEN mz - lag(mz) OVER (PARTITION BY flag ORDER BY mz) < 0.02 THEN 0 ELSE 1 END AS s FROM peaks), c AS (SELECT flag, mz, sum(s) OVER (PARTITION BY flag ORDER BY mz ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT flag, min(mz) AS cluster, count(*) AS n FROM c GROUP BY flag, k")(
    lambda s, d: fold.single_linkage(views.peaks(s, d).select("flag", "mz"), ["flag"], 0.02).groupBy("flag", "cluster").agg(F.count("*").alias("n"))
)
query("a21_cluster_statistics", W + "SELECT floor(mz)::BIGINT AS bin, round(avg(mz), 6) AS mean, round(min(mz) + (max(mz) - min(mz)) / 2, 6) AS midrange, round(var_pop(mz), 6) AS variance, round(stddev_pop(mz), 6) AS stddev, round(max(mz) - min(mz), 6) AS \"window\" FROM peaks GROUP BY 1")(
    lambda s, d: (lambda g: g.select("bin", *[rd(c, 6).alias(c) for c in g.columns[1:]]))(views.peaks(s, d).groupBy(F.floor("mz").alias("bin")).agg(*fold.cluster_statistics()))
)
query("a22_sample_totals", W + "SELECT sample, round(sum(i), 2) AS total FROM peaks GROUP BY 1")(lambda s, d: views.peaks(s, d).groupBy("sample").agg(rd(F.sum("i"), 2).alias("total")))
query("a23_ranking", W + ", l AS (SELECT floor(mz)::BIGINT AS bin, sample, sum(i) AS i FROM peaks GROUP BY 1, 2), m AS (SELECT *, i / max(i) OVER (PARTITION BY sample) AS rel_i FROM l) SELECT bin, round(count(DISTINCT sample) / 4 + avg(rel_i), 6) AS rank_score FROM m GROUP BY bin ORDER BY 2 DESC, 1 LIMIT 25")(
    lambda s, d: A.candidate_ranking(O.relative_intensity(views.peaks(s, d).groupBy(F.floor("mz").alias("bin"), "sample").agg(F.sum("i").alias("i")), ["sample"]), "bin", 4).select("bin", rd("rank_score", 6).alias("rank_score"))
)
query("a24_nearest_hits", W + ", h AS (SELECT peak_id, target_id, round(mz - target_mz, 6) AS err FROM peaks JOIN targets ON abs(mz - target_mz) <= mz * 20 / 1e6), l AS (SELECT target_id, min(abs(err)) AS least FROM h GROUP BY 1) SELECT peak_id, target_id FROM h JOIN l USING (target_id) WHERE abs(err) = least AND abs(err) <= 0.01")(
    lambda s, d: intervals.nearest_hits_join(views.peaks(s, d).select("peak_id", "mz"), views.targets(s, d).select("target_id", "target_mz"), PPM, LARGEST, 0.01).select("peak_id", "target_id")
)
query("a25_error_summary", W + ", g AS (SELECT scan_id, avg(time) AS mean_err, avg(i) AS mean_i, stddev_samp(i) / avg(i) * 100 AS rsd, count(*) AS n FROM peaks GROUP BY 1) SELECT scan_id, round(mean_err, 6) AS mean_err, round(mean_i, 6) AS mean_i, round(rsd, 6) AS rsd, n FROM g WHERE mean_err <= (SELECT quantile_cont(mean_err, 0.25) FROM g)")(
    lambda s, d: A.error_summary(views.peaks(s, d), ["scan_id"], "time", "i").select("scan_id", rd("mean_err", 6).alias("mean_err"), rd("mean_i", 6).alias("mean_i"), rd("rsd", 6).alias("rsd"), "n")
)
query("a26_pair_average", W + "SELECT scan_id, flag, round(avg(mz), 6) AS mz, round(avg(i), 6) AS i, min(peak_id) AS first_peak FROM peaks GROUP BY 1, 2")(
    lambda s, d: views.peaks(s, d).groupBy("scan_id", "flag").agg(rd(F.avg("mz"), 6).alias("mz"), rd(F.avg("i"), 6).alias("i"), F.min("peak_id").alias("first_peak"))
)
query("a27_statistics", W + ", t AS (SELECT sample, sum(i) AS tic FROM (SELECT DISTINCT sample, i FROM peaks WHERE i > 0) GROUP BY 1) SELECT floor(mz / 10)::BIGINT AS bin, round(avg(i / tic), 6) AS mean_rel, round(stddev_pop(i / tic), 6) AS std_rel, count(*) AS n FROM peaks JOIN t USING (sample) GROUP BY 1")(
    lambda s, d: A.ion_statistics(views.peaks(s, d).withColumn("bin", F.floor(F.col("mz") / 10)), "sample", "i", ["bin"]).select("bin", rd("mean_rel", 6).alias("mean_rel"), rd("std_rel", 6).alias("std_rel"), "n")
)
query("a28_run_sums", W + ", x AS (SELECT run, scan_id, ms_level, tic, CASE WHEN lag(ms_level) OVER (PARTITION BY run ORDER BY scan_id) = ms_level THEN 0 ELSE 1 END AS s FROM scans), y AS (SELECT *, sum(s) OVER (PARTITION BY run ORDER BY scan_id ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT run, k::BIGINT AS k, ms_level, round(sum(tic), 2) AS tic, count(*) AS n FROM y GROUP BY 1, 2, 3")(
    lambda s, d: _a28(s, d)
)


def _a28(s, d):
    w = A.run_sums(views.scans(s, d).withColumnRenamed("run", "file"), ["file"], [F.col("scan_id")], "ms_level", "tic")
    return w.select(F.col("file").alias("run"), F.col("run").alias("k"), "ms_level", rd("tic", 2).alias("tic"), "n")


query("a29_total_row", W + "SELECT sample, round(sum(i), 2) AS i FROM peaks GROUP BY 1 UNION ALL SELECT 'total', round(sum(i), 2) FROM peaks")(
    lambda s, d: A.with_total(views.peaks(s, d).groupBy("sample").agg(F.sum("i").alias("i")), "sample", ["i"]).withColumn("i", rd("i", 2))
)
_SAMPLES = ("s0", "s1", "s2", "s3")
query("a30_pivot", W + "SELECT floor(mz)::BIGINT AS bin, " + ", ".join(f"round(coalesce(sum(i) FILTER (sample = '{x}'), 0), 2) AS {x}" for x in _SAMPLES) + " FROM peaks GROUP BY 1")(
    lambda s, d: views.peaks(s, d).groupBy(F.floor("mz").alias("bin")).pivot("sample", list(_SAMPLES)).agg(F.sum("i")).select("bin", *[rd(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in _SAMPLES])
)
query("a30_unpivot", "SELECT p_partkey, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")
)
query("a31_distinct", W + "SELECT DISTINCT sample, flag FROM peaks")(lambda s, d: views.peaks(s, d).select("sample", "flag").distinct())
query("a32_resolution", W + ", x AS (SELECT scan_id, mz, mz - lag(mz) OVER (PARTITION BY scan_id ORDER BY mz, peak_id) AS gap FROM peaks), lim AS (SELECT min(mz) AS lo, max(mz) AS hi FROM peaks), g AS (SELECT least(floor((mz - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, mz, mz / (gap * (2.355 / 3)) AS res FROM x, lim WHERE gap > 0), b AS (SELECT bin, max(res) AS res FROM g GROUP BY 1) SELECT bin, round(res, 3) AS res FROM b WHERE res <= (SELECT quantile_cont(res, 0.95) FROM b)")(
    lambda s, d: A.resolution_points(views.peaks(s, d)).select("bin", rd("res", 3).alias("res"))
)
query("a32_quadratic_fit")(lambda s, d: A.quadratic_fit(A.resolution_points(views.peaks(s, d)).select((F.col("mz") / 1000).alias("x"), (F.col("res") / 1e4).alias("y")), "x", "y").select(*[rd(f"c{k}", 3).alias(f"c{k}") for k in range(3)]))
query("a33_least_gap", W + ", x AS (SELECT scan_id, lead(mz) OVER (PARTITION BY scan_id ORDER BY mz, peak_id) - mz AS gap FROM peaks) SELECT scan_id, round(min(gap), 6) AS gap FROM x WHERE gap > 0 GROUP BY 1")(
    lambda s, d: A.least_gap(views.peaks(s, d), ["scan_id"], ["mz", "peak_id"]).select("scan_id", rd("gap", 6).alias("gap"))
)
query("a34_spray_stability", W + ", x AS (SELECT run, tic, row_number() OVER (PARTITION BY run ORDER BY tic, scan_id) AS a, row_number() OVER (PARTITION BY run ORDER BY tic DESC, scan_id DESC) AS z FROM scans) SELECT run, round((max(tic) - min(tic)) / median(tic) * 100, 4) AS stability, count(*) AS n FROM x WHERE a > 5 AND z > 5 GROUP BY 1")(
    lambda s, d: A.spray_stability(views.scans(s, d), ["run"], "tic", 5).select("run", rd("stability").alias("stability"), "n")
)
query("a35_similarity", W + ", a AS (SELECT floor(mz)::BIGINT AS bin, sum(i) AS x FROM peaks WHERE sample = 's0' GROUP BY 1), b AS (SELECT floor(mz)::BIGINT AS bin, sum(i) AS y FROM peaks WHERE sample = 's1' GROUP BY 1), j AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (bin)), g AS (SELECT sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine, corr(x, y) AS pearson, count(*) AS n FROM j) SELECT round(cosine, 6) AS cosine, round((1 - acos(least(cosine, 1)) / 1.5707963267948966) * 100, 4) AS angle_percent, round(pearson, 6) AS pearson, n FROM g")(
    lambda s, d: (lambda p: A.similarity(p.where("sample = 's0'"), p.where("sample = 's1'"), "bin").select(rd("cosine", 6).alias("cosine"), rd("angle_percent").alias("angle_percent"), rd("pearson", 6).alias("pearson"), "n"))(
        views.peaks(s, d).groupBy(F.floor("mz").alias("bin"), "sample").agg(F.sum("i").alias("i"))
    )
)


query("a03_learnt_window")(lambda s, d: fold.learnt_align(views.peaks(s, d).select("flag", "mz", "i"), ["flag"], 4).groupBy("flag", "bin_first").agg(F.count("*").alias("n"), rd(F.first("bin_mz"), 6).alias("bin_mz")))
query("a06_survey_learnt_window")(
    lambda s, d: fold.learnt_align(views.peaks(s, d).select("flag", "sample", "mz", "i"), ["flag"], 4, fold.Learnt(10.0, "below_mean")).groupBy("flag", "bin_first", "sample").agg(F.sum("i").alias("i"))
)


@query("a08_collapse_msms")
def _a08(s, d):
    one = views.peaks(s, d).groupBy("flag", F.round("mz", 1).alias("m"), "sample").agg(F.min("mz").alias("mass"), F.sum("i").alias("intensity"))
    c = one.groupBy("flag", "m").agg(F.array_sort(F.collect_list(F.struct("sample", "mass", "intensity"))).alias("members")).withColumnRenamed("m", "mz")
    out = fold.collapse_msms(c, ["flag"])
    return out.groupBy("flag", F.array_min("members.mass").alias("least_mass"), F.size("members").alias("n")).agg(F.count("*").alias("n_clusters"))


query("a19_chained_clusters", W + _FOLD.replace("< acc[len(acc)] / 2000", "<= acc[len(acc)] / 2000") + " SELECT p.flag, sum(round(mz * 10000)::BIGINT * i::BIGINT)::BIGINT AS mz_sum, sum(i) AS i, count(*) AS n FROM peaks p ASOF JOIN b ON p.flag = b.flag AND p.mz >= b.bin_first GROUP BY p.flag, bin_first")(
    lambda s, d: fold.chained_clusters(views.peaks(s, d).select("flag", "mz", "i"), ["flag"], 2000).select("flag", F.round(F.col("mz") * F.col("i") * 10000).cast("long").alias("mz_sum"), "i", "n")
)


@query("a16_kmeans")
def _a16(s, d):
    """a16: k-means (rows only: another start than the reference's)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=4, seed=7, maxIter=20).fit(v)
    return model.transform(v).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


# --- corrections and calibration ---------------------------------------------------


@query("i01_isotope_patterns")
def _i01(s, d):
    f = _compositions(s, d).select("p_partkey", "C", "H", "O")
    p = isotope.patterns(s, f.select("C", "H", "O"), {"C": "C", "H": "H", "O": "O"})
    return f.join(p, ["C", "H", "O"]).select("p_partkey", *[rd(F.get("pattern", F.lit(k)), 6).alias(f"p{k}") for k in range(5)])


def _patterned(s, df, *pairs):
    """Patterns of compositions made of masses (a chain of CH2), one column for each (mass, name)."""
    for mass, name in pairs:
        n = F.greatest(F.round(F.col(mass) / 14.01565).cast("int"), F.lit(0))
        df = df.withColumn("_c", n)
        p = isotope.patterns(s, df.select(F.col("_c").alias("C"), (2 * F.col("_c")).alias("H")).distinct(), {"C": "C", "H": "H"})
        df = df.join(p.select(F.col("C").alias("_c"), F.col("pattern").alias(name)), "_c").drop("_c")
    return df


@query("i03_isotope_correction")
def _i03(s, d):
    e = views.peaks(s, d).groupBy("polarity", "sample", F.round("mz", 1).alias("mz")).agg(F.sum("i").alias("i"))
    e = _patterned(s, e.withColumn("se_id", F.round(F.col("mz") * 10).cast("long") * F.col("polarity")), ("mz", "pattern"))
    e = e.join(isotope.reach(e, "se_id", 1.0, 0.5, 4), "se_id")
    return isotope.correct(e, Tolerance("da", 0.02), ["polarity"]).select("se_id", "sample", rd("corrected").alias("corrected"))


@query("i05_msms_correction")
def _i05(s, d):
    sc = views.scans(s, d).select("scan_id", F.round("target_mz").alias("prec_mz"))
    e = views.peaks(s, d).where("ms_level = 2").join(sc, "scan_id").groupBy("polarity", "sample", "prec_mz", F.round("mz").alias("mz")).agg(F.sum("i").alias("i"))
    e = _patterned(s, e.withColumn("_l", F.greatest(F.col("prec_mz") - F.col("mz"), F.lit(0.0))), ("mz", "fragment"), ("_l", "loss")).drop("_l")
    e = e.withColumn("fr_id", F.xxhash64("polarity", "prec_mz", "mz"))
    return isotope.correct_msms(e, Tolerance("da", 0.02), ["polarity"]).select("polarity", "sample", "prec_mz", "mz", rd("corrected").alias("corrected"))


query("i06_monoisotopic", "WITH long AS (SELECT l_partkey AS p_partkey, sum(l_quantity) AS i FROM lineitem GROUP BY 1), comp AS (SELECT p_partkey, 20 + p_size AS c, 2 * (20 + p_size) + 1 - 2 * (p_partkey % 6) AS h FROM part) SELECT p_partkey, round(i / (pow(0.9893, c) * pow(0.999885, h) * pow(0.99757, 2)), 4) AS total FROM long JOIN comp USING (p_partkey)")(
    lambda s, d: views.sample_maps(s, d).join(_compositions(s, d), F.col("part") == F.col("p_partkey")).select(
        "p_partkey", rd(F.aggregate(F.map_values(isotope.monoisotopic(F.col("m"), isotope.share_column({e: F.col(e) for e in "CHO"}))), F.lit(0.0), lambda a, v: a + v)).alias("total")
    )
)
query("i07_below_occupation", M + ", c AS (SELECT part, sample, greatest(i - 60, 0) AS i FROM long) SELECT part, sample, i FROM c WHERE part IN (SELECT part FROM c GROUP BY part HAVING count(*) FILTER (i > 0) >= 3)")(
    lambda s, d: O.meets_occupation(
        mono(s, d).groupBy(F.col("l_partkey").alias("part"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("sample")).agg(F.greatest(F.sum("l_quantity") - 60, F.lit(0.0)).alias("i")), ["part"], 4, 0.75
    )
)
query("i10_isobaric", "WITH p AS (SELECT DISTINCT p_type AS name, p_size AS mz FROM part) SELECT a.name, a.mz, coalesce(string_agg(b.name, ' @ ' ORDER BY b.name), '') AS isobaric FROM p a LEFT JOIN p b ON a.mz = b.mz AND a.name <> b.name GROUP BY 1, 2")(
    lambda s, d: A.isobaric(s.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("name"), F.col("p_size").alias("mz")).distinct(), ["mz"], "name").select("name", "mz", "isobaric")
)
query("i11_permutations", W + ", b AS (SELECT peak_id, least(n_scans, time) AS a, greatest(n_scans, time) AS b, i / greatest(1, abs(n_scans - time)) AS sc FROM peaks) SELECT a, b, peak_id FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY sc DESC, peak_id) AS r FROM b) WHERE r = 1")(
    lambda s, d: A.drop_permutations(views.peaks(s, d).select("peak_id", F.least("n_scans", "time").alias("a"), F.greatest("n_scans", "time").alias("b"), (F.col("i") / F.greatest(F.lit(1.0), F.abs(F.col("n_scans") - F.col("time")))).alias("sc")), ["a", "b"], F.col("sc"), "peak_id").select("a", "b", "peak_id")
)
_CAL = W + ", ref AS (SELECT DISTINCT target_mz FROM targets), h AS (SELECT sample, target_mz, mz - target_mz AS shift, row_number() OVER (PARTITION BY sample, target_mz ORDER BY i DESC, mz DESC) AS r FROM peaks JOIN ref ON abs(mz - target_mz) <= mz * 100 / 1e6), pts AS (SELECT sample, target_mz, shift FROM h WHERE r = 1)"


def _points(s, d):
    return A.calibration_points(views.peaks(s, d), views.targets(s, d).select("target_mz").distinct(), 100, LARGEST, ["sample"])


query("i12_calibration_points", _CAL + " SELECT sample, target_mz, round(shift, 6) AS shift FROM pts")(lambda s, d: _points(s, d).select("sample", "target_mz", rd("shift", 6).alias("shift")))
query("i14_recalibrate", _CAL + """, p AS (SELECT peak_id, sample, mz FROM peaks),
lo AS (SELECT p.peak_id, p.sample, p.mz, pts.target_mz AS x0, pts.shift AS y0 FROM p ASOF LEFT JOIN pts ON p.sample = pts.sample AND p.mz >= pts.target_mz),
u AS (SELECT lo.*, pts.target_mz AS x1, pts.shift AS y1 FROM lo ASOF LEFT JOIN pts ON lo.sample = pts.sample AND lo.mz < pts.target_mz)
SELECT peak_id, floor((mz - CASE WHEN x0 IS NULL AND x1 IS NULL THEN 0 WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (mz - x0) / (x1 - x0) END) * 1e6 + 0.5)::BIGINT AS micro_mz FROM u""")(
    lambda s, d: A.recalibrate(views.peaks(s, d), _points(s, d), ["sample"], LARGEST).select("peak_id", F.floor(F.col("mz") * 1e6 + 0.5).alias("micro_mz"))
)
query("i15_shift", W + "SELECT peak_id, round(mz + 0.0021, 6) AS mz FROM peaks")(lambda s, d: views.peaks(s, d).select("peak_id", rd(F.col("mz") + 0.0021, 6).alias("mz")))
query("i17_drop_sample", M + "SELECT part, sum(i) AS total FROM long WHERE sample <> 's2' GROUP BY 1")(
    lambda s, d: views.sample_maps(s, d).select("part", F.map_filter("m", lambda k, _: k != "s2").alias("m")).where(F.size("m") > 0).select("part", F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v).alias("total"))
)

# --- scalar functions -------------------------------------------------------------

query("x01_arithmetic", W + "SELECT peak_id, round((CASE WHEN time = 0 THEN 0 ELSE mz / time END + i * 2 - 1) * greatest(time, 1) * 10000)::BIGINT AS v FROM peaks")(lambda s, d: views.peaks(s, d).select("peak_id", F.round((X.divide(F.col("mz"), F.col("time")) + F.col("i") * 2 - 1) * F.greatest("time", F.lit(1.0)) * 10000).cast("long").alias("v")))
query("x01_map_arithmetic", M + "SELECT part, round(sum(i / 2 + i), 4) AS total FROM long GROUP BY 1")(
    lambda s, d: views.sample_maps(s, d).select("part", rd(F.aggregate(F.map_values(X.map_map("+", X.map_num("/", F.col("m"), F.lit(2.0)), F.col("m"))), F.lit(0.0), lambda a, v: a + v)).alias("total"))
)


@query("x02_formula_arithmetic", _FORMULAS + " SELECT p_partkey, chemsc, greatest(c - 27, 0) AS \"C\", greatest(h - 45, 0) AS \"H\" FROM ok")
def _x02(s, d):
    f = chem.parse_formula("C27 H45").counts
    return _formulas(s, d).select("p_partkey", "chemsc", *[F.greatest(F.col(e) - f[e], F.lit(0)).cast("long").alias(e) for e in "CH"])


query("x03_weight_dbr", _FORMULAS + " SELECT p_partkey, chemsc, round(mz0, 6) AS mass, dbr FROM ok")(lambda s, d: _formulas(s, d).select("p_partkey", "chemsc", rd("mass", 6).alias("mass"), "dbr"))
query("x04_average", M + "SELECT part, round(avg(i), 6) AS v FROM long GROUP BY 1")(lambda s, d: views.sample_maps(s, d).select("part", rd(X.map_average(F.col("m")), 6).alias("v")))
query("x05_medians", M + "SELECT part, list_sort(list(i))[count(*) // 2 + 1] AS upper, list_sort(list(i))[(count(*) - 1) // 2 + 1] AS lower FROM long GROUP BY part")(
    lambda s, d: views.sample_maps(s, d).select("part", X.median_upper(F.map_values("m")).alias("upper"), X.median_lower(F.map_values("m")).alias("lower"))
)
query("x06_abs", M + "SELECT part, round(sum(abs(i - 100)), 4) AS v FROM long GROUP BY 1")(lambda s, d: views.sample_maps(s, d).select("part", rd(F.aggregate(F.map_values(X.map_abs(X.map_num("-", F.col("m"), F.lit(100.0)))), F.lit(0.0), lambda a, v: a + v)).alias("v")))
query("x07_sum_intensity", M + "SELECT part, round(sum(i + i * 2), 4) AS v FROM long GROUP BY 1")(
    lambda s, d: views.sample_maps(s, d).select("part", rd(F.aggregate(F.map_values(X.sum_intensity(F.col("m"), F.col("m"), X.map_num("*", F.col("m"), F.lit(2.0)))), F.lit(0.0), lambda a, v: a + v)).alias("v"))
)
query("x09_score", W + "SELECT peak_id, printf('%.2f', 1 - (abs(time) + abs(n_scans)) / 2 / 12.7) AS score FROM peaks")(lambda s, d: views.peaks(s, d).select("peak_id", X.score(12.7, F.col("time"), F.col("n_scans")).alias("score")))
query("x11_to_standard", M + "SELECT a.part, round(sum(a.i / b.i), 6) AS v FROM long a JOIN long b ON b.part = 1 AND a.sample = b.sample GROUP BY 1")(
    lambda s, d: (lambda m: m.join(F.broadcast(m.where("part = 1").select(F.explode("m").alias("k", "sv"))), F.lit(True)).where(F.map_contains_key("m", F.col("k"))).groupBy("part").agg(rd(F.sum(X.relative_to_standard(F.element_at("m", F.col("k")), F.col("sv"))), 6).alias("v")))(views.sample_maps(s, d))
)
query("x12_parity", "SELECT p_partkey, p_size % 2 = 0 AS even, p_size % 2 = 1 AS odd, (p_size * p_size)::DOUBLE AS sq FROM part")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", X.is_even(F.col("p_size")).alias("even"), X.is_odd(F.col("p_size")).alias("odd"), X.square(F.col("p_size")).alias("sq")))
query("x13_format", _FORMULAS + " SELECT p_partkey, printf('FA %d:%d', c - 3, trunc(dbr)::BIGINT) AS name, printf('%.2f', mz0 - 0.00055) AS mz FROM ok")(
    lambda s, d: _formulas(s, d).select("p_partkey", X.printf("FA %d:%d", [(F.col("C") - 3, "num"), (F.col("dbr"), "num")]).alias("name"), X.printf("%.2f", [(F.col("mz"), "num")]).alias("mz"))
)
query("x14_names", "SELECT p_brand, string_agg(DISTINCT p_type, ' @ ' ORDER BY p_type) AS names FROM part GROUP BY 1")(lambda s, d: s.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.collect_set("p_type").alias("n")).select("p_brand", X.join_names(F.col("n")).alias("names")))
query("x17_minmax", "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS v FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")(
    lambda s, d: (lambda p: p.join(F.broadcast(p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))).select("p_partkey", rd(X.minmax(F.col("p_retailprice"), F.col("lo"), F.col("hi")), 6).alias("v")))(s.read.parquet(f"{d}/part.parquet"))
)
query("x17_minkowski", "SELECT a.vec_id, round(pow(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(abs(z[1]::DOUBLE - z[2]::DOUBLE), 3))), 1.0 / 3), 4) AS v FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")(
    lambda s, d: (lambda e: e.join(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("b")))).select("vec_id", rd(X.minkowski(F.col("embedding"), F.col("b"), 3.0)).alias("v")))(s.read.parquet(f"{d}/embeddings.parquet"))
)
query("x18_cells", "SELECT event_id, greatest(coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN '-1' ELSE value::VARCHAR END AS DOUBLE), 0), 0) AS v FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", X.cell(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.lit("-1")).otherwise(F.col("value").cast("string"))).alias("v"))
)

# --- sources and sinks -------------------------------------------------------------

query("s02_scan_list", W + "SELECT time, target_mz FROM scans WHERE time BETWEEN 10 AND 20")(lambda s, d: spectra.scan_list(views.scans(s, d), 10, 20))
query("s02_time_span", W + "SELECT min(time) AS first, max(time) AS last FROM scans")(lambda s, d: spectra.time_span(views.scans(s, d)))
query("s03_xic", W + ", p AS (SELECT scan_id, sum(i) AS i FROM peaks WHERE mz BETWEEN 100 AND 300 GROUP BY 1) SELECT scan_id, s.time, coalesce(p.i, 0) AS i FROM scans s LEFT JOIN p USING (scan_id) WHERE ms_level = 1 AND time BETWEEN 0 AND 50")(lambda s, d: spectra.xic(views.scans(s, d), views.peaks(s, d), 0, 50, 100, 300))
query("s04_closest", W + "SELECT peak_id, mz FROM peaks ORDER BY abs(mz - 512.345), mz LIMIT 1")(lambda s, d: spectra.closest(views.peaks(s, d), "mz", 512.345, *spectra.INPUT_ORDER).select("peak_id", "mz"))
query("s16_target_list", _FORMULAS + " SELECT p_partkey, chemsc, round(mz0 - 0.00055, 6) AS mz FROM ok")(lambda s, d: _formulas(s, d).select("p_partkey", "chemsc", rd("mz", 6).alias("mz")))


@query("s17_filter_line", W + "SELECT scan_id, ms_level, polarity, CASE WHEN ms_level = 2 THEN round(target_mz, 2) END AS precursor FROM scans")
def _s17(s, d):
    t = views.scans(s, d)
    sign = F.when(F.col("polarity") > 0, " + ").otherwise(" - ")
    line = F.concat(F.lit("FTMS"), sign, F.when(F.col("ms_level") == 2, F.concat(F.lit("NSI Full ms2 "), F.round("target_mz", 2).cast("decimal(12,2)").cast("string"), F.lit("@hcd12.50 [120-430]"))).otherwise(F.lit("NSI Full ms [120-430]")))
    f = spectra.filter_line_fields(F.col("line"))
    return t.select("scan_id", line.alias("line")).select("scan_id", *[c.alias(n) for n, c in f.items()])


query("k01_report_lines", "SELECT -1 AS ord1, 'specie,n,brand' AS line UNION ALL SELECT 0, '###,a' UNION ALL SELECT 0, concat_ws(',', p_name, p_size::VARCHAR, '') FROM part UNION ALL SELECT 1, '###,b' UNION ALL SELECT 1, concat_ws(',', s_name, '', s_nationkey::VARCHAR) FROM supplier")(
    lambda s, d: sinks.report_lines(
        {"a": s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("specie"), F.col("p_size").alias("n")), "b": s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("specie"), F.col("s_nationkey").alias("brand"))}
    ).select("ord1", "line")
)
query("k02_dump", "WITH sl AS (SELECT l_suppkey AS se_id, concat('s', l_linenumber) AS sample, sum(l_quantity) AS i FROM lineitem GROUP BY 1, 2) SELECT se_id, 1 AS level, (se_id * 10)::DOUBLE AS mz, sample, i FROM sl UNION ALL SELECT se_id, 2, (se_id * 10 - 1)::DOUBLE, sample, i FROM sl")(lambda s, d: _k02(s, d))


def _k02(s, d):
    sl = mono(s, d).groupBy(F.col("l_suppkey").alias("se_id"), F.concat(F.lit("s"), "l_linenumber").alias("sample")).agg(F.sum("l_quantity").alias("i")).withColumn("mz", (F.col("se_id") * 10).cast("double"))
    fl = sl.select((F.col("se_id") + 1000).alias("fr_id"), (F.col("mz") - 1).alias("mz"), "sample", "i")
    bridge = fl.select("fr_id").distinct().select("fr_id", (F.col("fr_id") - 1000).alias("se_id"))
    return sinks.dump(sl, fl, bridge).select("se_id", "level", "mz", "sample", "i")


query("k06_mztab", "SELECT 0 AS ord, 'MTD\tmzTab-version\t2.0.0-M' AS line UNION ALL SELECT 1, 'MTD\tmzTab-ID\tt' UNION ALL SELECT 2, 'MTD\ttitle\tt' UNION ALL SELECT 3, 'MTD\tassay[1]\tp_size' UNION ALL SELECT 1000, 'SMH\tSML_ID\tchemical_name\tchemical_formula\ttheoretical_neutral_mass\tabundance_assay[1]' UNION ALL SELECT 1001, concat_ws('\t', 'SML', p_name, p_name, p_type, p_retailprice::VARCHAR, p_size::VARCHAR) FROM part")(
    lambda s, d: sinks.mztab_lines(s.read.parquet(f"{d}/part.parquet"), "t", "p_name", "p_retailprice", "p_type", ["p_size"])
)
query("k08_union_results", "SELECT r_name AS name, NULL::INT AS n_nationkey, 'a' AS query FROM region UNION ALL SELECT n_name, n_nationkey, 'b' FROM nation")(
    lambda s, d: sinks.union_results({"a": s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name")), "b": s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"), "n_nationkey")})
)

# --- order, sets ---------------------------------------------------------------------

query("o01_sorted_index", W + "SELECT peak_id, row_number() OVER (PARTITION BY sample ORDER BY mz, peak_id) AS idx FROM peaks")(lambda s, d: A.ranked(views.peaks(s, d).select("sample", "mz", "peak_id"), ["sample"], ["mz", "peak_id"]).select("peak_id", "idx"))
query("o02_top_k", W + "SELECT peak_id, i FROM peaks ORDER BY i DESC, mz DESC, peak_id LIMIT 25")(lambda s, d: O.top_k(views.peaks(s, d), [F.desc("i"), F.desc("mz"), F.col("peak_id")], 25).select("peak_id", "i"))
query("o04_first_per_key", W + "SELECT scan_id, peak_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY i DESC, mz, peak_id) AS r FROM peaks) WHERE r = 1")(lambda s, d: O.first_per_key(views.peaks(s, d), ["scan_id"], [F.desc("i"), F.col("mz"), F.col("peak_id")]).select("scan_id", "peak_id"))
query("o03_two_errors", W + "SELECT peak_id, target_id, row_number() OVER (PARTITION BY scan_id ORDER BY abs(mz - target_mz), time, peak_id, target_id) AS place FROM peaks JOIN targets ON abs(mz - target_mz) <= mz * 20 / 1e6")(
    lambda s, d: intervals.ranked_pairs(views.peaks(s, d), views.targets(s, d), PPM, LARGEST, "scan_id", ["time"], "peak_id", "target_id")
)
query("o05_nearest_solution", W + _LAT + ", h AS (SELECT peak_id, 'C' || c || ' H' || h || ' O2' AS chemsc, row_number() OVER (PARTITION BY peak_id ORDER BY abs(p.mz - mz1), 'C' || c || ' H' || h || ' O2') AS r FROM peaks p JOIN ok ON abs(p.mz - mz1) <= p.mz * 20 / 1e6) SELECT peak_id, chemsc FROM h WHERE r = 1")(
    lambda s, d: O.nearest_solution(intervals.interval_join(views.peaks(s, d), _lattice(s).select("chemsc", F.col("mz").alias("target_mz")), PPM, LARGEST), "peak_id").select("peak_id", "chemsc")
)
query("o06_lag", W + "SELECT peak_id, round(mz - lag(mz) OVER (PARTITION BY scan_id ORDER BY mz, peak_id), 6) AS diff FROM peaks")(lambda s, d: views.peaks(s, d).select("peak_id", rd(F.col("mz") - F.lag("mz").over(Window.partitionBy("scan_id").orderBy("mz", "peak_id")), 6).alias("diff")))
query("o07_quantile", W + "SELECT flag, round(quantile_cont(mz, 0.95), 6) AS q FROM peaks GROUP BY 1")(lambda s, d: views.peaks(s, d).groupBy("flag").agg(rd(F.percentile("mz", 0.95), 6).alias("q")))
query("u02_intersect", W + "SELECT scan_id FROM peaks WHERE flag = 'A' INTERSECT SELECT scan_id FROM peaks WHERE flag = 'R'")(lambda s, d: views.peaks(s, d).where("flag = 'A'").select("scan_id").intersect(views.peaks(s, d).where("flag = 'R'").select("scan_id")))
query("u03_except", W + "SELECT scan_id FROM peaks WHERE flag = 'A' EXCEPT SELECT scan_id FROM peaks WHERE flag = 'R'")(lambda s, d: views.peaks(s, d).where("flag = 'A'").select("scan_id").subtract(views.peaks(s, d).where("flag = 'R'").select("scan_id")))
query("u05_concat", "SELECT p_type AS class, p_partkey AS specie FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT c_mktsegment, c_custkey FROM customer")(
    lambda s, d: sinks.concat(
        [s.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("class"), F.col("p_partkey").alias("specie")), s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("specie"), F.lit("supplier").alias("class")), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("specie"))]
    )
)
query("u06_common_columns", "SELECT s_suppkey AS specie, s_nationkey AS class FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer")(
    lambda s, d: sinks.concat(sinks.common_columns([s.read.parquet(f"{d}/{t}.parquet").select(F.col(f"{k}").alias("specie"), F.col(f"{n}").alias("class"), f"{x}") for t, k, n, x in (("supplier", "s_suppkey", "s_nationkey", "s_name"), ("customer", "c_custkey", "c_nationkey", "c_mktsegment"))]))
)
query("u04_tagged_union", W + "SELECT scan_id, string_agg(DISTINCT flag, ',' ORDER BY flag) AS tags FROM peaks GROUP BY 1")(lambda s, d: views.peaks(s, d).groupBy("scan_id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("tags")))
query("st_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda s, d: averages.windowed(s.read.parquet(f"{d}/events.parquet"), "ts", "event_type", "value").withColumn("total", rd("total"))
)

# --- the language --------------------------------------------------------------------

FLAGSHIP = """QUERYNAME = AmidesWithTails;
DEFINE head = 'C[18..48] H[30..98] N[1] O[1..4]' WITH CHG = +1, DBR = (1, 14), MINOCC = 0.5;
DEFINE tail = 'C[4..20] H[7..40] O[1]' WITH CHG = +1, DBR = (0.5, 6.5), MASSRANGE = (70, 320), MAXOCC = 0.75;
IDENTIFY head IN MS1+ AND tail IN MS2+
SUCHTHAT medianU(tail.intensity) > 20 AND isEven(head.chemsc[O]) AND head.chemsc[C] > tail.chemsc[C] + 10
REPORT LABEL = "%d/%d" % "(head.chemsc[C], tail.chemsc[C])"; HEAD = head.chemsc; TAIL = tail.chemsc; OFF = "%.1f" % "(head.errppm)";
  SEEN = head.occ; MEAN = avg(head.intensity); LOW = medianL(tail.intensity); N = nbsmpls(); ALSO = tail.isobaric; AREA = head.intensity;;"""


def _tables(s: SparkSession, d: str) -> identify.Tables:
    """Entries and fragments are tenths of a mass unit over all samples; those with a scan in common belong together."""
    p = views.peaks(s, d).where("polarity = 1").withColumn("key", F.floor(F.col("mz") * 10))
    level = lambda n, key: p.where(F.col("ms_level") == n).withColumnRenamed("key", key)
    one, two = level(1, "se_id"), level(2, "fr_id")
    entries = lambda t, key: t.groupBy(key).agg(F.min("mz").alias("mz"), F.lit(1).alias("polarity"))
    long = lambda t, key: t.groupBy(key, "sample").agg(F.sum("i").alias("i"))
    return identify.Tables(
        entries(one, "se_id"), long(one, "se_id"), entries(two, "fr_id"), long(two, "fr_id"), None, LARGEST, one.select("se_id", "scan_id").distinct(), two.select("fr_id", "scan_id").distinct()
    )


def _level_sql(n: int, name: str) -> str:
    wide = ", ".join(f"coalesce(sum(i) FILTER (sample = 's{k}'), 0) AS s{k}" for k in range(4))
    return f""", {name}p AS (SELECT *, floor(mz * 10)::BIGINT AS id FROM peaks WHERE polarity = 1 AND ms_level = {n}),
{name} AS (SELECT id, min(mz) AS mz, {wide} FROM {name}p GROUP BY id),
{name}o AS (SELECT *, list_sort([s0, s1, s2, s3]) AS l, ((s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT + (s3 > 0)::INT) / 4 AS occ FROM {name})"""


_FLAG_SQL = (
    W
    + _level_sql(1, "se")
    + _level_sql(2, "fr")
    + """, hl AS (SELECT c, h, o, 12.0 * c + 1.0078250321 * h + 14.0030740052 + 15.9949146221 * o AS m0, (2.0 + 2 * c - h + 1) / 2 AS dbr FROM range(18, 49) a(c), range(30, 99) b(h), range(1, 5) d(o)),
head AS (SELECT se.*, c, h, o, (mz - (m0 - 0.00055)) / mz * 1e6 AS err FROM seo se JOIN hl ON abs(mz - (m0 - 0.00055)) <= mz * 20 / 1e6 WHERE dbr BETWEEN 1 AND 14 AND floor(m0)::BIGINT % 2 = 0 AND occ >= 0.5),
tl AS (SELECT c, h, 12.0 * c + 1.0078250321 * h + 15.9949146221 AS m0, (2.0 + 2 * c - h) / 2 AS dbr FROM range(4, 21) a(c), range(7, 41) b(h)),
tail AS (SELECT fr.*, c, h FROM fro fr JOIN tl ON abs(mz - (m0 - 0.00055)) <= mz * 20 / 1e6 WHERE dbr BETWEEN 0.5 AND 6.5 AND floor(m0)::BIGINT % 2 = 1 AND mz BETWEEN 70 AND 320 AND occ <= 0.75),
both_ AS (SELECT DISTINCT a.id AS se, b.id AS fr FROM sep a JOIN frp b ON a.scan_id = b.scan_id WHERE a.id IN (SELECT id FROM head) AND b.id IN (SELECT id FROM tail))
SELECT a.id AS se_id, a.c || '/' || b.c AS "LABEL", 'C' || a.c || ' H' || a.h || ' N1 O' || a.o AS "HEAD", 'C' || b.c || ' H' || b.h || ' O1' AS "TAIL", printf('%.1f', a.err) AS "OFF", a.occ AS "SEEN", (a.s0 + a.s1 + a.s2 + a.s3) / 4 AS "MEAN", b.l[2] AS "LOW", 4.0::DOUBLE AS "N",
CASE WHEN b.mz IN (SELECT mz FROM head) THEN 'head' ELSE '' END AS "ALSO", a.s0 AS "AREA:s0", a.s1 AS "AREA:s1", a.s2 AS "AREA:s2", a.s3 AS "AREA:s3"
FROM both_ JOIN head a ON a.id = se JOIN tail b ON b.id = fr WHERE b.l[3] > 20 AND a.o % 2 = 0 AND a.c > b.c + 10"""
)


@query("m02_identify", _FLAG_SQL)
def flagship(s: SparkSession, d: str) -> DataFrame:
    """m01-m07, x04, x05, x10, x13: a whole query, from its text to its report, over entries that some samples lack."""
    return identify.run(lang.parse_query(FLAGSHIP), _tables(s, d), [f"s{k}" for k in range(4)], PPM)


#: The same scopes over sparser tables: entries of one sample, and longer tails.
ENTRY = """QUERYNAME = AmidesWithLongTails;
DEFINE head = 'C[18..48] H[30..98] N[1] O[1..4]' WITH CHG = +1, DBR = (1, 14);
DEFINE tail = 'C[4..40] H[7..80] O[1]' WITH CHG = +1, DBR = (0.5, 12.5), MASSRANGE = (70, 620), MAXOCC = 0.75;
IDENTIFY head IN MS1+ AND tail IN MS2+
SUCHTHAT avg(tail.intensity) > 2 AND isEven(head.chemsc[O]) AND head.chemsc[C] > tail.chemsc[C]
REPORT LABEL = "%d/%d" % "(head.chemsc[C], tail.chemsc[C])"; HEAD = head.chemsc; TAIL = tail.chemsc; OFF = "%.1f" % "(head.errppm)";
  SEEN = head.occ; MEAN = avg(head.intensity); LOW = medianL(tail.intensity); N = nbsmpls(); ALSO = tail.isobaric; AREA = head.intensity;;"""

_ENTRY_SQL = (
    _FLAG_SQL.replace(" AND occ >= 0.5", "")
    .replace("range(4, 21) a(c), range(7, 41) b(h)", "range(4, 41) a(c), range(7, 81) b(h)")
    .replace("dbr BETWEEN 0.5 AND 6.5", "dbr BETWEEN 0.5 AND 12.5")
    .replace("mz BETWEEN 70 AND 320", "mz BETWEEN 70 AND 620")
    .replace("b.l[3] > 20", "(b.s0 + b.s1 + b.s2 + b.s3) / 4 > 2")
    .replace("a.c > b.c + 10", "a.c > b.c")
)


@query("m02_long_tails", _ENTRY_SQL)
def long_tails(s: SparkSession, d: str) -> DataFrame:
    """The query of the entry point: pairs of both levels also where each entry is of one sample."""
    return identify.run(lang.parse_query(ENTRY), _tables(s, d), [f"s{k}" for k in range(4)], PPM)


_ONE = "QUERYNAME = Single; DEFINE x = 'C[30..60] H[30..120] O[2]' WITH CHG = +1, DBR = (0.5, 12.5); IDENTIFY x IN MS1+ REPORT M = x.mass; F = x.chemsc;;"


def _single(s: SparkSession, d: str, text: str = _ONE) -> DataFrame:
    return identify.run(lang.parse_query(text), _tables(s, d), [f"s{k}" for k in range(4)], PPM)


_EITHER = """QUERYNAME = Either; DEFINE x = 'C[30..60] H[30..120] O[2]' WITH CHG = +1, DBR = (0.5, 12.5); DEFINE y = 'C[20..50] H[20..100] N[1] O[3]' WITH CHG = +1, DBR = (0.5, 8.5);
IDENTIFY x IN MS1+ {} y IN MS1+ SUCHTHAT {} REPORT X = x.chemsc; Y = y.chemsc; OFF = "%.1f" % "(y.errppm)"; PART = x.intensity;;"""
_EITHER_SQL = (
    W
    + _LAT
    + _level_sql(1, "se")
    + """, m AS (SELECT c, h, 12.0 * c + 1.0078250321 * h + 14.0030740052 + 3 * 15.9949146221 AS m0, (2.0 + 2 * c - h + 1) / 2 AS dbr FROM range(20, 51) a(c), range(20, 101) b(h)),
x AS (SELECT id, c, h, s0, s1, s2, s3 FROM se JOIN ok ON abs(mz - mz1) <= mz * 20 / 1e6),
y AS (SELECT id, c, h, (mz - (m0 - 0.00055)) / mz * 1e6 AS err FROM se JOIN m ON abs(mz - (m0 - 0.00055)) <= mz * 20 / 1e6 WHERE dbr BETWEEN 0.5 AND 8.5 AND floor(m0)::BIGINT % 2 = 0)
SELECT coalesce(x.id, y.id) AS se_id, coalesce('C' || x.c || ' H' || x.h || ' O2', '') AS "X", coalesce('C' || y.c || ' H' || y.h || ' N1 O3', '') AS "Y", coalesce(printf('%.1f', err), '') AS "OFF",
coalesce(s0, 0) AS "PART:s0", coalesce(s1, 0) AS "PART:s1", coalesce(s2, 0) AS "PART:s2", coalesce(s3, 0) AS "PART:s3" FROM x FULL JOIN y ON x.id = y.id """
)
query("m03_either_mark", _EITHER_SQL + "WHERE y.c IS NULL OR y.c <= 40 OR x.c < 35")(lambda s, d: _single(s, d, _EITHER.format("OR", "NOT y.chemsc[C] > 40 OR x.chemsc[C] < 35")))
query("m03_absent_mark", _EITHER_SQL + "WHERE x.c > 0 AND y.c IS NULL")(lambda s, d: _single(s, d, _EITHER.format("AND NOT", "x.chemsc[C] > 0")))
query("k05_complement", W + _LAT + _level_sql(1, "se") + " SELECT id AS se_id FROM se WHERE NOT EXISTS (SELECT 1 FROM ok WHERE abs(se.mz - mz1) <= se.mz * 20 / 1e6)")(
    lambda s, d: identify.complement(_tables(s, d), [_single(s, d)]).select("se_id")
)
query("m08_tags", W + _LAT + _level_sql(1, "se") + """, hit AS (SELECT id AS se_id, 'C' || c || ' H' || h || ' O2' AS chemsc, c FROM se JOIN ok ON abs(mz - mz1) <= mz * 20 / 1e6)
SELECT se_id, chemsc, CASE WHEN c >= 40 THEN 'all,large' ELSE 'all' END AS tags FROM hit""")(
    lambda s, d: identify.with_tags({k: _single(s, d, t).select("se_id", F.col("F").alias("chemsc")) for k, t in (("all", _ONE), ("large", _ONE.replace("C[30..60]", "C[40..60]")))})
)


def queries() -> dict[str, Fn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
