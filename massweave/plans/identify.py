"""Compiler of parsed queries: targets, marks, bindings, conditions and reports as DataFrames.

Tables: survey (se_id, mz, polarity), survey_long (se_id, sample, i), frag (fr_id, mz,
polarity), frag_long (fr_id, sample, i), and what belongs together: survey_frag (se_id,
fr_id), or survey_scans (se_id, scan_id) and frag_scans (fr_id, scan_id), which are joined
after both levels are marked.  The long tables hold observed values, one for each entry and
sample; a sample that lacks an entry counts as 0.0 in every function and condition.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem import MASSES, Constraint, Formula, Tolerance, lattice
from ..functions import scalar
from ..operators import filters, isotope
from ..operators.aggregates import drop_permutations
from ..operators.intervals import interval_join, neutral_loss_join
from ..scratch import materialise
from .lang import Node, Query, QueryError, Variable


@dataclass
class Tables:
    survey: DataFrame
    survey_long: DataFrame
    frag: DataFrame
    frag_long: DataFrame
    survey_frag: DataFrame | None = None
    largest: float = 2000.0
    survey_scans: DataFrame | None = None
    frag_scans: DataFrame | None = None

    def samples(self) -> list[str]:
        """Names of all samples (metadata of the study: one for each file)."""
        names = self.survey_long.select("sample").unionByName(self.frag_long.select("sample")).distinct()
        return sorted(r[0] for r in names.collect())

    def below(self, gate: DataFrame | None, frags: DataFrame) -> DataFrame:
        """(se_id, fr_id, prec_mz) of the fragments ``frags`` under entries of ``gate`` (none: under all)."""
        pruned = lambda t: t if gate is None else t.join(gate, "se_id", "left_semi")
        if self.survey_frag is not None:
            pairs = pruned(self.survey_frag).join(frags.select("fr_id").distinct(), "fr_id", "left_semi")
        else:
            pairs = pruned(self.survey_scans).join(self.frag_scans.join(frags.select("fr_id").distinct(), "fr_id", "left_semi"), "scan_id").select("se_id", "fr_id").distinct()
        return pairs.join(self.survey.select("se_id", F.col("mz").alias("prec_mz")), "se_id")


def targets(spark: SparkSession, v: Variable) -> DataFrame:
    """Formulas of a variable: chemsc, target_mz, dbr and an INT column per element."""
    charge = v.charge if v.charge is not None else 0
    if isinstance(v.target, list):
        allowed = [Formula(f.n, charge) for f in v.target]
        rows = [(f.text(), f.mass(), f.double_bonds(), *[f.counts.get(e, 0) for e in MASSES]) for f in allowed]
        return spark.createDataFrame(rows, "chemsc string, target_mz double, dbr double, " + ", ".join(f"n_{e} int" for e in MASSES))
    if not isinstance(v.target, Constraint):
        raise QueryError(f"{v.name} is a number; a scan needs a formula")
    c = Constraint(v.target.allowed, v.options.get("DBR", v.target.dbr), charge)
    df = lattice(spark, c)
    have = {e for e, _ in c.allowed}
    return df.select("chemsc", F.col("mz").alias("target_mz"), "dbr", *[(F.col(e) if e in have else F.lit(0)).alias(f"n_{e}") for e in MASSES])


def _tolerance(v: Variable, default: Tolerance) -> Tolerance:
    t = v.options.get("TOLERANCE")
    return Tolerance(t[1], t[0]) if t else default


def marks(q: Query, t: Tables, tol: Tolerance, tol2: Tolerance, samples: list[str] | None = None) -> dict[str, DataFrame]:
    """Hits of every variable: se_id, a struct of mz, chemsc, dbr, n_*, errppm, occ, isobaric, scope and intensity as a map of all samples.

    TOLERANCE, MASSRANGE, MINOCC and MAXOCC of a variable hold on either level; a variable with several
    scopes has the hits of all of them.  Fragments count only below entries that some MS1 variable of this
    query marks, if it has one.
    """
    spark = t.survey.sparkSession
    samples = t.samples() if samples is None else samples
    s_map, f_map = _maps(t.survey_long, "se_id", samples), _maps(t.frag_long, "fr_id", samples)
    parts: dict[str, list[DataFrame]] = {name: [] for name in q.scopes}

    def limited(v: Variable, d: DataFrame) -> DataFrame:
        return d.where(F.col("mz").between(*v.options["MASSRANGE"])) if "MASSRANGE" in v.options else d

    def finished(v: Variable, hit: DataFrame, measured: str, level: int, sign: int) -> DataFrame:
        factor = float(abs(v.charge or 1))
        off = F.col(measured) - F.col("target_mz")
        d = hit.withColumns({"errppm": off / F.col("mz") * F.lit(1e6 * factor), "errda": off * F.lit(factor), "level": F.lit(level), "polarity": F.lit(sign)})
        positive = F.aggregate(F.map_values("intensity"), F.lit(0.0), lambda a, x: a + (x > 0).cast("double"))
        d = d.withColumn("occ", positive / F.lit(float(max(len(samples), 1))))
        return d.where(F.col("occ").between(v.options.get("MINOCC", 0.0), v.options.get("MAXOCC", 1.0)))

    every = [(name, level, sign) for name, scopes in q.scopes.items() for level, sign in scopes]
    for name, level, sign in every:
        v = q.variables[name]
        if level == 1:
            s = limited(v, t.survey.where(F.col("polarity") == sign).select("se_id", "mz"))
            parts[name].append(finished(v, interval_join(s, targets(spark, v), _tolerance(v, tol), t.largest).join(s_map, "se_id"), "mz", level, sign))
    gate = None
    for d in (d for found in parts.values() for d in found):
        ids = d.select("se_id").distinct()
        gate = ids if gate is None else gate.unionByName(ids).distinct()
    for name, level, sign in every:
        v = q.variables[name]
        if level == 1:
            continue
        f = limited(v, t.frag.where(F.col("polarity") == sign).select("fr_id", "mz"))
        if v.neutral_loss:
            hit = neutral_loss_join(f.join(t.below(gate, f), "fr_id"), targets(spark, v), _tolerance(v, tol2), t.largest)
        else:
            hit = interval_join(f, targets(spark, v), _tolerance(v, tol2), t.largest)
            hit = hit.join(t.below(gate, hit), "fr_id")
        parts[name].append(finished(v, hit.join(f_map, "fr_id"), "nl_mz" if v.neutral_loss else "mz", level, sign))
    out = {name: functools.reduce(lambda a, b: a.unionByName(b, True), found) for name, found in parts.items()}
    if _mentions(q, "isobaric"):
        # Marks of other variables of the query at the very same measured mass.
        names = None
        for k, d in out.items():
            one = d.select("mz", F.lit(k).alias("_name")).distinct()
            names = one if names is None else names.unionByName(one)
        names = names.groupBy("mz").agg(F.array_sort(F.collect_set("_name")).alias("_all"))
        out = {k: d.join(names, "mz").withColumn("isobaric", F.array_join(F.array_remove("_all", k), " @ ")).drop("_all") for k, d in out.items()}
    else:
        out = {k: d.withColumn("isobaric", F.lit("")) for k, d in out.items()}
    return {k: d.select("se_id", F.struct(*[c for c in d.columns if c != "se_id"]).alias(k)) for k, d in out.items()}


def without_overlap(q: Query, found: dict[str, DataFrame], tol: Tolerance, tol2: Tolerance) -> dict[str, DataFrame]:
    """i03, i05, i07: marks with intensities less the isotopes of other marks of their polarity.

    An entry that several formulas mark counts with their mean composition.  Fragments are corrected below entries that an
    MS1 variable marks, since what the precursor lost is known there.  Used up intensities are 0, and
    MINOCC and MAXOCC hold again afterwards.
    """
    elements = list(isotope.ABUNDANCE)
    of_level = lambda n: [x for x in found if n in levels(q, x)]
    at_level = lambda x, n: found[x].where(F.col(f"{x}.level") == n)
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    mean = lambda c: F.round(F.avg(c)).cast("int").alias(c)

    def patterned(df: DataFrame, prefix: str, name: str) -> DataFrame:
        cols = {e: f"{prefix}{e}" for e in elements}
        p = isotope.patterns(df.sparkSession, df.select(*cols.values()), cols).withColumnRenamed("pattern", name)
        return df.join(p, list(cols.values()))

    def settled(fixed: DataFrame, key: list[str]) -> DataFrame:
        return fixed.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("sample", F.greatest("corrected", F.lit(0.0)).alias("i")))).alias("_i"))

    def replaced(name: str, d: DataFrame, level: int) -> DataFrame:
        old = F.col(f"{name}.intensity")
        held = F.when(F.col(f"{name}.level") == level, F.coalesce("_i", old)).otherwise(old)
        share = F.aggregate(F.map_values(held), F.lit(0.0), lambda a, x: a + (x > 0).cast("double")) / F.greatest(F.size(held), F.lit(1))
        options = q.variables[name].options
        out = d.select("se_id", F.col(name).withField("intensity", held).withField("occ", share).alias(name))
        return out.where(F.col(f"{name}.occ").between(options.get("MINOCC", 0.0), options.get("MAXOCC", 1.0)))

    out = dict(found)
    if not of_level(1):
        return out
    rows = union([at_level(x, 1).select("se_id", f"{x}.polarity", f"{x}.mz", *[F.col(f"{x}.n_{e}").alias(f"n_{e}") for e in elements], f"{x}.intensity") for x in of_level(1)])
    entries = rows.groupBy("se_id", "polarity").agg(F.first("mz").alias("mz"), F.first("intensity").alias("intensity"), *[mean(f"n_{e}") for e in elements])
    entries = materialise(entries, "entries")
    long = patterned(entries, "n_", "pattern").select("se_id", "polarity", "mz", "pattern", F.explode("intensity").alias("sample", "i"))
    fixed = materialise(settled(isotope.correct(long, tol, ["polarity"]), ["se_id"]), "corrected")
    for x in of_level(1):
        out[x] = replaced(x, found[x].join(fixed, "se_id", "left"), 1)
    if of_level(2):
        parts = []
        for x in of_level(2):
            own = at_level(x, 2).join(entries.select("se_id", *[F.col(f"n_{e}").alias(f"p_{e}") for e in elements]), "se_id")
            other = {e: F.greatest(F.col(f"p_{e}") - F.col(f"{x}.n_{e}"), F.lit(0)) for e in elements}
            mine = {e: F.col(f"{x}.n_{e}") for e in elements}
            fragment, loss = (other, mine) if q.variables[x].neutral_loss else (mine, other)
            parts.append(own.select("se_id", f"{x}.fr_id", f"{x}.polarity", f"{x}.prec_mz", f"{x}.mz", f"{x}.intensity", *[fragment[e].alias(f"f_{e}") for e in elements], *[loss[e].alias(f"l_{e}") for e in elements]))
        frags = union(parts).groupBy("se_id", "fr_id", "polarity", "prec_mz", "mz").agg(F.first("intensity").alias("intensity"), *[mean(f"{k}_{e}") for k in "fl" for e in elements])
        frags = patterned(patterned(frags, "f_", "fragment"), "l_", "loss").select("se_id", "fr_id", "polarity", "prec_mz", "mz", "fragment", "loss", F.explode("intensity").alias("sample", "i"))
        fixed = materialise(settled(isotope.correct_msms(frags, tol2, ["polarity"], tol), ["se_id", "fr_id"]), "corrected")
        for x in of_level(2):
            at = out[x].withColumn("fr_id", F.col(f"{x}.fr_id"))
            out[x] = replaced(x, at.join(fixed, ["se_id", "fr_id"], "left"), 2)
    return out


def _mentions(q: Query, attribute: str) -> bool:
    def seen(n: Node | None) -> bool:
        return n is not None and ((n.kind == "attr" and n.value[1] == attribute) or any(seen(x) for x in n.args or []))

    return seen(q.suchthat) or any(seen(e) for item in q.report for e in item.exprs)


def _maps(long: DataFrame, key: str, samples: list[str]) -> DataFrame:
    """Intensities of each key as a map of all samples, 0.0 where one lacks it."""
    held = long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("sample", "i"))).alias("_m"))
    names = F.array(*[F.lit(x) for x in samples]) if samples else F.array().cast("array<string>")
    return held.select(key, F.map_from_arrays(names, F.transform(names, lambda x: F.coalesce(F.try_element_at("_m", x), F.lit(0.0)))).alias("intensity"))


def _presence(n: Node) -> Column:
    """Truth of the mark algebra of an entry from has_<variable> columns."""
    if n.kind == "var":
        return F.col(f"has_{n.value}")
    a = _presence(n.args[0])
    if n.kind == "not":
        return ~a
    b = _presence(n.args[1])
    return {"and": a & b, "iff": a & b, "or": a | b, "implies": a | b, "arrow": a, "back": b}[n.kind]


def levels(q: Query, name: str) -> set[int]:
    """MS levels of the scopes of a variable."""
    return {level for level, _ in q.scopes[name]}


def required(q: Query) -> set[str]:
    """Variables that every binding has: all if there is no SUCHTHAT (m07), else those without which IDENTIFY can't hold."""

    def need(n: Node) -> set[str]:
        if n.kind in ("var", "not"):
            return {n.value} if n.kind == "var" else set()
        a, b = (need(x) for x in n.args)
        return {"and": a | b, "iff": a | b, "or": a & b, "implies": a & b, "arrow": a, "back": b}[n.kind]

    return set(q.scopes) if q.suchthat is None else need(q.identify)


def bindings(q: Query, marked: dict[str, DataFrame]) -> DataFrame:
    """One row per combination of hits of an entry that IDENTIFY accepts, a struct per variable (null: it has no hit).

    IDENTIFY is decided for each entry on presence bits before hits are combined.  Without SUCHTHAT a
    binding is complete; with it, variables that IDENTIFY does not require may be absent.
    """
    names, must = list(q.scopes), required(q)
    if must == set(names):
        out = functools.reduce(lambda a, b: a.join(b, "se_id"), [marked[n] for n in names])
        flags = out.withColumns({f"has_{n}": F.lit(True) for n in names})
        return flags.where(_presence(q.identify)).drop(*[f"has_{n}" for n in names])
    marked = {n: materialise(d, "marks") for n, d in marked.items()}
    seen = functools.reduce(DataFrame.unionByName, [marked[n].select("se_id", F.lit(n).alias("_v")) for n in names])
    bits = seen.groupBy("se_id").agg(*[F.max(F.col("_v") == n).alias(f"has_{n}") for n in names])
    out = bits.where(_presence(q.identify)).select("se_id")
    for n in names:
        out = out.join(marked[n], "se_id", "inner" if n in must else "left")
    return out


@dataclass
class Typed:
    col: Column
    kind: str  # num, str, bool, map, chem, constraint
    counts: dict[str, Column] | None = None
    chosen: bool = False
    constraint: Constraint | None = None


class Compiler:
    """Expressions over bindings to typed Columns."""

    def __init__(self, q: Query, accuracy_ppm: float = 5.0):
        self.q, self.accuracy = q, accuracy_ppm
        self.optional = set(q.scopes) - required(q)

    def present(self, *nodes: Node) -> Column | None:
        """Whether a binding has all the variables that the expressions read (None: it always has)."""
        used: set[str] = set()

        def visit(n: Node) -> None:
            name, a = n.value if n.kind == "attr" else (n.value if n.kind == "var" else None, "")
            used.update({name} & self.optional)
            if a in ("frsc", "nlsc") and name in self.q.scopes:
                used.update({self.precursor(name)} & self.optional)
            for x in n.args or []:
                visit(x)

        for n in nodes:
            visit(n)
        return functools.reduce(Column.__and__, [F.col(n).isNotNull() for n in sorted(used)]) if used else None

    def precursor(self, name: str) -> str | None:
        """The first other variable on the first level."""
        return next((n for n in self.q.scopes if n != name and 1 in levels(self.q, n)), None)

    def chem(self, f: Formula) -> Typed:
        return Typed(F.lit(f.mass()), "chem", {e: F.lit(f.counts.get(e, 0)) for e in MASSES})

    def expr(self, n: Node) -> Typed:
        if n.kind == "num":
            return Typed(F.lit(n.value), "num")
        if n.kind == "str":
            return Typed(F.lit(n.value), "str")
        if n.kind == "formula":
            f = n.value.fixed()
            return self.chem(f) if f else Typed(F.lit(None).cast("double"), "constraint", None, False, n.value)
        if n.kind == "neg":
            a = self.expr(n.args[0])
            return Typed(-a.col, "num")
        if n.kind == "var":
            return self.attr(n.value, "chemsc")
        if n.kind == "attr":
            return self.attr(*n.value)
        if n.kind == "item":
            a = self.expr(n.args[0])
            if a.kind == "chem":
                if n.value.lower() == "db":
                    return Typed(self.dbr(a.counts), "num")
                sym = next((e for e in MASSES if e.lower() == n.value.lower()), None)
                if sym is None:
                    raise QueryError(f"unknown element {n.value}")
                return Typed(a.counts[sym].cast("double"), "num")
            return Typed(filters.select_glob(a.col, n.value), "map", None, True)
        if n.kind == "bin":
            return self.arith(n.value, self.expr(n.args[0]), self.expr(n.args[1]))
        if n.kind == "call":
            return self.call(n.value, [self.expr(a) for a in n.args], n.args)
        return Typed(self.cond(n), "bool")

    def dbr(self, counts: dict[str, Column]) -> Column:
        from ..chem import dbr_column

        return dbr_column(counts)

    def attr(self, var: str, a: str) -> Typed:
        if var not in self.q.variables:
            raise QueryError(f"unknown variable {var}")
        f = lambda x: F.col(f"{var}.{x}")
        if a in ("chemsc", "sc"):
            return Typed(f("target_mz"), "chem", {e: f(f"n_{e}") for e in MASSES})
        if a in ("intensity", "exactintensity"):
            return Typed(f("intensity"), "map")
        if a in ("errppm", "error"):
            return Typed(f("errppm"), "num")
        if a == "errda":
            return Typed(f("errda"), "num")
        if a == "errres":
            return Typed(F.when(f("errppm") == 0, F.lit(1e6)).otherwise(scalar.divide(F.lit(1e6), f("errppm"))), "num")
        if a == "mass":
            return Typed(f("mz"), "num")
        if a == "charge":
            return Typed(F.lit(float(self.q.variables[var].charge or 0)), "num")
        if a == "occ":
            return Typed(f("occ"), "num")
        if a == "name":
            return Typed(F.lit(self.q.name), "str")
        if a == "isobaric":
            return Typed(f("isobaric"), "str")
        if a in ("frsc", "nlsc", "frmass", "nlmass") and 2 in levels(self.q, var):
            mine = self.attr(var, "chemsc").counts
            first = self.precursor(var)
            same = self.q.variables[var].neutral_loss == a.startswith("nl")
            if a.endswith("mass"):
                return Typed(f("mz") if self.q.variables[var].neutral_loss == a.startswith("nl") and a == "frmass" else F.when(F.lit(a == "frmass"), f("mz")).otherwise(f("prec_mz") - f("mz")), "num")
            if same or first is None:
                return Typed(f("target_mz"), "chem", mine)
            prec = self.attr(first, "chemsc").counts
            diff = {e: F.greatest(prec[e] - mine[e], F.lit(0)) for e in MASSES}
            from ..chem import mass_column

            return Typed(mass_column(diff, 0), "chem", diff)
        raise QueryError(f"unknown attribute {a}")

    def arith(self, op: str, a: Typed, b: Typed) -> Typed:
        if a.kind == "chem" and b.kind == "chem":
            if op not in "+-":
                raise QueryError("formulas can be added and subtracted only")
            n = {e: (a.counts[e] + b.counts[e]) if op == "+" else F.greatest(a.counts[e] - b.counts[e], F.lit(0)) for e in MASSES}
            from ..chem import mass_column

            return Typed(mass_column(n, 0), "chem", n)
        if a.kind == "map" and b.kind == "map":
            return Typed(scalar.map_map(op, a.col, b.col), "map")
        if a.kind == "map":
            return Typed(scalar.map_num(op, a.col, b.col), "map")
        if b.kind == "map":
            return Typed(scalar.map_num(op, b.col, a.col, True), "map")
        return Typed(scalar.arith(op, a.col, b.col), "num")

    def call(self, name: str, args: list[Typed], nodes: list[Node]) -> Typed:
        cols = [a.col for a in args]
        one_map = len(args) == 1 and args[0].kind == "map"
        if name == "avg":
            return Typed(scalar.map_average(cols[0]) if one_map else scalar.average(*cols), "num")
        if name in ("medianu", "medianl"):
            v = F.map_values(cols[0]) if one_map else F.array(*cols)
            return Typed((scalar.median_upper if name == "medianu" else scalar.median_lower)(v), "num")
        if name == "abs":
            return Typed(scalar.map_abs(cols[0]), "map") if one_map else Typed(F.abs(cols[0]), "num")
        if name == "sumintensity":
            return Typed(scalar.sum_intensity(*[a.col if a.kind == "map" else self.attr(n.value, "intensity").col for a, n in zip(args, nodes, strict=True)]), "map")
        if name == "column":
            m = args[0].col if args[0].kind == "map" else self.attr(nodes[0].value, "intensity").col
            return Typed(filters.select_regex(m, str(nodes[1].value)), "map", None, True)
        if name == "score":
            return Typed(scalar.score(self.accuracy, *[self.attr(n.value, "errppm").col for n in nodes]), "str")
        if name == "nbsmpls":
            return Typed(F.size(F.coalesce(*[self.attr(n, "intensity").col for n in self.q.scopes])).cast("double"), "num")
        whole = {"iseven": scalar.is_even, "isodd": scalar.is_odd}
        if name in whole:
            return Typed(whole[name](cols[0]), "bool")
        if name in ("isevennominal", "isoddnominal"):
            return Typed(whole["is" + name[2:-7]](F.floor(cols[0])), "bool")
        raise QueryError(f"unknown function {name}")

    def cond(self, n: Node) -> Column:
        """A condition; a comparison or call that reads an absent variable does not hold."""
        if n.kind in ("and", "or", "not"):
            a = [F.coalesce(self.cond(x), F.lit(False)) for x in n.args]
            return ~a[0] if n.kind == "not" else a[0] & a[1] if n.kind == "and" else a[0] | a[1]
        held = self._holds(n)
        given = self.present(n)
        return held if given is None else given & held

    def _holds(self, n: Node) -> Column:
        if n.kind != "cmp":
            t = self.expr(n)
            if t.kind != "bool":
                raise QueryError("a condition is expected")
            return F.coalesce(t.col, F.lit(False))
        op, tol = n.value if isinstance(n.value, tuple) else (n.value, None)
        a, b = self.expr(n.args[0]), self.expr(n.args[1])
        if b.kind == "constraint" or a.kind == "constraint":
            x, c = (a, b) if b.kind == "constraint" else (b, a)
            return filters.contained(x.counts, dict(c.constraint.allowed))
        if op == "<>":
            return ~self._compare("==", a, b, tol)
        return self._compare(op, a, b, tol)

    def _compare(self, op: str, a: Typed, b: Typed, tol) -> Column:
        flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}
        if a.kind == "map" and b.kind == "map":
            return filters.both_of(a.col, b.col, op, a.chosen or b.chosen)
        if a.kind == "map":
            return filters.all_of(a.col, op, b.col)
        if b.kind == "map":
            return filters.all_of(b.col, flip[op], a.col)
        if a.kind == "chem" and b.kind == "chem" and op == "==":
            same = F.lit(True)
            for e in MASSES:
                same = same & (a.counts[e] == b.counts[e])
            return same
        x, y = a.col, b.col
        if a.kind == "num" and b.kind == "chem" and op != "==":
            x, y = y, x  # a number against a formula compares the other way round
        if tol is not None and op == "==":
            return Tolerance(tol[1], tol[0]).fits(x, y)
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y}[op]


def run(q: Query, t: Tables, samples: list[str] | None, tol: Tolerance, tol2: Tolerance | None = None, permutations: bool = True, isotopes: bool = False) -> DataFrame:
    """The report of a query: one row per binding that SUCHTHAT keeps; map items give a column per sample.

    With ``isotopes`` the overlap of isotopes is subtracted from the marks before they are bound (:func:`without_overlap`).

    samples: all of the study (None: those of the tables).  Without ``permutations`` only the best
    of the bindings of an entry with the same compositions stays.  An item that reads an absent variable
    is an empty text, null for a number, 0.0 for the samples of a map.
    """
    samples = t.samples() if samples is None else samples
    comp = Compiler(q)
    found = marks(q, t, tol, tol2 or tol, samples)
    b = bindings(q, without_overlap(q, found, tol, tol2 or tol) if isotopes else found)
    if q.suchthat is not None:
        b = b.where(F.coalesce(comp.cond(q.suchthat), F.lit(False)))
    if not permutations:
        b = without_permutations(b, list(q.scopes))
    cols = []
    for item in q.report:
        given = comp.present(*item.exprs)
        or_empty = lambda c, given=given: c if given is None else F.when(given, c).otherwise("")
        if item.fmt is not None:
            ex = [comp.expr(e) for e in item.exprs]
            cols.append(or_empty(scalar.printf(item.fmt, [(e.col, e.kind) for e in ex]) if ex else F.lit(item.fmt)).alias(item.name))
            continue
        e = comp.expr(item.exprs[0])
        if e.kind == "map":
            cols += [F.coalesce(F.try_element_at(e.col, F.lit(s)), F.lit(0.0)).alias(f"{item.name}:{s}") for s in samples]
        elif e.kind == "chem":
            text = F.concat_ws(" ", *[F.when(e.counts[x] != 0, F.concat(F.lit(x), e.counts[x].cast("string"))) for x in MASSES])
            cols.append(or_empty(text).alias(item.name))
        else:
            cols.append((or_empty(e.col) if e.kind == "str" else e.col if given is None else F.when(given, e.col)).alias(item.name))
    return b.select("se_id", *cols)


def without_permutations(b: DataFrame, names: list[str]) -> DataFrame:
    """i11: of an entry's bindings with the same compositions that whose marks have the most intensity per error."""
    positive = lambda n: F.filter(F.map_values(f"{n}.intensity"), lambda v: v > 0)
    mean = lambda n: F.when(F.size(positive(n)) > 0, F.aggregate(positive(n), F.lit(0.0), lambda a, v: a + v) / F.size(positive(n))).otherwise(F.lit(0.0))
    score = sum((mean(n) / F.greatest(F.lit(1.0), F.abs(F.col(f"{n}.errppm"))) for n in names), F.lit(0.0))
    d = b.withColumn("_set", F.array_sort(F.array(*[F.col(f"{n}.chemsc") for n in names])))
    order = F.concat_ws("|", *[F.concat_ws("/", F.col(f"{n}.chemsc"), F.col(f"{n}.mz").cast("string")) for n in names])
    return drop_permutations(d.withColumn("_o", order), ["se_id", "_set"], score, "_o").drop("_set", "_o")


def with_tags(results: dict[str, DataFrame], entry: str = "se_id", composition: str = "chemsc") -> DataFrame:
    """m08: one row per entry and composition over all queries, with the sorted names of the queries that found it."""
    every = None
    for name, r in results.items():
        one = r.select(entry, composition, F.lit(name).alias("_q"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(entry, composition).agg(F.array_join(F.array_sort(F.collect_set("_q")), ",").alias("tags"))


def complement(t: Tables, results: list[DataFrame]) -> DataFrame:
    """j10, k05: entries that no query reports."""
    out = t.survey
    for r in results:
        out = out.join(r.select("se_id"), "se_id", "left_anti")
    return out


def mass_bounds(spark: SparkSession, q: Query) -> dict[int, tuple[float, float]]:
    """i16: least and largest target mass per MS level, for pruning at import."""
    out: dict[int, tuple[float, float]] = {}
    for name in q.scopes:
        r = targets(spark, q.variables[name]).agg(F.min("target_mz"), F.max("target_mz")).first()
        for level in levels(q, name) if r[0] is not None else ():
            lo, hi = out.get(level, (r[0], r[1]))
            out[level] = (min(lo, r[0]), max(hi, r[1]))
    return out
