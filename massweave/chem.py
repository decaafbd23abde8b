"""Sum compositions: parsing, masses, double bonds, and lattices of constraints."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Monoisotopic masses of the element symbols.
MASSES = {
    "C": 12.0,
    "H": 1.0078250321,
    "N": 14.0030740052,
    "P": 30.97376151,
    "O": 15.9949146221,
    "Na": 22.98976967,
    "S": 31.97207069,
    "I": 126.904477,
    "D": 2.0141017780,
    "Ci": 13.0033548378,
    "Cl": 34.968852,
    "Li": 7.016003,
    "Ni": 15.0001088984,
    "F": 18.9984032,
    "K": 38.963708,
    "Cs": 132.905433,
    "Br": 78.918336,
    "Ag": 106.905095,
    "Al": 26.981541,
    "W": 183.950952,
    "Ti": 47.947947,
}
# Mass of one positive charge, and what each element adds to twice the double bond equivalents less two.
ELECTRON = -0.00055
UNSATURATION = {"C": 2, "H": -1, "Cl": -1, "N": 1, "Na": -1, "P": 1, "D": -1, "Ci": 2, "Ni": 1, "F": -1, "I": 5, "K": -1, "Cs": -1, "Br": -1, "Li": -1}
ISOTOPE_LABELS = ("Ci", "Ni", "D")


@dataclass(frozen=True)
class Formula:
    """Element counts and a charge; counts of 0 are left out."""

    n: tuple[tuple[str, int], ...]
    charge: int = 0

    @staticmethod
    def of(counts: dict[str, int], charge: int = 0) -> Formula:
        return Formula(tuple((e, counts[e]) for e in MASSES if counts.get(e, 0)), charge)

    @property
    def counts(self) -> dict[str, int]:
        return dict(self.n)

    def mass(self) -> float:
        """m/z with the electron correction; without a charge the plain mass."""
        m = sum(MASSES[e] * c for e, c in self.n)
        return (m + self.charge * ELECTRON) / abs(self.charge) if self.charge else m

    def double_bonds(self) -> float:
        return (2 + sum(UNSATURATION.get(e, 0) * c for e, c in self.n)) / 2

    def __add__(self, other: Formula) -> Formula:
        return self._with(other, 1)

    def __sub__(self, other: Formula) -> Formula:
        return self._with(other, -1)

    def _with(self, other: Formula, sign: int) -> Formula:
        a, b = self.counts, other.counts
        return Formula.of({e: max(a.get(e, 0) + sign * b.get(e, 0), 0) for e in MASSES}, self.charge)

    def scaled(self, k: int) -> Formula:
        return Formula.of({e: c * k for e, c in self.n}, self.charge)

    def text(self) -> str:
        return " ".join(f"{e}{c}" for e, c in self.n)


@dataclass(frozen=True)
class Constraint:
    """Allowed counts of each element (sets, so gaps stay gaps), double bond bounds and a charge."""

    allowed: tuple[tuple[str, tuple[int, ...]], ...]
    dbr: tuple[float, float] | None = None
    charge: int = 0

    def covers(self, f: Formula) -> bool:
        want = dict(self.allowed)
        got = f.counts
        return all(e in want for e in got) and all(got.get(e, 0) in v for e, v in want.items())

    def fixed(self) -> Formula | None:
        """The one formula of a constraint without ranges."""
        if all(len(v) == 1 for _, v in self.allowed):
            return Formula.of({e: v[0] for e, v in self.allowed}, self.charge)
        return None


_ELEMENT = re.compile(r"\s*([A-Z][a-z]?)\s*(?:\[\s*([^\]]*)\]|(\d+))?")


def parse(text: str) -> Constraint:
    """``C[30..48] H[2,4] O8 db(1,8) chg(-1)``; a bare symbol counts one."""
    db = re.search(r"db\(\s*([-+.\d]+)\s*,\s*([-+.\d]+)\s*\)", text, re.I)
    chg = re.search(r"chg\(\s*([-+]?\d+)\s*\)", text, re.I)
    body = re.sub(r"(?:db|chg)\([^)]*\)", " ", text, flags=re.I).strip()
    allowed: dict[str, tuple[int, ...]] = {}
    at = 0
    while at < len(body):
        m = _ELEMENT.match(body, at)
        # Two-letter symbols win if they are elements; else the first letter stands alone.
        if not m:
            raise ValueError(f"no element at {body[at:]!r}")
        sym = m.group(1)
        if sym not in MASSES:
            if sym[0] not in MASSES:
                raise ValueError(f"unknown element {sym!r}")
            m = re.compile(r"\s*([A-Z])\s*(?:\[\s*([^\]]*)\]|(\d+))?").match(body, at)
            sym = m.group(1)
        if m.group(2) is not None:
            counts: list[int] = []
            for part in m.group(2).split(","):
                lo, _, hi = part.partition("..")
                counts += range(int(lo), int(hi or lo) + 1)
        else:
            counts = [int(m.group(3) or 1)]
        allowed[sym] = tuple(sorted(set(counts)))
        at = m.end()
        while at < len(body) and body[at].isspace():
            at += 1
    bounds = (float(db.group(1)), float(db.group(2))) if db else None
    return Constraint(tuple((e, allowed[e]) for e in MASSES if e in allowed), bounds, int(chg.group(1)) if chg else 0)


def parse_formula(text: str) -> Formula:
    f = parse(text).fixed()
    if f is None:
        raise ValueError(f"{text!r} has ranges")
    return f


def mass_column(counts: dict[str, Column], charge: Column | int) -> Column:
    """m/z of element-count columns."""
    z = charge if isinstance(charge, Column) else F.lit(charge)
    m = F.lit(0.0)
    for e, c in counts.items():
        m = m + c * F.lit(MASSES[e])
    return F.when(z == 0, m).otherwise((m + z * ELECTRON) / F.abs(F.when(z == 0, F.lit(1)).otherwise(z)))


def dbr_column(counts: dict[str, Column]) -> Column:
    d = F.lit(2.0)
    for e, c in counts.items():
        d = d + c * F.lit(float(UNSATURATION.get(e, 0)))
    return d / 2


def text_column(counts: dict[str, Column]) -> Column:
    """Canonical text of a formula; elements with count 0 are left out."""
    return F.concat_ws(" ", *[F.when(counts[e] != 0, F.concat(F.lit(e), counts[e].cast("string"))) for e in MASSES if e in counts])


def parity_column(counts: dict[str, Column], charge: int, mass: Column) -> Column:
    """Nominal-mass parity against charge and nitrogen; waived for many hydrogens and labelled atoms."""
    zero = F.lit(0)
    n = counts.get("N", zero)
    plain = F.floor(F.abs(mass)) % 2 == (F.lit(abs(charge) % 2) + n % 2) % 2
    waived = counts.get("H", zero) + counts.get("D", zero) > 127
    for e in ISOTOPE_LABELS:
        if e in counts:
            waived = waived | (counts[e] > 0)
    return plain | waived


def lattice(spark: SparkSession, c: Constraint, parity: bool = True) -> DataFrame:
    """All formulas of a constraint: one INT column per element, chemsc, charge, mz, dbr.

    The lattice is generated by exploding the allowed counts, so its size is a property
    of the query and not of the data.
    """
    df = spark.range(1).select()
    for e, values in c.allowed:
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(e))
    n = {e: F.col(e) for e, _ in c.allowed}
    df = df.select("*", text_column(n).alias("chemsc"), F.lit(c.charge).alias("charge"), mass_column(n, c.charge).alias("mz"), dbr_column(n).alias("dbr"))
    if c.dbr is not None:
        df = df.where(F.col("dbr").between(*c.dbr))
    if parity and len([1 for _, v in c.allowed if len(v) > 1]):
        whole = F.lit(0.0)
        for e, col in n.items():
            whole = whole + col * F.lit(MASSES[e])
        df = df.where(parity_column(n, c.charge, whole))
    return df


def lattice_of(df: DataFrame, ranges: dict[str, tuple[Column, Column]], charge: int = 0, dbr: tuple[float, float] | None = None, parity: bool = True) -> DataFrame:
    """m09 over a table of constraints: the rows of ``df`` with every formula of their own ranges of counts (both ends
    included): one column per element, chemsc, mz and dbr."""
    for e, (lo, hi) in ranges.items():
        df = df.where(lo <= hi).withColumn(e, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    n = {e: F.col(e) for e in ranges}
    df = df.withColumns({"chemsc": text_column(n), "mz": mass_column(n, charge), "dbr": dbr_column(n)})
    if dbr is not None:
        df = df.where(F.col("dbr").between(*dbr))
    return df.where(parity_column(n, charge, mass_column(n, 0))) if parity else df


@dataclass
class Tolerance:
    """A window as a function of mass: Da, ppm, or resolution with a slope."""

    kind: str
    value: float
    delta: float = 0.0
    smallest: float = 0.0
    extra: dict = field(default_factory=dict)

    def width(self, mass: Column) -> Column:
        if self.kind == "da":
            return F.lit(float(self.value))
        if self.kind == "ppm":
            return mass * F.lit(self.value / 1e6)
        return mass / ((mass - F.lit(self.smallest)) * F.lit(self.delta) + F.lit(float(self.value)))

    def width_of(self, mass):
        if self.kind == "da":
            return mass * 0 + self.value
        if self.kind == "ppm":
            return mass * (self.value / 1e6)
        return mass / ((mass - self.smallest) * self.delta + self.value)

    def most(self, largest: float) -> float:
        """An upper bound of the width up to a mass."""
        return max(float(self.width_of(largest)), float(self.width_of(self.smallest or 1.0)))

    def fits(self, experimental: Column, theoretical: Column) -> Column:
        """Inclusive; the window is sized from the experimental mass."""
        return F.abs(experimental - theoretical) <= self.width(experimental)
