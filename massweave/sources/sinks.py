"""k01-k08: reports, dumps and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_results(results: dict[str, DataFrame]) -> DataFrame:
    """k08, u01: all results in one table with the query's name; missing columns are null."""
    parts = [df.withColumn("query", F.lit(name)) for name, df in sorted(results.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def report_lines(results: dict[str, DataFrame], sep: str = ",", compress: bool = False, head: bool = True) -> DataFrame:
    """k01: (ord1, ord2, line): head with the union of columns, a separator for each query, its rows in the order they have."""
    cols = list(dict.fromkeys(c for _, df in sorted(results.items()) for c in df.columns))
    parts = []
    for n, (name, df) in enumerate(sorted(results.items())):
        if not compress:
            parts.append(df.sparkSession.range(1).select(F.lit(n).alias("ord1"), F.lit(0).cast("long").alias("ord2"), F.lit(f"###,{name}").alias("line")))
        line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in cols])
        parts.append(df.select(F.lit(n).alias("ord1"), (F.monotonically_increasing_id() + 1).alias("ord2"), line.alias("line")))
    if head:
        spark = next(iter(results.values())).sparkSession
        parts.insert(0, spark.range(1).select(F.lit(-1).alias("ord1"), F.lit(0).cast("long").alias("ord2"), F.lit(sep.join(cols)).alias("line")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_report(results: dict[str, DataFrame], path: str, sep: str = ",") -> None:
    """k01: text files that, read in order of their names, are the report."""
    report_lines(results, sep).orderBy("ord1", "ord2").select("line").write.text(path)


def dump(survey_long: DataFrame, frag_long: DataFrame, bridge: DataFrame) -> DataFrame:
    """k02: survey rows and below each its fragments, long form, ordered by mass."""
    ms1 = survey_long.select("se_id", F.lit(1).alias("level"), F.col("mz"), "sample", "i", F.col("mz").alias("se_mz"))
    mz = survey_long.select("se_id", F.col("mz").alias("se_mz")).distinct()
    ms2 = bridge.join(frag_long, "fr_id").join(mz, "se_id").select("se_id", F.lit(2).alias("level"), "mz", "sample", "i", "se_mz")
    return ms1.unionByName(ms2)


def flat_dump(survey_long: DataFrame, marks: DataFrame) -> DataFrame:
    """k03: survey rows with their marks, one row each; rows without a mark stay."""
    return survey_long.join(marks, "se_id", "left")


def mztab_lines(report: DataFrame, title: str, specie: str, mass: str, formula: str, abundances: list[str]) -> DataFrame:
    """k06: (ord, line) of an mzTab-M text with metadata and small-molecule sections."""
    spark = report.sparkSession
    meta = [("mzTab-version", "2.0.0-M"), ("mzTab-ID", title), ("title", title), *[(f"assay[{k}]", a) for k, a in enumerate(abundances, 1)]]
    top = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f"MTD\t{a}\t{b}").alias("line")) for k, (a, b) in enumerate(meta)])).alias("x")).select("x.ord", "x.line")
    head = "\t".join(["SMH", "SML_ID", "chemical_name", "chemical_formula", "theoretical_neutral_mass", *[f"abundance_assay[{k}]" for k in range(1, len(abundances) + 1)]])
    mid = spark.range(1).select(F.lit(1000).alias("ord"), F.lit(head).alias("line"))
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    body = report.select(F.lit(1001).alias("ord"), F.concat_ws("\t", F.lit("SML"), null(specie), null(specie), null(formula), null(mass), *[null(f"`{a}`") for a in abundances]).alias("line"))
    return top.unionByName(mid).unionByName(body)


def html_report(options: dict[str, object], queries: dict[str, str]) -> str:
    """k07: options and query texts as one page."""
    esc = lambda t: str(t).replace("&", "&amp;").replace("<", "&lt;")
    rows = "".join(f"<tr><td>{esc(k)}</td><td>{esc(v)}</td></tr>" for k, v in options.items())
    body = "".join(f"<h2>{esc(k)}</h2><pre>{esc(v)}</pre>" for k, v in queries.items())
    return f"<!DOCTYPE html><html><body><table>{rows}</table>{body}</body></html>"


def common_columns(frames: list[DataFrame]) -> list[DataFrame]:
    """u06: the frames with the columns that all of them have, in the order of the first."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return [f.select(*names) for f in frames]


def concat(frames: list[DataFrame]) -> DataFrame:
    """u05: the rows of all frames, columns by name; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
