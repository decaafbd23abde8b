"""Quality rules: robust multivariate outliers by minimum covariance determinant.

DataFrame functions only.  Every text is reduced to a few statistics; within
each (language, source) the minimum-covariance-determinant estimate of centre
and scatter is the best of several starts, each refined by concentration steps that are
mergeable aggregations, and a text goes if its squared Mahalanobis distance is beyond the
cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise

WHITE = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Share of a group's rows in the concentrated part.
KEEP_SHARE = 0.75
#: Fixed value: 0.75 over the chi-square distribution with 7 degrees at the 0.75 quantile of that with 5; makes the
#: scatter of the nearest 0.75 consistent for normal data.
CONSISTENCY = 1.4121
#: Concentration steps at most, and the change of the log determinant (of the factor) that counts as none.
STEPS, SETTLED = 10, 1e-3
#: Least variance of a transformed feature, so that a constant statistic does not reject whatever moves.
FLOOR = (0.010, 0.003, 0.003, 0.003, 0.012)
#: Rejection: squared distance over the 1 - 1e-6 quantile of chi-square with 5 degrees.
CUTOFF = 35.9
#: Weight, in rows, of the estimate above a group's own.
PRIOR = 50
#: Groups whose estimates are broadcast at most; more are joined by a shuffle.
SMALL_GROUPS = 1 << 15
#: Bins per doubling of the squared distance when the concentrated share is looked up; steps of a feature's unit for quantiles.
BINS, GRID = 32, 256


def words_of(text: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+`` (null or blank: empty array)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = 8) -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_chars, n_upper, n_marks, n_lines.

    n_repeat_words counts the words that lie in a ``window``-word window whose 64-bit
    hash occurs twice or more in the text; windows are compared by hash.  Null texts
    count as empty; repeated ids stay separate rows.
    """
    text = F.coalesce(F.col("_t"), F.lit(""))
    count = lambda chars: F.regexp_count(text, F.lit(chars))
    a = docs.select(F.col(id_col).alias(id_col), *carry, F.col(text_col).cast("string").alias("_t"))
    a = a.select(
        id_col,
        *carry,
        F.length(text).alias("n_chars"),
        count(r"[\x20\x09-\x0D]").alias("_white"),
        count(SYMBOLS).alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
        count(r"[!?;:_/\\()\[\]{}\"'+=@^~`-]").alias("n_marks"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("_lines"),
        F.transform(words_of(F.col("_t")), lambda w: F.xxhash64(w)).alias("_h"),
    )
    a = a.withColumn("_n", F.size("_h"))
    # Window hashes by doubling: runs of 1, 2, 4, ... words, the last step overlapping.
    run = 1
    while run < window:
        step = min(run, window - run)
        left = F.greatest(F.size("_h") - step, F.lit(0))
        a = a.withColumn("_h", F.zip_with(F.slice("_h", 1, left), F.slice("_h", step + 1, left), lambda x, y: F.xxhash64(x, y)))
        run += step
    a = a.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    # Only texts with a repeated window: positions in order of hash, neighbours of equal hash, back in order of position.
    pairs = F.array_sort(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("_s", F.when(F.col("_again"), pairs))
    s = F.col("_s")
    twice = F.filter(
        F.transform(
            s,
            lambda x, k: F.when(
                F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    a = a.withColumn("_p", F.when(F.col("_again"), F.array_sort(twice)))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1), i + window) - i)), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    return a.select(
        id_col,
        *carry,
        F.col("_n").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("_white")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("n_upper").cast("long").alias("n_upper"),
        F.col("n_marks").cast("long").alias("n_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> list[Column]:
    """Transformed statistics: log mean word length and arcsine roots of four shares."""
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    root = lambda n, d: F.asin(F.sqrt(F.least(n.cast("double") / d, F.lit(1.0))))
    return [
        F.log(chars / words),
        root(F.col("n_symbols"), chars),
        root(F.col("n_upper"), chars),
        root(F.col("n_marks"), chars),
        root(F.col("n_repeat_words"), words),
    ]


def _distance(x: list[Column], mean: list[Column], low: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor."""
    y: list[Column] = []
    for i in range(len(x)):
        rest = x[i] - mean[i]
        for j in range(i):
            rest = rest - low[i, j] * y[j]
        y.append(rest / low[i, i])
    out = y[0] * y[0]
    for v in y[1:]:
        out = out + v * v
    return out


def _factor(g: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Means and Cholesky factor of the covariances c{i}_{j}, with the variances no less than ``FLOOR``."""
    for i in range(d):
        for j in range(i + 1):
            v = F.greatest(F.col(f"c{i}_{i}"), F.lit(FLOOR[i])) if i == j else F.col(f"c{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            g = g.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(v, F.lit(FLOOR[i] * 1e-3))) if i == j else v / F.col(f"l{j}_{j}"))
    lows = [F.round(f"l{i}_{j}", 9).alias(f"l{i}_{j}") for i in range(d) for j in range(i + 1)]
    means = [F.round(f"m{i}", 9).alias(f"m{i}") for i in range(d)]
    det = sum((F.log(f"l{i}_{i}") for i in range(d)), F.lit(0.0))
    return g.select(*keys, "n", *means, *[f"c{i}_{j}" for i in range(d) for j in range(i + 1)], *lows, F.round(det, 6).alias("det"))


def _scatter(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Means, covariances and Cholesky factor per group, from sums that merge before the shuffle."""
    x = [F.col(f"x{i}") for i in range(d)]
    sums = [F.count(F.lit(1)).alias("n")] + [F.avg(x[i]).alias(f"m{i}") for i in range(d)]
    sums += [F.avg(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]
    g = rows.groupBy(*keys).agg(*sums)
    cov = [(F.col(f"q{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    return _factor(g.select(*keys, "n", *[f"m{i}" for i in range(d)], *cov), keys, d)


def _pooled(est: DataFrame, keys: list[str], prior: DataFrame | None, on: list[str], d: int) -> DataFrame:
    """Per ``keys`` the moments of all rows that ``est`` summarises, with ``PRIOR`` rows of the estimate above (joined by ``on``)."""
    second = {(i, j): F.col(f"c{i}_{j}") + F.col(f"m{i}") * F.col(f"m{j}") for i in range(d) for j in range(i + 1)}
    sums = [F.sum("n").alias("n")] + [F.sum(F.col("n") * F.col(f"m{i}")).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(F.col("n") * v).alias(f"q{i}_{j}") for (i, j), v in second.items()]
    g = est.groupBy(*keys).agg(*sums)
    n = F.col("n")
    if prior is not None:
        up = prior.select(*on, *[F.col(f"m{i}").alias(f"_m{i}") for i in range(d)], *[v.alias(f"_q{i}_{j}") for (i, j), v in second.items()])
        g = g.join(F.broadcast(up), on) if on else g.crossJoin(F.broadcast(up))  # a row for each language, or one row
        n = n + PRIOR
        g = g.select(*keys, "n", *[(F.col(f"s{i}") + PRIOR * F.col(f"_m{i}")).alias(f"s{i}") for i in range(d)], *[(F.col(f"q{i}_{j}") + PRIOR * F.col(f"_q{i}_{j}")).alias(f"q{i}_{j}") for (i, j) in second])
    g = g.select(*keys, "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(d)], *[(F.col(f"q{i}_{j}") / n).alias(f"q{i}_{j}") for (i, j) in second])
    return g.select(*keys, "n", *[f"m{i}" for i in range(d)], *[(F.col(f"q{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}_{j}") for (i, j) in second])


def _measured(rows: DataFrame, est: DataFrame, d: int) -> DataFrame:
    """The rows with the bin ``b`` of their distance from each estimate of their group (a small written table)."""
    low = {(i, k): F.col(f"l{i}_{k}") for i in range(d) for k in range(i + 1)}
    d2 = _distance([F.col(f"x{i}") for i in range(d)], [F.col(f"m{i}") for i in range(d)], low)
    keep = [c for c in ("edge",) if c in est.columns]
    few = est.select("_lang", "_source", "start", *[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i in range(d) for j in range(i + 1)], *keep)
    held = rows.join(F.broadcast(few) if few.count() <= SMALL_GROUPS else few, ["_lang", "_source"])
    return held.select("_lang", "_source", "start", *[f"x{i}" for i in range(d)], F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * BINS).cast("long").alias("b"), *keep)


def _edges(near: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Per group, the bins ``b`` that complete the ``shares`` of its rows (array ``edge``).

    The histogram merges before the shuffle and has some hundred bins a group whatever
    the rows, so a group with a third of all rows is no heavier than another.
    """
    per = near.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("h"), F.sum("c").alias("n"))
    found = lambda share: F.aggregate(
        F.col("h"),
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
        lambda a, x: F.struct(
            (a["seen"] + x["c"]).alias("seen"),
            F.coalesce(a["at"], F.when(a["seen"] + x["c"] >= F.ceil(F.col("n") * F.lit(share)), x["b"])).alias("at"),
        ),
    )["at"]
    return per.select(*keys, "n", F.array(*[found(x) for x in shares]).alias("edge"))


def _starts(rows: DataFrame, d: int) -> DataFrame:
    """Three starts of each group: medians with quartile ranges, all rows, and the half of the rows that a hash picks."""
    keys = ["_lang", "_source"]
    each = rows.select(*keys, F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * GRID).cast("long") for i in range(d)])).alias("i", "b"))
    q = _edges(each, [*keys, "i"], [0.25, 0.5, 0.75]).groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("edge"))).alias(f"p{i}") for i in range(d)])
    spread = lambda i: F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / F.lit(GRID) * 0.7413, F.lit(2.0))
    cov = [(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    medians = q.select(*keys, F.lit(0).alias("start"), "n", *[((F.col(f"p{i}")[1] + 0.5) / F.lit(GRID)).alias(f"m{i}") for i in range(d)], *cov)
    half = F.pmod(F.xxhash64(*[f"x{i}" for i in range(d)]), F.lit(2))
    by_hash = rows.select(*keys, F.explode(F.when(half == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("start"), *[f"x{i}" for i in range(d)])
    return _factor(medians, [*keys, "start"], d).unionByName(_scatter(by_hash, [*keys, "start"], d))


def _mcd(rows: DataFrame, d: int) -> DataFrame:
    """Per language and source the estimate of least determinant; rows: _lang, _source and x0..xd-1.

    From each start, concentration steps: the share ``KEEP_SHARE`` of the rows that lies nearest
    gives the next estimate, until no determinant moves.  The estimates of small groups lean on
    their language's and these on that of all rows (``PRIOR`` rows' weight), without a limit
    where a group begins to count.
    """
    keys = ["_lang", "_source", "start"]
    est = materialise(_starts(rows, d), "mcd")
    for step in range(STEPS):
        # Written, so that the joins know their sizes.
        edges = materialise(_edges(_measured(rows, est, d), keys, [KEEP_SHARE]).select(*keys, F.col("edge")[0].alias("edge")), "edges")
        cut = materialise(est.join(edges, keys), "cut")
        new = materialise(_scatter(_measured(rows, cut, d).where(F.col("b") <= F.col("edge")), keys, d), "mcd")
        # Starts are no concentrated estimates yet: the first step has nothing to compare with.
        moved = new.join(est.select(*keys, F.col("det").alias("_was")), keys).agg(F.max(F.abs(F.col("det") - F.col("_was")))).first()[0]
        drop(est, edges, cut)
        est = new
        if step and (moved is None or moved < SETTLED):
            break
    names = ["n", *[f"m{i}" for i in range(d)], *[f"c{i}_{j}" for i in range(d) for j in range(i + 1)]]
    best = materialise(est.groupBy("_lang", "_source").agg(F.min(F.struct("det", "start", *names)).alias("e")).select("_lang", "_source", *[f"e.{c}" for c in names]), "best")
    every = _pooled(best, [], None, [], d)
    lang = _pooled(best, ["_lang"], every, [], d)
    own = _pooled(best, ["_lang", "_source"], lang, ["_lang"], d)
    wide = own.select("_lang", "_source", "n", *[f"m{i}" for i in range(d)], *[(F.col(f"c{i}_{j}") * CONSISTENCY).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)])
    out = materialise(_factor(wide, ["_lang", "_source"], d), "estimates")
    drop(est, best)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base statistics, robust distance ``d2``, ``base_failed`` and ``kept`` per row.

    Jobs run when this is called.  Rows that fail the base rules take no part in the
    estimates and have no ``d2``.  Null languages and sources are groups of their own.  Null and
    empty texts fail the base rules; repeated ids stay rows of their own; an empty table
    gives an empty result.
    """
    stats, est = _estimated(docs, id_col, text_col, lang_col, source_col)
    return _judged(stats, est).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def keep_inliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns.

    The statistics are computed again in a second pass over the texts, so that no text is
    written to scratch or shuffled.
    """
    stats, est = _estimated(docs, id_col, text_col, lang_col, source_col)
    drop(stats)
    whole = docs.select(id_col, text_col, lang_col, source_col, F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    return _judged(_statistics(whole, id_col, text_col, lang_col, source_col, ("_row",)), est).where("kept").select("_row.*")


def _statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base statistics, base_failed and features x0.. of every row, with the names _lang and _source of its group."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    taken = docs.select(F.col(id_col), name(lang_col).alias("_lang"), name(source_col).alias("_source"), F.col(text_col), *carry)
    stats = base_statistics(taken, id_col, text_col, ("_lang", "_source", *carry))
    # The generator keeps the statistics from being computed once for every use, or for a filter and again above it.
    stats = stats.select(F.explode(F.array(F.struct("*"))).alias("_s")).select("_s.*")
    return stats.select("*", base_failed().alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(features())])


def _estimated(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(statistics, estimates by language and source), both written."""
    stats = materialise(_statistics(docs, id_col, text_col, lang_col, source_col), "stats")
    return stats, _mcd(stats.where(~F.col("base_failed")).select("_lang", "_source", *[f"x{i}" for i in range(len(FLOOR))]), len(FLOOR))


def _judged(stats: DataFrame, est: DataFrame) -> DataFrame:
    d = len(FLOOR)
    e = est.select("_lang", "_source", *[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i in range(d) for j in range(i + 1)])
    out = stats.join(F.broadcast(e) if e.count() <= SMALL_GROUPS else e, ["_lang", "_source"], "left")
    low = {(i, k): F.col(f"l{i}_{k}") for i in range(d) for k in range(i + 1)}
    d2 = F.when(~F.col("base_failed"), _distance([F.col(f"x{i}") for i in range(d)], [F.col(f"m{i}") for i in range(d)], low))
    out = out.withColumn("d2", d2)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)))
