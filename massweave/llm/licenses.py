"""License scans: ordered signature rules.  DataFrame functions only.

Each rule is a regular expression with a keyword that must occur in the text for
the rule to be tried, a priority and a label.  Detections of all rules are spans;
one that lies inside another span goes (equal spans: the higher priority stays),
and the labels of the rest are reported beside the base labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base phrases and their labels, as words.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: A run of ASCII letters, digits and non-ASCII characters.
WORD = r"[0-9A-Za-z\P{ASCII}]+"
#: Anything but letters, digits and non-ASCII characters, on lower-cased text.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space of the patterns (\s) other than a single space.
RUNS = r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]"
_V = r"(?:,?\s*(?:version|v|ver\.?)?\s*{v})"

#: Licences: label, keyword of the prefilter, pattern of the name, SPDX identifiers, home of the text.
FAMILIES = (
    ("mit", "mit", r"(?:the\s+)?mit(?:\s+|-)(?:license|licence)", "mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "no attribution", r"mit\s+no\s+attribution", "mit-0", r"opensource\.org/licenses?/mit-0"),
    ("x11", "x11", r"(?:mit/)?x11\s+licen[sc]e", "x11", r"www\.x\.org/licen[sc]es"),
    ("isc", "isc", r"isc\s+licen[sc]e", "isc", r"opensource\.org/licenses?/isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause|freebsd)\s+bsd(?:\s+licen[sc]e)?", "bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3-clause|three-clause)\s+bsd(?:\s+licen[sc]e)?", "bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause)\s+bsd(?:\s+licen[sc]e)?", "bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"bsd(?:\s+style)?\s+licen[sc]e", "0bsd", r"opensource\.org/licenses?/bsd-license"),
    ("apache-1.1", "apache", r"apache(?:\s+software)?\s+licen[sc]e" + _V.format(v=r"1\.1"), "apache-1.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache(?:\s+software)?\s+licen[sc]e" + _V.format(v=r"2(?:\.0)?"), "apache-2.0", r"apache\.org/licenses/license-2\.0"),
    ("gpl-1", "general public", r"gnu\s+general\s+public\s+licen[sc]e" + _V.format(v=r"1(?:\.0)?"), "gpl-1.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2", "general public", r"gnu\s+general\s+public\s+licen[sc]e" + _V.format(v=r"2(?:\.0)?"), "gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3", "general public", r"gnu\s+general\s+public\s+licen[sc]e" + _V.format(v=r"3(?:\.0)?"), "gpl-3.0", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1", "lesser general", r"gnu\s+lesser\s+general\s+public\s+licen[sc]e" + _V.format(v=r"2\.1"), "lgpl-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3", "lesser general", r"gnu\s+lesser\s+general\s+public\s+licen[sc]e" + _V.format(v=r"3(?:\.0)?"), "lgpl-3.0", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2", "library general", r"gnu\s+library\s+general\s+public\s+licen[sc]e" + _V.format(v=r"2(?:\.0)?"), "lgpl-2.0", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("agpl-3", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e" + _V.format(v=r"3(?:\.0)?"), "agpl-3.0", r"gnu\.org/licenses/agpl-3\.0"),
    ("fdl-1.3", "free documentation", r"gnu\s+free\s+documentation\s+licen[sc]e" + _V.format(v=r"1\.3"), "gfdl-1.3", r"gnu\.org/licenses/fdl-1\.3"),
    ("mpl-1.1", "mozilla", r"mozilla\s+public\s+licen[sc]e" + _V.format(v=r"1\.1"), "mpl-1.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla\s+public\s+licen[sc]e" + _V.format(v=r"2(?:\.0)?"), "mpl-2.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse", r"eclipse\s+public\s+licen[sc]e" + _V.format(v=r"1(?:\.0)?"), "epl-1.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse\s+public\s+licen[sc]e" + _V.format(v=r"2(?:\.0)?"), "epl-2.0", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", "common development", r"common\s+development\s+and\s+distribution\s+licen[sc]e", "cddl-1.0", r"opensource\.org/licenses?/cddl-1\.0"),
    ("eupl-1.2", "european union public", r"european\s+union\s+public\s+licen[sc]e", "eupl-1.2", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("artistic-2.0", "artistic", r"artistic\s+licen[sc]e" + _V.format(v=r"2(?:\.0)?"), "artistic-2.0", r"perlfoundation\.org/artistic_license_2_0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?\s+licen[sc]e", "zlib", r"zlib\.net/zlib_license"),
    ("boost-1.0", "boost", r"boost\s+software\s+licen[sc]e", "bsl-1.0", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", "do what the", r"do\s+what\s+the\s+f\S{2,4}\s+you\s+want", "wtfpl", r"wtfpl\.net"),
    ("psf-2.0", "python", r"python\s+software\s+foundation\s+licen[sc]e", "psf-2.0", r"docs\.python\.org/.{0,20}license"),
    ("postgresql", "postgresql", r"postgresql\s+licen[sc]e", "postgresql", r"postgresql\.org/about/licence"),
    ("ofl-1.1", "open font", r"(?:sil\s+)?open\s+font\s+licen[sc]e", "ofl-1.1", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open database", r"open\s+database\s+licen[sc]e", "odbl-1.0", r"opendatacommons\.org/licenses/odbl"),
    ("cc0-1.0", "cc0", r"cc0(?:\s+1\.0)?(?:\s+universal)?", "cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", "creative commons|cc by|cc-by", r"(?:creative\s+commons\s+attribution|cc[\s-]by)(?:\s+[1-4]\.\d)?(?![\s-]*(?:nc|sa|nd|non|share|no))", "cc-by-4.0", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "creative commons|cc by|cc-by", r"(?:creative\s+commons\s+attribution[\s-]share[\s-]?alike|cc[\s-]by-sa)(?:\s+[1-4]\.\d)?", "cc-by-sa-4.0", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nd", "creative commons|cc by|cc-by", r"(?:creative\s+commons\s+attribution[\s-]no[\s-]?derivatives|cc[\s-]by-nd)(?:\s+[1-4]\.\d)?", "cc-by-nd-4.0", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc", "creative commons|cc by|cc-by", r"(?:creative\s+commons\s+attribution[\s-]non[\s-]?commercial|cc[\s-]by-nc)(?:\s+[1-4]\.\d)?(?![\s-]*(?:sa|nd|share|no))", "cc-by-nc-4.0", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", "creative commons|cc by|cc-by", r"(?:creative\s+commons\s+attribution[\s-]non[\s-]?commercial[\s-]share[\s-]?alike|cc[\s-]by-nc-sa)(?:\s+[1-4]\.\d)?", "cc-by-nc-sa-4.0", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", "creative commons|cc by|cc-by", r"(?:creative\s+commons\s+attribution[\s-]non[\s-]?commercial[\s-]no[\s-]?derivatives|cc[\s-]by-nc-nd)(?:\s+[1-4]\.\d)?", "cc-by-nc-nd-4.0", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("proprietary", "rights reserved", r"all\s+rights\s+reserved", "licenseref-proprietary", r"licenseref\.invalid/proprietary"),
    ("public-domain", "public domain", r"(?:dedicated\s+to|in|into)\s+the\s+public\s+domain", "licenseref-public-domain", r"creativecommons\.org/licenses/publicdomain"),
)

#: Forms a licence is announced in: priority, confidence, pattern with the place of the name, SPDX id or address.
FORMS = (
    (90, 1.00, "spdx", r"spdx-license-identifier:\s*\(?{spdx}(?:-only|-or-later)?(?![\w.-])"),
    (80, 0.95, "licen", r"(?:licensed|distributed|released|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{name}"),
    (70, 0.90, "licen", r"(?:licen[sc]e|licensed)\s*[:=]\s*(?:the\s+)?{name}"),
    (60, 0.85, "http", r"https?://(?:www\.)?{home}[^\s]*"),
    (50, 0.80, "permission", r"permission\s+is\s+(?:hereby\s+)?granted\b.{{0,200}}?\b{name}"),
    (10, 0.60, None, r"\b{name}"),
)


def rules() -> list[tuple[int, int, tuple[str, ...], tuple[str, ...], str, str, float]]:
    """(order, priority, gates, keywords, pattern, label, confidence); hundreds, one for each licence and form.

    A rule is tried on a text with one of its gates and one of its keywords.  All gates
    are rare strings, so most texts are passed over after a few substring searches.
    Both are sought with white space read as one space, as the patterns read it.
    """
    out = []
    for label, key, name, spdx, home in FAMILIES:
        for priority, sure, form_key, form in FORMS:
            pattern = "(?s)" + form.format(name=f"(?:{name})", spdx=spdx.replace(".", r"\."), home=home)
            keys = tuple(key.split("|"))
            if form_key == "spdx":
                gates = keys = ("spdx-license-identifier",)
            elif form_key == "http":
                gates = keys = (home.split("/")[0].replace("\\", ""),)
            else:
                gates = ("licen",) if "licen" in name else keys
            out.append((len(out), priority, gates, keys, pattern, label, sure))
    return out


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spans(text: Column, pattern: Column) -> Column:
    """Code-point spans of all matches: lengths of what lies between them, and of them."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(b.alias("b"), f.alias("f")))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["b"] + x["f"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["b"]).alias("s"), (a["at"] + x["b"] + x["f"]).alias("e")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _k and the lower-cased text _t; the generator keeps _t from being computed once for every use."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), _text_key(text).alias("_k"), F.explode(F.array(lower_ascii(text))).alias("_t"))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unsuppressed detections: id, text_key, start, end (code points), label, priority, confidence.

    ``text_key`` tells texts apart that share an id; empty and null texts have no detection.
    """
    every = rules()
    some = lambda keys: F.array(*[F.lit(k) for k in keys])
    table = F.array(
        *[F.struct(F.lit(o).alias("o"), F.lit(p).alias("p"), some(g).alias("g"), some(k).alias("k"), F.lit(r).alias("r"), F.lit(n).alias("n"), F.lit(c).alias("c")) for o, p, g, k, r, n, c in every]
    )
    # A name may be broken over lines: any white space counts as one space for gates and keywords.
    low = _lowered(docs, id_col, text_col).select("*", F.explode(F.array(F.regexp_replace("_t", RUNS, " "))).alias("_s"))
    gate = F.lit(False)
    for k in sorted({k for r in every for k in r[2]}):
        gate = gate | F.contains("_s", F.lit(k))
    has = lambda keys: F.exists(keys, lambda k: F.contains(F.col("_s"), k))
    hits = low.where(gate).select("_id", "_k", "_t", F.explode(F.filter(table, lambda r: has(r["g"]) & has(r["k"]))).alias("r"))
    spans = hits.where(F.regexp_like("_t", F.col("r.r"))).select("_id", "_k", "r.o", "r.p", "r.n", "r.c", F.explode(_spans(F.col("_t"), F.col("r.r"))).alias("x"))
    spans = spans.select("_id", "_k", "o", "p", "n", "c", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    # Sorted by start, longer first, then priority and order, a span lies in another iff an earlier one ends at or after it.
    w = Window.partitionBy("_id", "_k").orderBy("s", F.desc("e"), F.desc("p"), "o")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col("e"))).select(F.col("_id").alias(id_col), F.col("_k").alias("text_key"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("n").alias("label"), F.col("p").alias("priority"), F.col("c").alias("confidence"))


def _starts(parts: list[str]) -> Column:
    """Positions in ``_w`` at which the words ``parts`` stand."""

    def here(w: Column, i: Column) -> Column:
        c = w == parts[0]
        for j, p in enumerate(parts[1:], 1):
            c = c & (F.coalesce(F.get(F.col("_w"), i + j), F.lit("")) == p)
        return F.when(c, i.cast("long"))

    return F.filter(F.transform(F.col("_w"), here), lambda i: i.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, labels and score.

    Null and empty texts: no words, no labels, score 0.  The score is the greatest
    confidence of the detections that stay, at least 0.6 with a base label.
    Rows that repeat an id are judged each by its own text.
    """
    text = F.col("_t")
    a = _lowered(docs, id_col, text_col).select(
        F.col("_id").alias(id_col),
        F.col("_k").alias("_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(F.contains(text, F.lit("license")), F.filter(F.split(text, NON_WORD), lambda w: w != "")).alias("_w"),
    )
    places = []
    for phrase, label in BASE_PHRASES:
        places.append((label, _starts(phrase.split())))
    a = a.select(id_col, "_key", "n_words", *[F.coalesce(h, F.array().cast("array<bigint>")).alias(f"_p_{n}") for n, h in places])
    every = F.concat(*[F.col(f"_p_{n}") for n, _ in places])
    base = F.filter(F.array(*[F.when(F.size(f"_p_{n}") > 0, F.lit(n)) for n, _ in places]), lambda x: x.isNotNull())
    a = a.select(id_col, "_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), F.array_sort(base).alias("_base"))
    found = detections(docs, id_col, text_col).groupBy(F.col(id_col).alias("_fid"), F.col("text_key").alias("_fk")).agg(
        F.collect_set("label").alias("_more"),
        F.max("confidence").alias("_sure"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"),
    )
    a = a.join(found, (F.col("_key") == F.col("_fk")) & F.col(id_col).eqNullSafe(F.col("_fid")), "left")
    none = F.array().cast("array<string>")
    return a.select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "_base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(F.col("_base"), F.coalesce("_more", none)))).alias("labels"),
        F.greatest(F.coalesce("_sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
        "spans",
    )
