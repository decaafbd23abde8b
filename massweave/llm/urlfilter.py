"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

The classifier is trained on the driver from a small labelled URL table and is one
weight per hash slot.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textvec import LOWER, Words, mix, slices

#: Fixed values: (verdict, rule), a rule being host and path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BITS = 18
SIZES = (3, 4, 5)
L2 = 1e-4


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (1: block), generated from topic words in the shapes that hosts and paths take."""
    bad = ("ads track", "track pixel", "banner ads", "click farm", "spam farm", "link farm", "casino win", "online casino", "free bets", "bet bonus", "poker slots", "cheap pills", "pharma deals", "viagra shop", "adult x", "xxx cams", "porn tube", "sex chat", "warez crack", "keygen free", "torrent leech", "malware kit", "phish login", "win prize")
    good = ("daily news", "city library", "open science", "garden notes", "weather map", "music school", "history club", "travel stories", "cooking blog", "health guide", "code forum", "math notes", "book reviews", "film archive", "sports results", "river walk", "photo album", "language lab", "museum tours", "local times", "the reader", "north star", "tion house", "green energy")
    out = []
    for label, topics in ((1, bad), (0, good)):
        for topic, n in zip(topics, itertools.count()):
            a, b = topic.split()
            for k, host in enumerate((f"{a}-{b}", f"{a}{b}", f"blog.{a}-{b}", f"m.{a}{b}", f"www.{a}-{b}")):
                lang, top = ("en", "de", "fr", "es")[(n + k) % 4], ("com", "net", "org")[(n + k) % 3]
                out.append((f"https://{host}.example.{top}/{lang}/{(n * 37 + k * 911) % 40000}{('', '.html', '/', '?page=2', '#top')[k]}", label))
    # Most hosts are to be allowed: made-up names in the same shapes, so that neither
    # subdomain, language, number nor ending tells the classes apart.
    parts = ("an", "ber", "den", "est", "for", "ing", "lar", "men", "nor", "ther", "tion", "ver", "ash", "ell", "our", "ist", "ra", "to", "ki", "wel", "st", "re", "th", "ou", "ha")
    for n, (a, b) in enumerate(itertools.product(parts, parts)):
        host = a + b + parts[(n * 7) % len(parts)] * (n % 2)
        lead, lang, top = ("", "www.", "m.", "blog.")[n % 4], ("en", "de", "fr", "es")[n // 4 % 4], ("com", "net", "org")[n % 3]
        out.append((f"http://{lead}{host}.example.{top}/{lang}/{(n * 6361) % 50000}{('', '.html', '/', '?page=2', '#top')[n % 5]}", 0))
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null urls and urls without ``://``: both empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.expr("1")).isNotNull()
    after = F.when(rest, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, path


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (null: none fits)."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For runs of texts: (row of each n-gram, its slot, rows); n-grams of the bytes of ``^host path``."""
    everything = np.ones(256, bool)
    for a, b, buf, off in slices(texts):
        low = LOWER[buf]
        w = Words(low, off, everything)
        rows, slots = [], []
        for n in SIZES:
            last = np.maximum(np.diff(off) - n + 1, 0)
            r = np.repeat(np.arange(b - a), last)
            s = np.arange(int(last.sum())) - np.repeat(np.cumsum(last) - last, last) + off[:-1][r]
            h = mix(w.hashes(s, s + n) + np.uint64(n))
            rows.append(r)
            slots.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        yield np.concatenate(rows), np.concatenate(slots), b - a


def _features(row: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs and the value 1/sqrt(count of the row)."""
    pair = np.unique(row.astype(np.int64) << BITS | slot)
    row, slot = pair >> BITS, pair & ((1 << BITS) - 1)
    count = np.maximum(np.bincount(row, minlength=n), 1)
    return row, slot, 1.0 / np.sqrt(count)


def host_text(host: str, path: str) -> str:
    return f"^{host}|{path}"


def train(urls: list[tuple[str, int]] | None = None, steps: int = 300) -> np.ndarray:
    """Weights of the slots, then the bias, by gradient steps on the ridge logistic loss."""
    urls = labelled_urls() if urls is None else urls
    text, y = [], np.array([u[1] for u in urls], float)
    for u, _ in urls:
        rest = u.partition("://")[2]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        path = rest[cut:]
        stop = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
        text.append(host_text(rest[:cut].lower(), path[:stop]))
    parts = list(ngrams(pa.array(text, pa.string())))
    shift = np.cumsum([0] + [p[2] for p in parts])
    row, slot, scale = _features(np.concatenate([p[0] + s for p, s in zip(parts, shift, strict=False)]), np.concatenate([p[1] for p in parts]), len(y))
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        z = np.bincount(row, weights=w[slot], minlength=len(y)) * scale + bias
        d = 1 / (1 + np.exp(-z)) - y
        w -= 4.0 * (np.bincount(slot, weights=(d * scale)[row], minlength=1 << BITS) / len(y) * 8 + L2 * w)
        bias -= 0.5 * d.mean()
    return np.append(w, bias)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", weights: np.ndarray | None = None) -> DataFrame:
    """Per row: id, host, path, rule, verdict and the classifier's probability of block.

    Null urls have empty host and path, fit no rule and are judged as empty texts.
    Repeated and null ids stay rows of their own.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train() if weights is None else weights)  # 2 MB
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            got = []
            for row, slot, n in ngrams(batch.column(3)):
                r, s, scale = _features(row, slot, n)
                z = np.bincount(r, weights=w[s], minlength=n) * scale + w[-1]
                got.append(1 / (1 + np.exp(-z)))
            p = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), p], ["_id", "host", "path", "p_block"])

    host, path = host_path(F.col("_u"))
    a = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u")).select("_id", host.alias("host"), path.alias("path"))
    a = a.select("_id", "host", "path", F.concat(F.lit("^"), "host", F.lit("|"), "path").alias("_t"))
    a = a.mapInArrow(run, f"_id {kind}, host string, path string, p_block double")
    rule, verdict = best_rule(F.col("host"), F.col("path"))
    return a.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "p_block",
    )
