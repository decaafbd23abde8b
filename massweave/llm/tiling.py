"""Benchmark decontamination by greedy string tiling.

Documents that share seeds (runs of ``min_match`` words) with a benchmark item are
tiled against it: the longest run that both have and that is not marked yet is
marked, again and again, each search by running Karp-Rabin hashes.  The marked share
of the item is the coverage, whatever the order of the pieces in the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship
from .textvec import ALNUM, Words, slices, window_hashes

#: Words of a seed, and of the shortest tile.
MIN_MATCH = 4
#: Share of an item's words that tiles must cover for a leak.
COVERAGE = 0.5
#: Bytes of benchmark text that one block broadcasts; a larger benchmark is run in blocks.
BLOCK_BYTES = 8 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Items:
    """Tokens of benchmark items and an index of their seeds."""

    ids: list
    tokens: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray  # sorted distinct seed hashes
    at: np.ndarray  # CSR offsets into item and pos, by seed
    item: np.ndarray
    pos: np.ndarray
    bitmap: np.ndarray


def index_items(ids: list, texts: list[str | None], min_match: int = MIN_MATCH) -> Items:
    """Items with fewer than ``min_match`` words (null and empty texts too) have no seeds and never match."""
    tokens, bounds = [], [np.zeros(1, np.int64)]
    n = 0
    for _, _, buf, off in slices(pa.array(texts, pa.string())):
        w = Words(buf, off, ALNUM, lower=True)
        tokens.append(w.hashes())
        bounds.append(w.bounds[1:] + n)
        n += len(w)
    tok, bnd = (np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)), np.concatenate(bounds)
    g = window_hashes(tok, min_match)
    item = np.repeat(np.arange(len(ids)), np.diff(bnd))[: len(g)]
    pos = np.arange(len(g)) - bnd[item]
    inside = np.arange(len(g)) + min_match <= bnd[item + 1]
    g, item, pos = g[inside], item[inside], pos[inside]
    order = np.argsort(g, kind="stable")
    g, item, pos = g[order], item[order], pos[order]
    grams, first = np.unique(g, return_index=True)
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(grams >> np.uint64(42)).astype(np.int64)] = True
    return Items(list(ids), tok, bnd, grams, np.append(first, len(g)), item, pos, bitmap)


def _windows(prefix: np.ndarray, powers: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of s tokens, from running prefix hashes."""
    return prefix[s:] - prefix[:-s] * powers[s]


def tiles(a: np.ndarray, b: np.ndarray, b_ok: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of tokens a and b: (start in a, start in b, length), longest first.

    ``b_ok`` is false where b is cut.  Ties go to the smallest start in a, then in b.
    """
    top = min(len(a), len(b))
    powers = np.ones(top + 2, np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(top + 1, _B, np.uint64))
    pa_, pb = np.zeros(len(a) + 1, np.uint64), np.zeros(len(b) + 1, np.uint64)
    for p, t in ((pa_, a), (pb, b)):
        h = 0
        for i, x in enumerate(t.tolist()):
            h = (h * int(_B) + x) & 0xFFFFFFFFFFFFFFFF
            p[i + 1] = h
    free_a, free_b = np.ones(len(a), bool), b_ok.copy()
    out = []

    def common(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        fa = np.concatenate([[0], np.cumsum(~free_a)])
        fb = np.concatenate([[0], np.cumsum(~free_b)])
        ia, ib = np.flatnonzero(fa[s:] == fa[:-s]), np.flatnonzero(fb[s:] == fb[:-s])
        ha, hb = _windows(pa_, powers, s)[ia], _windows(pb, powers, s)[ib]
        hit = np.isin(ha, hb)
        return ia[hit], ha[hit], ib, hb

    while top >= min_match:
        low, high = min_match - 1, top
        while low < high:  # a common run of s tokens holds one of s - 1
            s = (low + high + 1) // 2
            if len(common(s)[0]):
                low = s
            else:
                high = s - 1
        if low < min_match:
            break
        s = low
        ia, ha, ib, hb = common(s)
        order = np.argsort(hb, kind="stable")
        sb, ib = hb[order], ib[order]
        for i, h in zip(ia.tolist(), ha.tolist(), strict=True):
            if not free_a[i : i + s].all():
                continue
            k = int(np.searchsorted(sb, np.uint64(h)))
            while k < len(sb) and int(sb[k]) == h:
                j = int(ib[k])
                k += 1
                if free_b[j : j + s].all() and (a[i : i + s] == b[j : j + s]).all():
                    free_a[i : i + s] = False
                    free_b[j : j + s] = False
                    out.append((i, j, s))
                    break
        top = s if out and out[-1][2] == s else s - 1
    return out


def match_batches(items: Items, batches: Iterator[pa.RecordBatch], min_match: int, coverage: float) -> Iterator[tuple]:
    """(row of the batch's ids, item, words, matched, tiles, longest tile) of every leak."""
    for batch in batches:
        rows: list[tuple] = []
        for first, _, buf, off in slices(batch.column(1)):
            w = Words(buf, off, ALNUM, lower=True)
            h = w.hashes()
            g = window_hashes(h, min_match)
            if not len(g) or not len(items.grams):
                continue
            at = np.flatnonzero(items.bitmap[(g >> np.uint64(42)).astype(np.int64)])
            k = np.minimum(np.searchsorted(items.grams, g[at]), len(items.grams) - 1)
            good = items.grams[k] == g[at]
            at, k = at[good], k[good]
            doc = np.searchsorted(w.bounds, at, "right") - 1
            inside = at + min_match <= w.bounds[doc + 1]
            at, k, doc = at[inside], k[inside], doc[inside]
            if not len(at):
                continue
            # Items of the seeds of each document; one place of a seed is enough for the bound below.
            pair = np.unique(doc.astype(np.int64) * (len(items.grams) + 1) + k)
            d, s = pair // (len(items.grams) + 1), pair % (len(items.grams) + 1)
            n = items.at[s + 1] - items.at[s]
            src = np.repeat(items.at[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.repeat(d, n) * len(items.ids) + items.item[src]
            pos = items.pos[src]
            order = np.lexsort((pos, key))
            key, pos = key[order], pos[order]
            cut = np.flatnonzero(np.diff(key)) + 1
            starts = np.concatenate([[0], cut])
            for a, b in zip(starts.tolist(), np.append(cut, len(key)).tolist(), strict=True):
                i, dd = int(key[a] % len(items.ids)), int(key[a] // len(items.ids))
                p = pos[a:b]
                words = int(items.bounds[i + 1] - items.bounds[i])
                # Seeds found anywhere bound what tiles can cover.
                if np.minimum(np.diff(np.append(p, p[-1] + min_match)), min_match).sum() < coverage * words:
                    continue
                mine = items.tokens[items.bounds[i] : items.bounds[i + 1]]
                lo, hi = np.searchsorted(doc, [dd, dd + 1])
                near = np.isin(k[lo:hi], np.flatnonzero(np.isin(items.grams, window_hashes(mine, min_match))))
                spots = at[lo:hi][near]
                inside_ = (spots[:, None] + np.arange(min_match)).ravel()
                keep = np.unique(inside_)
                gap = np.flatnonzero(np.diff(keep) > 1) + 1
                b_tok = np.insert(h[keep], gap, 0)
                b_ok = np.insert(np.ones(len(keep), bool), gap, False)
                found = tiles(mine, b_tok, b_ok, min_match)
                matched = sum(t[2] for t in found)
                if matched >= coverage * words:
                    rows.append((first + dd, i, words, matched, len(found), found[0][2]))
        yield batch, rows


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded size, each brought to the driver alone."""
    b = benchmark.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    size = b.agg(F.sum(F.octet_length("_x"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("_i", "_x"), F.lit(n)) == k)
        got = part.toArrow().to_pydict()
        order = sorted(range(len(got["_i"])), key=lambda j: (str(got["_i"][j]), got["_x"][j]))
        yield [got["_i"][j] for j in order], [got["_x"][j] for j in order]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item that it leaks: item_words, matched_words, coverage, n_tiles, longest_tile.

    Null, empty and short texts leak nothing; an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"_id {kind.simpleString()}, _item {item_kind.simpleString()}, item_words bigint, matched_words bigint, coverage double, n_tiles bigint, longest_tile bigint"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    out = None
    for ids, texts in blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index_items(ids, texts, min_match))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch, found in match_batches(items, batches, min_match, coverage):
                if not found:
                    continue
                r, i, words, matched, n, longest = (list(x) for x in zip(*found, strict=True))
                ids_ = batch.column(0).take(pa.array(r))
                cols = [ids_, pa.array([items.ids[x] for x in i]), pa.array(words, pa.int64()), pa.array(matched, pa.int64())]
                cols += [pa.array([m / w for m, w in zip(matched, words, strict=True)], pa.float64()), pa.array(n, pa.int64()), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_item", "item_words", "matched_words", "coverage", "n_tiles", "longest_tile"])

        part = rows.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "item_words", "matched_words", "coverage", "n_tiles", "longest_tile")


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with all their columns, in one pass without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    at, out = docs.columns.index(text_col), docs
    for ids, texts in blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index_items(ids, texts, min_match))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plain = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at).cast(pa.string())], ["i", "t"])
                _, found = next(match_batches(shared.value, iter([plain]), min_match, coverage))
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in found]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
