"""Phrase collocations: exact weighted n-grams of deduplicated pieces, counted level by level.

Equal pieces become one with a multiplicity.  Pieces are gathered in runs of bounded size; a run
holds, for each place, the number of the n-gram that begins there.  A phrase of k words is the
pair of its first and its last k - 1 words, so each level is the same step: a run sums up its
distinct pairs of frequent neighbours and asks the buckets of the pairs' hash for them; a bucket
counts its pairs out-of-core in duckdb, gives each frequent one an id, and sends the ids back to
the runs that asked.  A pair with a rare part is rare, so nothing frequent is lost, and places
without a frequent n-gram leave the runs.  The counts of the parts of a phrase come along the
chain of pairs, by joins on the ids.

Defined cases: null or empty texts have no pieces; a null language is ``und``; ids are not read and
may repeat (equal rows count again); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, lean, materialise, release, ship
from .textvec import mix

#: Words of the longest phrase, least count of a phrase, rows of a language's report.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one has so many hundredths of its count.
COVERED = 80
#: Scale of the score.
SCALE = 2_000_000
#: Bytes of distinct pieces of a run; bytes of text for each bucket, and buckets at most (beyond that duckdb spills more).
RUN_BYTES, BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 24 << 20, 1 << 13
#: Memory of duckdb in a worker, in MB; what does not fit goes to the worker's own folder until the bucket is done.
DUCKDB_MB = 128
#: Rows that go into duckdb at once.
INSERT = 1 << 17

_STATE = "run long, bucket int, places binary, weights binary, x binary, y binary, words array<string>, langs array<string>, w binary, tokens array<long>"


def packed(a: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    a = np.ascontiguousarray(a, np.int64)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(np.int64)


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): distinct pieces, their words joined by single spaces, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.ascii_lower(b.column(0).cast(pa.large_string()))
            parts = pc.split_pattern_regex(text, r"[.,;:!?\x0A-\x0D]")
            row = pc.list_parent_indices(parts)
            piece = pc.ascii_trim(pc.replace_substring_regex(pc.list_flatten(parts), r"[ \t]+", " "), " ")
            t = pa.table({"lang": b.column(1).take(row), "piece": piece}).filter(pc.greater(pc.binary_length(piece), 0))
            t = t.group_by(["lang", "piece"], use_threads=False).aggregate([([], "count_all")])
            t = t.select(["lang", "piece", "count_all"]).rename_columns(["lang", "piece", "m"])
            yield from t.cast(pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])).to_batches()

    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    return text.mapInArrow(lean(run), "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def sums(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums of the weights of each key."""
    out = np.zeros(n, np.int64)
    np.add.at(out, keys, weights)
    return out


def by_bucket(b: np.ndarray) -> list[np.ndarray]:
    """The places of each bucket that has any."""
    order = np.argsort(b, kind="stable")
    return [own for own in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(own)]


def _words(buckets: int):
    """Runs of pieces: places of their words, and the words asked for."""

    def rows(run_id: int, parts: list[pa.Table]) -> Iterator[dict]:
        t = pa.concat_tables(parts).combine_chunks()
        words = pc.split_pattern(t["piece"].combine_chunks().cast(pa.large_string()), " ")
        size = np.asarray(pc.list_value_length(words)).astype(np.int64)
        lang = t["lang"].combine_chunks().dictionary_encode()
        flat = pc.list_flatten(words).dictionary_encode()
        of = np.repeat(np.asarray(lang.indices), size).astype(np.int64)
        m = np.asarray(t["m"])
        # The same word in two languages has two numbers.
        key, at = np.unique(of * len(flat.dictionary) + np.asarray(flat.indices), return_inverse=True)
        weight = np.repeat(m, size)
        total = sums(at, weight, len(key))
        end = np.cumsum(size) + np.arange(len(size))  # a place without a word ends each piece
        places, weights = np.full(int(size.sum()) + len(size), -1, np.int64), np.zeros(int(size.sum()) + len(size), np.int64)
        inside = np.ones(len(places), bool)
        inside[end] = False
        places[inside], weights[inside] = at, weight
        langs, names = key // len(flat.dictionary), flat.dictionary.take(pa.array(key % len(flat.dictionary)))
        tokens = sums(np.repeat(np.asarray(lang.indices), 1), size * m, len(lang.dictionary))
        yield {"run": run_id, "bucket": -1, "places": packed(places), "weights": packed(weights), "langs": lang.dictionary.to_pylist(), "tokens": tokens.tolist()}
        b = bucket_of_words(lang.dictionary.take(pa.array(langs)).to_pylist(), names.to_pylist(), buckets)
        lang_names = lang.dictionary.take(pa.array(langs))
        for own in by_bucket(b):
            yield {"run": run_id, "bucket": int(b[own[0]]), "words": names.take(pa.array(own)).to_pylist(), "langs": lang_names.take(pa.array(own)).to_pylist(), "w": packed(total[own]), "places": packed(own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                held.append(pa.Table.from_batches([part]))
                size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if size >= RUN_BYTES:
                    yield from _batches(rows(run_id, held))
                    run_id, held, size = run_id + 1, [], 0
        if size:
            yield from _batches(rows(run_id, held))

    return run


_ARROW = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("weights", pa.binary()), ("x", pa.binary()), ("y", pa.binary()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string())), ("w", pa.binary()), ("tokens", pa.list_(pa.int64()))])


def _batches(rows: Iterator[dict], schema: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    for r in rows:
        yield pa.RecordBatch.from_pylist([r], schema)


def bucket_of_words(langs: list[str], words: list[str], buckets: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w, xxh3_64_intdigest(g)) % buckets for g, w in zip(langs, words, strict=True)], np.int64)


def bucket_of_pairs(x: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    h = mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(y.astype(np.uint64)))
    return (h % np.uint64(buckets)).astype(np.int64)


_COUNTED = "run long, at binary, ids binary, id long, lang string, word string, x long, y long, f long"
_COUNTED_ARROW = pa.schema([("run", pa.int64()), ("at", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("f", pa.int64())])


def _count(least: int, level: int, answer: bool):
    """Counts of a partition's buckets: frequent n-grams with new ids, and for each run that asked the ids of its own."""
    key = "lang, word" if level == 1 else "x, y"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows (run, place, w, key) of some questions at once."""
        parts, n = [], 0
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                own = {"run": np.full(len(w := unpacked(r["w"])), r["run"], np.int64), "place": unpacked(r["places"]), "w": w}
                parts.append(pa.table(own | ({"lang": pa.array(r["langs"], pa.string()), "word": pa.array(r["words"], pa.string())} if level == 1 else {"x": unpacked(r["x"]), "y": unpacked(r["y"])})))
                n += len(w)
                if n >= INSERT:
                    yield pa.concat_tables(parts)
                    parts, n = [], 0
        if parts:
            yield pa.concat_tables(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb  # only workers that count need it

        folder = tempfile.mkdtemp(prefix="ngrams-")
        try:
            with duckdb.connect(f"{folder}/n.db", config={"memory_limit": f"{DUCKDB_MB}MB", "temp_directory": f"{folder}/t", "threads": 1, "preserve_insertion_order": False}) as con:
                con.execute(f"create table asked(run bigint, place bigint, w bigint, {'lang varchar, word varchar' if level == 1 else 'x bigint, y bigint'})")
                for part in asked(batches):
                    con.register("part", part)
                    con.execute("insert into asked select * from part")
                    con.unregister("part")
                base = TaskContext.get().partitionId() << 40
                con.execute(f"create table grams as select {base} + row_number() over () as id, * from (select {key}, sum(w)::bigint as f from asked group by {key} having sum(w) >= {least})")
                for g in con.execute(f"select id, {key}, f from grams").to_arrow_reader(1 << 16):
                    yield pa.RecordBatch.from_arrays([g.column(c.name) if c.name in g.schema.names else pa.nulls(g.num_rows, c.type) for c in _COUNTED_ARROW], schema=_COUNTED_ARROW)
                for g in () if not answer else con.execute(f"select run, place, id from asked join grams using ({key}) order by run, place").to_arrow_reader(1 << 17):
                    runs = np.asarray(g.column(0))
                    cut = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
                    at, ids = np.asarray(g.column(1)), np.asarray(g.column(2))
                    yield from _batches(({"run": int(runs[a]), "at": packed(at[a:b]), "ids": packed(ids[a:b])} for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a), _COUNTED_ARROW)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _pairs(buckets: int):
    """A run and the ids of its frequent n-grams: pairs of neighbours, as the places and questions of the next level."""

    def run(state: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if state.num_rows and replies.num_rows:
            s = state.slice(0, 1).to_pylist()[0]
            places, weights = unpacked(s["places"]), unpacked(s["weights"])
            ids = np.full(int(places.max(initial=-1)) + 2, -1, np.int64)  # the last one is for places without an n-gram
            for at, own in zip(replies["at"].to_pylist(), replies["ids"].to_pylist(), strict=True):
                ids[unpacked(at)] = unpacked(own)
            g = ids[places]
            both = np.flatnonzero((g[:-1] >= 0) & (g[1:] >= 0))
            if len(both):
                order = np.lexsort((g[both + 1], g[both]))
                x, y = g[both][order], g[both + 1][order]
                first = np.ones(len(x), bool)
                first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                number = np.empty(len(x), np.int64)
                number[order] = np.cumsum(first) - 1
                x, y = x[first], y[first]
                w = sums(number, weights[both], len(x))
                # Pairs that are not neighbours are kept apart by a place without one.
                gap = np.concatenate([[False], np.diff(both) > 1])
                to = np.arange(len(both)) + np.cumsum(gap)
                places, kept = np.full(int(to[-1]) + 1, -1, np.int64), np.zeros(int(to[-1]) + 1, np.int64)
                places[to], kept[to] = number, weights[both]
                rows.append({"run": s["run"], "bucket": -1, "places": packed(places), "weights": packed(kept)})
                b = bucket_of_pairs(x, y, buckets)
                for own in by_bucket(b):
                    rows.append({"run": s["run"], "bucket": int(b[own[0]]), "x": packed(x[own]), "y": packed(y[own]), "w": packed(w[own]), "places": packed(own)})
        return pa.Table.from_pylist(rows, _ARROW)

    return run


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """(for each length the written table (id, lang, word, x, y, f) of phrases with ``f >= least``, the table (lang, n))."""
    spark = docs.sparkSession
    ship(spark)
    distinct = pieces(docs, text_col, lang_col)
    # Buckets follow the input's bytes (texts are at most repeated, so pieces are no more).
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))
    state = materialise(distinct.mapInArrow(lean(_words(buckets)), _STATE), "runs")
    release(spark)
    totals = materialise(state.where("bucket = -1").select(F.explode(F.arrays_zip("langs", "tokens")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.tokens").alias("n")), "tokens")
    grams = []
    for level in range(1, longest + 1):
        asked = state.where("bucket >= 0").repartitionById(buckets, "bucket")
        counted = materialise(asked.mapInArrow(lean(_count(least, level, level < longest)), _COUNTED), "counted")
        release(spark)
        grams.append(counted.where(F.col("id").isNotNull()))
        if level == longest:
            drop(state)
            break
        replies = counted.where(F.col("id").isNull()).select("run", "at", "ids")
        runs = state.where("bucket = -1").select("run", "places", "weights")
        new = materialise(runs.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(_pairs(buckets), _STATE), "runs")
        drop(state)
        release(spark)
        state = new
    return grams, totals


def chained(grams: list[DataFrame]) -> list[DataFrame]:
    """For each length (id, x, y, lang, phrase, last, a, heads, tails): counts of the first 1, 2, ... and of the last 1, 2, ... words."""
    out = [materialise(grams[0].select("id", "x", "y", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("a"), F.array("f").alias("heads"), F.array("f").alias("tails")), "chain")]
    for g in grams[1:]:
        head = out[-1].select(F.col("id").alias("x"), "lang", "phrase", F.col("heads").alias("_heads"))
        tail = out[-1].select(F.col("id").alias("y"), "last", F.col("tails").alias("_tails"))
        own = g.select("id", "x", "y", F.col("f").alias("a")).join(head, "x").join(tail, "y")
        grown = lambda c: F.concat(c, F.array("a"))
        out.append(materialise(own.select("id", "x", "y", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", grown(F.col("_heads")).alias("heads"), grown(F.col("_tails")).alias("tails")), "chain"))
    return out


def weakest_cut(k: int) -> str:
    """SQL of (score, k, l, r) of the cut with the lowest score, the first of several; decimals hold all products."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    cuts = []
    for j in range(1, k):
        left, right = f"heads[{j - 1}]", f"tails[{k - j - 1}]"
        cuts.append(f"named_struct('score', ({wide('a')} * {SCALE}BD) div ({wide(left)} + {wide(right)}), 'k', {j}, 'l', {left}, 'r', {right})")
    return f"array_min(array({', '.join(cuts)}))"


def report(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    grams, totals = count_phrases(docs, longest, least, text_col, lang_col)
    chain = chained(grams)
    kept = []
    for k in range(2, longest + 1):
        own = chain[k - 1]
        if k < longest:  # a longer phrase that covers this one has a part of k + 1 words that does
            over = chain[k].select(F.explode(F.array("x", "y")).alias("id"), F.col("a").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
            own = own.join(over, "id", "left").where(f"over is null or 100BD * cast(over as decimal(20,0)) < {covered}BD * cast(a as decimal(20,0))")
        kept.append(own.select("id", "lang", "phrase", "a", F.expr(weakest_cut(k)).alias("cut")))
    found = kept[0]
    for t in kept[1:]:
        found = found.unionByName(t)
    found = found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod("id", F.lit(64)).alias("salt"))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    # First within parts of a language, so that no task ranks all its phrases.
    found = found.withColumn("rank", F.row_number().over(best("lang", "salt"))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(best("lang")).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
