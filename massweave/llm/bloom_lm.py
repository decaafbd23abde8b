"""LM scoring with a log-frequency Bloom filter.

Counts of words and of word pairs are quantised on a logarithmic scale and stored as
membership alone: an n-gram of level q is entered with each of the levels 1..q, and
reading probes level after level until one is missing.  The filter holds every n-gram and
grows with them, so it is not broadcast: it lies in groups of ranges of the n-grams' hash, whose
number follows the tokens, so that a group stays of one size.  The hashes of a run of
texts travel to their groups, sorted and as differences, and the levels travel back.  The
levels give the counts of an interpolated bigram model over all words.  Beside it stands the
exact unigram score, whose counts of rare words come by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, release, remainder, ship
from .textvec import Words, mix, slices

#: Words whose exact counts are broadcast at most (the rest comes by a join).
HOT = 1 << 19
#: Bits for one level of an n-gram, and probes for it: one in 200 absent n-grams is taken for one seen once.
KEY_BITS, PROBES = 12, 5
#: Bits of an n-gram's hash: one in 2**45 / n pairs of n n-grams is confounded.
HASH_BITS = 45
#: Training tokens for each group of the filter (a group has at most twice as many n-grams, and is one task's).
GROUP_TOKENS = 1 << 21
#: Bytes of text whose n-grams are asked for together.
RUN = 1 << 21
#: Levels of a doubling of the count.
STEPS = 2
#: Weight of the pair model.
LAMBDA = 0.7
#: Fixed value: added to every count.
ADD = 0.1
_PAIR = np.uint64(0xA0761D6478BD642F)
#: Hash of the end of a text.
END = np.uint64(0x1)
#: N-grams that a task sums up before it sends them.
FLUSH = 1 << 22
#: Hashes of a group that are probed together: a call costs the same for few.
PROBED = 1 << 17
#: Highest level that a count can have.
TOP = STEPS * 63 + 1


def level_of(count: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(count) + 1e-9).astype(np.int64) + 1


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle, on the log scale, of the counts of a level; 0 for level 0."""
    low = np.ceil(2.0 ** ((level - 1) / STEPS) - 1e-9)
    high = np.maximum(low, np.ceil(2.0 ** (level / STEPS) - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


class Filter:
    """Bits of one group."""

    def __init__(self, bits: np.ndarray, top: int = TOP):
        self.bits, self.top = bits, top  # uint8; highest level that any n-gram has

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, key_bits: int = KEY_BITS) -> Filter:
        q = level_of(counts)
        out = cls(np.zeros(max(8, -(-int(q.sum()) * key_bits // 8)), np.uint8))
        rows = np.repeat(np.arange(len(q)), q)
        level = np.arange(len(rows)) - np.repeat(np.cumsum(q) - q, q) + 1
        bits = np.zeros(len(out.bits) * 8, bool)
        for at in out._places(hashes[rows], level):
            bits[at] = True
        out.bits = np.packbits(bits, bitorder="little")
        return out

    def _places(self, hashes: np.ndarray, level: np.ndarray | int) -> Iterator[np.ndarray]:
        g = mix(hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a, b, m = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1), np.uint64(len(self.bits) * 8)
        for i in range(PROBES):
            yield ((a + np.uint64(i) * b) % m).astype(np.int64)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash: probes go on until a level is missing, to ``top`` at most."""
        out = np.zeros(len(hashes), np.int64)
        live = np.arange(len(hashes))
        for q in range(1, self.top + 1):
            if not len(live):
                break
            hit = np.ones(len(live), bool)
            for at in self._places(hashes[live], q):
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = q
        return out


@dataclass
class Model:
    hot: np.ndarray  # sorted hashes of frequent words
    hot_count: np.ndarray
    total: int  # N
    distinct: int  # V
    ends: int  # training texts
    groups: int

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words; 0 for others."""
        if not len(self.hot):
            return np.zeros(len(keys), np.int64)
        k = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return np.where(self.hot[k] == keys, self.hot_count[k], 0)


def tokens(w: Words, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words with one END behind each text, bounds)."""
    h = w.hashes() | np.uint64(4)  # apart from END
    n = np.diff(w.bounds) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(bounds[-1]), np.uint64)
    end = bounds[1:] - 1
    words = np.ones(len(out), bool)
    words[end] = False
    out[words] = h
    out[end] = END
    return out, bounds


def pairs_of(u: np.ndarray, inv: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each distinct pair of a word and the one before it, place of each token's pair); END stands before the first.

    u, inv: sorted distinct tokens and the place of each token.
    """
    before = np.empty(len(inv), np.int64)
    before[1:] = inv[:-1]
    before[bounds[:-1]] = np.searchsorted(u, END)
    pu, pinv = np.unique(before * len(u) + inv, return_inverse=True)
    return mix(u[pu // len(u)] * _PAIR + u[pu % len(u)]) | np.uint64(4), pinv


def hashes_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys) >> np.uint64(64 - HASH_BITS)


def group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    return (hashes * np.uint64(groups) >> np.uint64(HASH_BITS)).astype(np.int64)


def coded(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first and 32-bit differences; as they are where a difference is longer."""
    step = np.diff(hashes)
    if len(hashes) < 2 or step.max() >> np.uint64(32):
        return hashes.tobytes() + b"\x00"
    return hashes[:1].tobytes() + step.astype(np.uint32).tobytes() + b"\x01"


def decoded(raw) -> np.ndarray:
    raw = memoryview(raw)
    if raw[-1] == 0:
        return np.frombuffer(raw[:-1], np.uint64)
    step = np.frombuffer(raw[8:-1], np.uint32).astype(np.uint64)
    return np.frombuffer(raw[:8], np.uint64)[0] + np.concatenate([np.zeros(1, np.uint64), np.cumsum(step)])


def _split(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups that sorted hashes fall into, bounds of their ranges)."""
    some, start = np.unique(group_of(hashes, groups), return_index=True)
    return some, np.append(start, len(hashes))


def ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, place of each token's, bounds of the texts, keys of the distinct pairs, place of each token's pair)."""
    t, bounds = tokens(Words(buf, off, lower=True), len(off) - 1)
    u, inv = np.unique(t, return_inverse=True)
    return u, inv, bounds, *pairs_of(u, inv, bounds)


def _words(rows: DataFrame) -> DataFrame:
    """(key, c): exact counts of all tokens; a task sums up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            u, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["key", "c"])

        for batch in batches:
            for a, b, buf, off in slices(batch.column(0), RUN):
                t, _ = tokens(Words(buf, off, lower=True), b - a)
                held.append(np.unique(t, return_counts=True))
                if sum(len(k) for k, _ in held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    return rows.select("_t").mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def _build(rows: DataFrame, groups: int, key_bits: int) -> DataFrame:
    """The filter of all words and pairs as a table (g, bits): each group is summed up and filled by one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.uint32)
            held.clear()
            some, cut = _split(h, groups)
            blobs = [coded(h[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            counts = [c[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["g", "h", "c"])

        for batch in batches:
            for _, _, buf, off in slices(batch.column(0), RUN):
                u, inv, _, keys, pinv = ngrams(buf, off)
                held.append((hashes_of(np.concatenate([u, keys])), np.concatenate([np.bincount(inv, minlength=len(u)), np.bincount(pinv, minlength=len(keys))])))
                n += len(u) + len(keys)
                if n > FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            h, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(place, np.concatenate([x for _, x in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([Filter.of(h, c, key_bits).bits.tobytes()], pa.binary())], ["g", "bits"])

        at, held = None, []
        for batch in batches:
            for k, g in enumerate(batch.column(0).to_pylist()):
                if g != at and at is not None:
                    yield done()
                    held = []
                at = g
                held.append((decoded(batch.column(1)[k].as_py()), np.frombuffer(batch.column(2)[k].as_py(), np.uint32)))
        if at is not None:
            yield done()

    sent = rows.select("_t").mapInArrow(count, "g int, h binary, c binary")
    return materialise(sent.repartition(groups, "g").sortWithinPartitions("g").mapInArrow(fill, "g int, bits binary"), "filter")


def _hot(single: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the most frequent words, at most ``HOT``, from the least count that leaves so few."""
    tall = single.groupBy(F.floor(F.log2("c") * 8).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("q")).collect()  # some hundred rows
    least, seen = None, 0
    for r in tall:
        seen += r.n
        if seen > HOT:
            break
        least = r.c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = single.where(F.col("c") >= least).select("key", "c").toArrow()
    k, c = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
    order = np.argsort(k)
    return k[order], c[order]


def fit(train: DataFrame, key_bits: int = KEY_BITS) -> tuple[Model, DataFrame, DataFrame]:
    """(model, filter, exact counts of all training words); train: text column ``_t``."""
    spark = train.sparkSession
    single = materialise(_words(train), "words")
    end = F.col("key") == int(END)
    total, distinct, ends = single.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(end, F.col("c"))), F.lit(0))).first()
    hot, hot_count = _hot(single.where(~end))
    groups = max(1, -(-int(total) // GROUP_TOKENS))
    flt = _build(train, groups, key_bits)
    release(spark)
    return Model(hot, hot_count, int(total), int(distinct), int(ends), groups), flt, single


def _pack(buf: np.ndarray, off: np.ndarray, rk: np.ndarray) -> bytes:
    """A run of texts, compressed: their number, offsets, row keys and bytes."""
    raw = b"".join([np.array([len(rk)], np.int64).tobytes(), np.asarray(off, np.int64).tobytes(), rk.astype(np.int64).tobytes(), buf.tobytes()])
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blob = memoryview(blob)
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.uint8, offset=16 + 16 * n), np.frombuffer(raw, np.int64, n + 1, 8), np.frombuffer(raw, np.int64, n, 16 + 8 * n)


def _asked(u: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of all n-grams of a run, place of each word's and pair's)."""
    return np.unique(hashes_of(np.concatenate([u, keys])), return_inverse=True)


def _read(runs: DataFrame, flt: DataFrame, m: Model) -> DataFrame:
    """(chunk, g, levels): the levels of the n-grams of each run, by groups."""
    groups, top = m.groups, int(level_of(np.array([max(m.total, 1)]))[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk in enumerate(batch.column(0).to_pylist()):
                u, _, _, keys, _ = ngrams(*_unpack(batch.column(1)[k].as_buffer())[:2])
                h, _ = _asked(u, keys)
                some, cut = _split(h, groups)
                blobs = [coded(h[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(n, chunk, np.int64)), pa.array(blobs, pa.binary())], ["g", "chunk", "blob"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        held: list[tuple[int, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            q = part.levels(np.concatenate([h for _, h in held])).astype(np.uint8)
            cut = np.cumsum([0] + [len(h) for _, h in held]).tolist()
            blobs = [q[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array(np.full(len(held), at, np.int32)), pa.array(blobs, pa.binary())], ["chunk", "g", "blob"])
            held.clear()
            return out

        for batch in batches:
            n = 0
            for k, (g, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = batch.column(2)[k].as_buffer()
                if chunk is None:
                    if held:
                        yield done()
                        n = 0
                    at, part = g, Filter(np.frombuffer(bytes(raw), np.uint8), top)
                    continue
                h = decoded(raw)
                if at != g:  # a group without a filter
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([g], pa.int32()), pa.array([bytes(len(h))], pa.binary())], ["chunk", "g", "blob"])
                    continue
                held.append((chunk, h))
                n += len(h)
                if n >= PROBED:
                    yield done()
                    n = 0
            if held:
                yield done()

    asked = runs.select("chunk", "blob").mapInArrow(ask, "g int, chunk bigint, blob binary")
    own = flt.select("g", F.lit(None).cast("bigint").alias("chunk"), F.col("bits").alias("blob"))
    dealt = own.unionByName(asked).repartition(groups, "g").sortWithinPartitions("g", F.asc_nulls_first("chunk"))
    return dealt.mapInArrow(probe, "chunk bigint, g int, blob binary")


def run_scores(m: Model, buf: np.ndarray, off: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a run under the interpolated model; levels: as they were asked for."""
    u, inv, bounds, keys, pinv = ngrams(buf, off)
    _, place = _asked(u, keys)
    q = count_of(levels.astype(np.int64))[place]
    q1, joint = q[: len(u)], q[len(u) :]
    q1[u == END] = m.ends
    d = m.total + ADD * (m.distinct + 1)
    p1 = ((q1 + ADD) / d)[inv]
    # Tokens before: END once a text, frequent words by their exact counts, others by the filter.
    exact = m.counts(u)
    of_word = np.where(exact > 0, exact, q1)
    of = np.empty(len(inv))
    of[1:] = of_word[inv[:-1]]
    of[bounds[:-1]] = m.ends
    p2 = np.minimum(joint[pinv] / np.maximum(of, 1), 1.0)
    return np.add.reduceat(np.log10((1 - LAMBDA) * p1 + LAMBDA * p2), bounds[:-1])


def _finish(runs: DataFrame, levels: DataFrame, groups: int, shared) -> DataFrame:
    """(rk, score): each run meets the levels of its n-grams."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run, held = None, None, []

        def done() -> pa.RecordBatch:
            buf, off, rk = _unpack(run)
            s = run_scores(shared.value, buf, off, np.frombuffer(b"".join(held), np.uint8))
            return pa.RecordBatch.from_arrays([pa.array(rk), pa.array(s)], ["rk", "score"])

        for batch in batches:
            chunk, g = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                blob = batch.column(2)[k].as_py()
                if g[k] < 0:
                    if at is not None:
                        yield done()
                    at, run, held = chunk[k], blob, []
                else:
                    held.append(blob)
        if at is not None:
            yield done()

    both = runs.select("chunk", F.lit(-1).alias("g"), "blob").unionByName(levels)
    return both.repartition(groups, "chunk").sortWithinPartitions("chunk", "g").mapInArrow(meet, "rk bigint, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, key_bits: int = KEY_BITS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Jobs run when this is called.  Trains on the rows whose id has a remainder other than 0
    (a null id counts as the empty text).  Null and empty texts have the end token alone.
    Repeated ids stay rows of their own.  Without training rows every count is 0.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    model, flt, counts = fit(rows.where(remainder("_id", folds) != 0), key_bits)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        d = m.total + ADD * (m.distinct + 1)
        end_log = np.log10((m.ends + ADD) / d)
        names = ["rk", "_id", "key", "n", "known", "base", "chunk", "blob"]
        for batch in batches:
            for a, b, buf, off in slices(batch.column(2), RUN):
                t, bounds = tokens(Words(buf, off, lower=True), b - a)
                u, inv = np.unique(t, return_inverse=True)
                exact = m.counts(u)
                term = np.where(u == END, end_log, np.where(exact > 0, np.log10((exact + ADD) / d), 0.0))
                known = (exact > 0) | ((u == END) & (m.ends > 0))
                base = np.add.reduceat(term[inv], bounds[:-1])
                n_known = np.add.reduceat(known[inv].astype(np.int64), bounds[:-1])
                rk = batch.column(0).slice(a, b - a)
                none = pa.nulls(b - a, pa.int64())
                kind = batch.column(1).type
                yield pa.RecordBatch.from_arrays([rk, batch.column(1).slice(a, b - a), none, pa.array(np.diff(bounds)), pa.array(n_known), pa.array(base), none, pa.nulls(b - a, pa.binary())], names)
                key = rk.to_numpy()
                one = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([one, pa.nulls(1, kind), one, one, one, pa.nulls(1, pa.float64()), pa.array(key[:1]), pa.array([_pack(buf, off, key)], pa.binary())], names)
                rare = np.flatnonzero(((exact == 0) & (u != END))[inv])
                if len(rare):
                    who = np.searchsorted(bounds, rare, "right") - 1
                    n = len(rare)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[who]), pa.nulls(n, kind), pa.array(t[rare].view(np.int64)), pa.array(np.ones(n, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                        names,
                    )

    keyed = rows.select(F.monotonically_increasing_id().alias("rk"), "_id", "_t")
    # Written once, so that the row keys of all kinds of rows agree.
    got = materialise(keyed.mapInArrow(run, f"rk bigint, _id {kind}, key bigint, n bigint, known bigint, base double, chunk bigint, blob binary"), "scored")
    d = model.total + ADD * (model.distinct + 1)
    rare = got.where(F.col("key").isNotNull()).select("rk", "key", "n")
    held = rare.join(counts.select("key", "c"), "key", "left")
    c = F.coalesce("c", F.lit(0))
    sums = held.groupBy("rk").agg(F.sum(F.col("n") * F.log10((c + ADD) / F.lit(d))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("also"))
    sums = materialise(sums, "rare")
    drop(counts)
    release(spark)
    runs = got.where(F.col("chunk").isNotNull())
    # The n-grams that travelled are dropped before the runs travel.
    levels = materialise(_read(runs, flt, model), "levels")
    drop(flt)
    release(spark)
    scored = _finish(runs, levels, model.groups, shared)
    out = got.where(F.col("key").isNull() & F.col("chunk").isNull()).select("rk", "_id", "n", "known", "base").join(sums, "rk", "left").join(scored, "rk")
    return out.select(
        F.col("_id").alias(id_col),
        (remainder("_id", folds) == 0).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
