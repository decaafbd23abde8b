"""Toxicity: a two-label linear-chain conditional random field over tokens.

Training takes a bounded sample of labelled documents.  Their document labels are
turned into token labels (a small set of word and prefix features that explains
the toxic documents and hardly occurs in others), the field is fitted to those
labelled tokens, and a logistic layer maps what the forward-backward marginals of
a document add up to into its score.

Scoring is exact over the whole chain of a document.  The chain is cut into blocks
of ``BLOCK`` tokens; the 2x2 products of the blocks are computed for all blocks of
a batch at once and then chained, which gives each block its exact start and end
messages, so no text is cut or windowed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, materialise, remainder, ship
from .textvec import ALNUM, Words, list_array, slices

#: Documents of each label in the training sample (the bound of the fit).
SAMPLE = 1000
#: Bytes of their texts for each label at most.
SAMPLE_BYTES = 2 << 20
#: Slots of each kind of hashed feature, as a power of two.
BITS = 16
BLOCK = 32
PREFIXES = (4, 5, 6)


def token_features(w: Words) -> np.ndarray:
    """Feature slots of every token, one row for each kind: the word and its byte prefixes."""
    out = np.empty((1 + len(PREFIXES), len(w)), np.int64)
    out[0] = (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    for k, n in enumerate(PREFIXES, 1):
        h = w.hashes(w.starts, np.minimum(w.starts + n, w.ends))
        out[k] = (h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS)
    return out


@dataclass
class Model:
    weights: np.ndarray  # emission weight of each feature slot (toxic against clean)
    bias: float
    trans: np.ndarray  # transition factors [from, to]
    start: np.ndarray  # factors of the first label
    layer: np.ndarray  # document layer: weights of the pooled marginals, then its bias


def emissions(model: Model, w: Words) -> np.ndarray:
    e = np.full(len(w), model.bias)
    for row in token_features(w):
        e += model.weights[row]
    return np.clip(e, -20.0, 20.0)


def marginals(emit: np.ndarray, bounds: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posterior probability of label 1 for each token; chains are bounds[i]:bounds[i+1].

    With ``pairs`` also the expected transition counts [2, 2] over all chains.
    """
    n_tok = len(emit)
    counts = np.diff(bounds)
    chains = np.flatnonzero(counts)
    if not n_tok:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    blocks = -(-counts[chains] // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(first[-1])
    # Place of every token in the padded block matrix.
    tok_chain = np.repeat(np.arange(len(chains)), counts[chains])
    place = np.arange(n_tok) - bounds[chains][tok_chain] + first[tok_chain] * BLOCK
    e = np.ones(nb * BLOCK)
    e[place] = np.exp(emit)
    live = np.zeros(nb * BLOCK, bool)
    live[place] = True
    e, live = e.reshape(nb, BLOCK).T.copy(), live.reshape(nb, BLOCK).T.copy()
    head = np.zeros((BLOCK, nb), bool)
    head[0, first[:-1]] = True
    a00, a01, a10, a11 = trans.ravel()
    # Products of the blocks, padding as identity, the first token of a chain from the start factors.
    p00 = np.ones(nb)
    p11 = np.ones(nb)
    p01 = np.zeros(nb)
    p10 = np.zeros(nb)
    for t in range(BLOCK):
        on, x = live[t], e[t]
        m00, m01, m10, m11 = a00, a01, a10, a11
        if t == 0:
            h = head[0]
            m00, m10 = np.where(h, start[0], a00), np.where(h, start[0], a10)
            m01, m11 = np.where(h, start[1], a01), np.where(h, start[1], a11)
        q00 = p00 * m00 + p01 * m10
        q01 = (p00 * m01 + p01 * m11) * x
        q10 = p10 * m00 + p11 * m10
        q11 = (p10 * m01 + p11 * m11) * x
        z = 1.0 / (q00 + q01 + q10 + q11)
        p00, p01, p10, p11 = (np.where(on, q * z, p) for q, p in ((q00, p00), (q01, p01), (q10, p10), (q11, p11)))
    # Messages at the block borders, chained over the blocks of each document (longest first).
    order = np.argsort(-blocks, kind="stable")
    fwd = np.zeros(nb)  # share of label 1 before the block
    bwd = np.full(nb, 0.5)  # share of label 1 in the backward message behind the block
    firsts, sizes = first[:-1][order], blocks[order]
    for j in range(1, int(sizes[0])):
        b = firsts[: int(np.searchsorted(-sizes, -j, "left"))] + j
        q, s = b - 1, fwd[b - 1]
        f1 = (1 - s) * p01[q] + s * p11[q]
        f0 = (1 - s) * p00[q] + s * p10[q]
        fwd[b] = f1 / (f0 + f1)
    for j in range(int(sizes[0]) - 2, -1, -1):
        b = firsts[: int(np.searchsorted(-sizes, -(j + 1), "left"))] + j
        q, s = b + 1, bwd[b + 1]
        r0 = p00[q] * (1 - s) + p01[q] * s
        r1 = p10[q] * (1 - s) + p11[q] * s
        bwd[b] = r1 / (r0 + r1)
    # Forward and backward inside the blocks.
    f = np.empty((BLOCK, nb))
    s = fwd
    for t in range(BLOCK):
        g1 = ((1 - s) * a01 + s * a11) * e[t]
        g0 = (1 - s) * a00 + s * a10
        if t == 0:
            h = head[0]
            g1 = np.where(h, start[1] * e[t], g1)
            g0 = np.where(h, start[0], g0)
        s = np.where(live[t], g1 / (g0 + g1), s)
        f[t] = s
    out = np.empty((BLOCK, nb))
    b = bwd
    expected = np.zeros((2, 2))
    for t in range(BLOCK - 1, -1, -1):
        u1 = f[t] * b
        u0 = (1 - f[t]) * (1 - b)
        out[t] = u1 / (u0 + u1)
        if pairs or t:
            r0 = a00 * (1 - b) + a01 * e[t] * b
            r1 = a10 * (1 - b) + a11 * e[t] * b
            if pairs:
                before = f[t - 1] if t else fwd
                ok = live[t] & ~head[t]
                w00 = (1 - before) * a00 * (1 - b)
                w01 = (1 - before) * a01 * e[t] * b
                w10 = before * a10 * (1 - b)
                w11 = before * a11 * e[t] * b
                z = np.where(ok, 1.0 / (w00 + w01 + w10 + w11), 0.0)
                expected += [[(w00 * z).sum(), (w01 * z).sum()], [(w10 * z).sum(), (w11 * z).sum()]]
            b = np.where(live[t], r1 / (r0 + r1), b)
    post = out.T.ravel()[place]
    return (post, expected) if pairs else post


def pooled(post: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per chain: log of one plus the sum of squared marginals, the largest marginal, and the log odds of any.

    Squares keep the many tiny marginals of a long clean text from adding up.
    """
    n = len(bounds) - 1
    sure = post * post
    out = np.zeros((n, 3))
    out[:, 2] = -12  # no token, no toxic one
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        at = bounds[:-1][some]
        out[some, 0] = np.log1p(np.add.reduceat(sure, at))
        out[some, 1] = np.maximum.reduceat(post, at)
        none = np.add.reduceat(np.log1p(-np.minimum(sure, 1 - 1e-9)), at)
        out[some, 2] = np.clip(np.log(-np.expm1(np.minimum(none, -1e-12))) - none, -12, 12)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def label_tokens(feats: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Token labels from document labels.

    A feature may mark toxic tokens if at least ten times the share of toxic documents
    as of clean ones hold it; of these the few that together explain each toxic document
    twice are taken greedily.  A token of a toxic document is toxic if it has one.
    """
    docs = np.repeat(np.arange(len(y)), np.diff(bounds))
    size = (1 + len(PREFIXES)) << BITS
    pos, neg = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    in_docs = []
    df = np.zeros((2, size))
    for row in feats:
        pair = np.unique(docs * np.int64(size) + row)
        d, f = pair // size, pair % size
        df += [np.bincount(f[y[d] == c], minlength=size) for c in (0, 1)]
        in_docs.append((d, f))
    least = max(3, int(0.002 * pos))
    good = (df[1] >= least) & (df[1] / pos >= 10 * (df[0] + 0.5) / neg)
    d = np.concatenate([p[0] for p in in_docs])
    f = np.concatenate([p[1] for p in in_docs])
    keep = good[f] & (y[d] == 1)
    d, f = d[keep], f[keep]
    need = np.where(y == 1, 2, 0)
    chosen = np.zeros(size, bool)
    while len(f):
        gain = np.bincount(f, weights=(need[d] > 0).astype(float), minlength=size)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen[best] = True
        need[d[f == best]] -= 1
        d, f = d[f != best], f[f != best]
    return chosen[feats].any(axis=0) & (y[docs] == 1)


def train(texts: list[str | None], y: np.ndarray, epochs: int = 15) -> Model:
    """Fit token labels, field and document layer.  Without both labels the score is the share of label 1."""
    size = (1 + len(PREFIXES)) << BITS
    model = Model(np.zeros(size, np.float32), -6.0, np.array([[1.0, 0.02], [0.8, 0.2]]), np.array([0.99, 0.01]), np.zeros(4))
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.1
    if not len(y) or y.min() == y.max():
        model.layer[3] = np.log(share / (1 - share))
        return model
    arr = pa.array(texts, pa.string())
    fs, bs, n = [], [np.zeros(1, np.int64)], 0
    for _, _, buf, off in slices(arr):
        w = Words(buf, off, ALNUM, lower=True)
        fs.append(token_features(w))
        bs.append(w.bounds[1:] + n)
        n += len(w)
    feats, bounds = np.concatenate(fs, axis=1), np.concatenate(bs)
    gold = label_tokens(feats, bounds, y)
    if not gold.any():
        model.layer[3] = np.log(share / (1 - share))
        return model
    # The gradient of the log likelihood is observed minus expected counts; AdaGrad steps.
    used, slot = np.unique(feats, return_inverse=True)
    slot = slot.reshape(feats.shape)
    weights, bias = np.zeros(len(used)), -5.0
    logt, logs = np.log(model.trans), np.log(model.start)
    g2, gb2, gt2 = np.full(len(used), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    inner = np.ones(n, bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    prev = np.concatenate([[False], gold[:-1]])
    seen = np.array([[((prev == i) & (gold == j) & inner).sum() for j in (0, 1)] for i in (0, 1)], float)
    start_gold = gold[~inner]
    logs = np.log([(len(start_gold) - start_gold.sum() + 1) / (len(start_gold) + 2), (start_gold.sum() + 1) / (len(start_gold) + 2)])
    scale = 1.0 / max(gold.sum(), 1)
    for _ in range(epochs):
        e = np.clip(weights[slot].sum(axis=0) + bias, -20, 20)
        post, expected = marginals(e, bounds, np.exp(logt), np.exp(logs), pairs=True)
        diff = gold - post
        grad = sum(np.bincount(r, weights=diff, minlength=len(used)) for r in slot) * scale - 1e-4 * weights
        g2 += grad**2
        weights += 0.5 * grad / np.sqrt(g2)
        gb = diff.sum() * scale
        gb2 += gb * gb
        bias += 0.3 * gb / np.sqrt(gb2)
        gt = (seen - expected) * scale
        gt2 += gt**2
        logt += 0.1 * gt / np.sqrt(gt2)
    model.weights[used] = weights
    model.bias, model.trans, model.start = float(bias), np.exp(logt), np.exp(logs)
    e = np.clip(model.weights[feats].sum(axis=0) + model.bias, -20, 20)
    x = pooled(marginals(e, bounds, model.trans, model.start), bounds)
    x1 = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(4)
    for _ in range(30):  # Newton steps of a ridge logistic layer
        p = _sigmoid(x1 @ beta)
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag([0.05, 0.05, 0.05, 0.001]) * 10
        beta += np.linalg.solve(h, x1.T @ (y - p) - np.array([0.5, 0.5, 0.5, 0.01]) * beta)
    model.layer = beta
    return model


def within(sizes: list[tuple[int, int, int]], most: int) -> list[int]:
    """Ids of (hash, id, bytes), in the order of the hash, that fit into ``most`` bytes; a text that does not fit is
    skipped and the next ones are tried, so one long text costs no other.  If none fits, the shortest one is taken."""
    out, left = [], most
    for _, i, n in sorted(sizes):
        if n <= left:
            out.append(i)
            left -= n
    return out or [i for n, _, i in sorted((n, h, i) for h, i, n in sizes)[:1]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, folds: int = 5) -> Model:
    """Train on at most ``sample`` rows and ``sample_bytes`` bytes of each label whose id has a remainder other than 0.

    The rows are those with the smallest hash of the id, so any partitioning gives the
    same sample.  Null labels, null ids and labels without a document do not count.  Runs jobs;
    one task trains on the sample, whose bounds keep it the same for any input.
    """
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (remainder("_id", folds) != 0))
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"))
    parts = [lab.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id")
    # One text for each id, whatever number of rows repeats it.
    rows = rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.min(F.struct(F.xxhash64("_t").alias("h"), "_t"))["_t"].alias("_t"))
    rows = materialise(rows, "labelled")  # ``sample`` of each label at most
    sizes = rows.select("_id", "_y", F.octet_length("_t").alias("n"), F.xxhash64("_id").alias("h")).toArrow().to_pylist()
    kept = {y: within([(r["h"], r["_id"], r["n"]) for r in sizes if r["_y"] == y], sample_bytes) for y in (0, 1)}
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["_id"], r["_t"] or "", r["_y"]) for b in batches for r in b.to_pylist())
        model = train([t for _, t, _ in got], np.array([y for _, _, y in got], int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The sample is bounded, so one task trains on it; the driver gets the weights alone.
    chosen = rows.where(F.col("_id").isin(kept[0] + kept[1])).select("_id", "_y", "_t").repartition(1)
    got = chosen.mapInArrow(lean(run), "model binary").first()
    drop(rows)
    return pickle.loads(got[0]) if got else train([], np.zeros(0, int))  # no labelled text, perhaps no task


def score_batches(model: Model, batches: Iterator[pa.RecordBatch], spans: bool = True) -> Iterator[pa.RecordBatch]:
    """_id, score, and code-point spans of the runs of tokens with a marginal of 0.5 or more."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        scores, begins, finishes = [], [], []
        for a, b, buf, off in slices(texts):
            w = Words(buf, off, ALNUM, lower=True)
            post = marginals(emissions(model, w), w.bounds, model.trans, model.start)
            x = pooled(post, w.bounds)
            scores.append(_sigmoid(np.column_stack([x, np.ones(len(x))]) @ model.layer))
            if spans:
                hot = post >= 0.5
                begins_of = [np.zeros(0, np.int64)] * (b - a)
                ends_of = list(begins_of)
                if hot.any():
                    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
                    rows = np.searchsorted(w.bounds, np.flatnonzero(hot), "right") - 1
                    for i in np.unique(rows).tolist():
                        h = hot[w.bounds[i] : w.bounds[i + 1]].astype(np.int8)
                        edge = np.diff(np.concatenate([[0], h, [0]]))
                        s, e = np.flatnonzero(edge == 1) + w.bounds[i], np.flatnonzero(edge == -1) - 1 + w.bounds[i]
                        begins_of[i] = at[w.starts[s]] - at[off[i]]
                        ends_of[i] = at[w.ends[e]] - at[off[i]]
                begins += begins_of
                finishes += ends_of
        cols = [ids, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
        names = ["_id", "score"]
        if spans:
            cols += [list_array(begins, pa.int64()), list_array(finishes, pa.int64())]
            names += ["span_starts", "span_ends"]
        yield pa.RecordBatch.from_arrays(cols, names)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted, span_starts and span_ends (code points).

    Null texts count as empty; texts without a token get the score of an empty chain.
    Repeated and null ids stay rows of their own.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # fixed size: the feature table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return score_batches(shared.value, batches)

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(lean(run), f"_id {kind}, score double, span_starts array<bigint>, span_ends array<bigint>")
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "span_starts", "span_ends")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at).cast(pa.string())], ["i", "t"])
            s = next(score_batches(shared.value, iter([plain]), spans=False)).column(1).to_numpy()
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
