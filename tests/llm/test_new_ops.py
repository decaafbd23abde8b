"""op11 to op13 against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from massweave.llm import collocations, fagin, queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# --- op11 ------------------------------------------------------------------------------


def words_of(rows, least_length, least_count):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def variants_of(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w in out:
        r = w
        while out[r][0]:
            r = out[r][0]
        out[w][1] = r
    return {(w, *v) for w, v in out.items()}


def spelled(n=400, seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababab", "ÀÀÀÀÀ", "straße", "x" * 300, "x" * 299]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.choice([0, 5, 60])):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcéD") + w[k:], w[:k] + rng.choice("abcéD") + w[k + 1 :]])
            out.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "œ", "1"]).join(out)))
    chain = "zzzzza " * 20 + "zzzzzab " * 9 + "zzzzzabc " * 4
    return rows + [(n + 1, chain), (None, "Straße " * 5), (n, None), (n, ""), (7, rows[7][1]), (7, rows[7][1])]


def test_variants_equal_brute_force(spark):
    rows = spelled()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").withColumn("n", F.lit(0))
    got = {tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_of(words_of(rows, 5, 3))
    assert any(r[1] and r[2] != r[1] for r in got)  # some chain has several steps


def test_every_near_pair_shares_a_key():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(300)} | {"".join(rng.choice("abcd") for _ in range(rng.randint(5, 6))) for _ in range(300)})
    grams = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    ranks = {g: k for k, g in enumerate(sorted(grams, key=lambda g: (grams[g], g)))}
    keys = {(w, longer): {k for at in spelling.rarest(w, ranks) for k in spelling.join_keys(w, at, longer)} for w in words for longer in (False, True)}
    for a in words:
        for b in words:
            if one_edit(a, b) and len(a) <= len(b):
                assert keys[a, False] & keys[b, len(b) > len(a)], (a, b)


def test_no_join_of_words_is_broadcast(spark):
    """Spark sizes the keys like the words, a dozen times too low, and would send them through the driver."""
    seen = []
    plan = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString())
    words = spelling.materialise(spark.createDataFrame([(f"aaaa{k}", k) for k in "bcdef"], "word string, n string").withColumn("n", F.lit(3).cast("long")), "words")
    plan(spelling.near_pairs(words))
    plan(spelling.forms(words))
    plan(spelling.variants(spark.createDataFrame(spelled(30), "doc_id long, text string")))
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in seen)


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "ab cd ab")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


# --- op12 ------------------------------------------------------------------------------


def topk_of(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in ok if i is not None and i % 50 == 0}:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), 2**63 if j is None else j) for j, v in ok if j != i)[:k]
        out |= {(i, r + 1, None if j == 2**63 else j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e12])
def test_topk_equals_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * scale * rng.choice([0, 1], 8)).astype(np.float32).tolist()) for i in range(260)]
    rows[3] = (3, rows[100][1])
    rows[9] = (9, rows[100][1])
    rows += [(7, None), (11, []), (None, rows[100][1]), (12, [1.0, None]), (50, [float("nan")] * 8), (150, [float("inf")] * 8), (13, [scale, scale]), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {tuple(r) for r in fagin.search(df, df.where("vec_id % 50 = 0"), 5, rows=64, asked=3).collect()}
    assert got == topk_of(rows)


def test_walk_stops_early_and_is_exact():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(4000, 3)) ** 5)
    ids = rng.permutation(4000).astype(np.int64)
    for j, best, score, scored in fagin.threshold_topk(x, ids, x[:20], ids[:20], 5):
        every = sorted((-(x[i] @ x[j]), ids[i]) for i in range(4000) if i != j)[:5]
        assert [(-s, i) for s, i in zip(score.tolist(), ids[best].tolist())] == every
        assert scored < 3999
    got = list(fagin.threshold_topk(np.zeros((10, 0)), np.arange(10), np.zeros((1, 0)), np.array([4]), 5))
    assert got[0][1].tolist() == [0, 1, 2, 3, 5]


def test_topk_repeated_rows_and_empty_tables(spark):
    rows = [(1, [1.0])] * 9 + [(0, [1.0])] * 2 + [(2, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in fagin.search(df, df.where("vec_id = 0"), 5).collect())
    assert got == [(0, 1, 2, 131072)] + [(0, r, 1, 65536) for r in range(2, 6)]
    assert fagin.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert sorted(con.execute(queries.OP12_SQL).fetchall()) == sorted(tuple(r) for r in queries.op12_fagin_topk(spark, d).collect())


# --- op13 ------------------------------------------------------------------------------


def phrases_of(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i : i + k]] = max(over[p[i : i + k]], a)
        rows = []
        for p, a in cand.items():
            if 100 * over[p] >= 80 * a and over[p]:
                continue
            s, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def said(n=300, seed=2):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "York", "city", "É", "　", "a'b", "x\x0by", "very", "long", "#"]
    rows = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 6, 40]))]
        rows.append((rng.choice([" ", "  ", "\t", " , ", "."]).join(w) + rng.choice(["", "! new york city hall", "\nNEW  YORK\tcity hall."]), rng.choice(["en", "de", None, "und", "e\nn"])))
    return rows + [(None, "en"), ("", None), (" \t ", "en"), (rows[5][0], rows[5][1]), (" ".join(["same"] * 5000), "de")]


@pytest.mark.parametrize("least, top", [(30, 2000), (4, 7)])
def test_phrases_equal_brute_force(spark, least, top, monkeypatch):
    monkeypatch.setattr(collocations, "RUN_BYTES", 400)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 3000)
    rows = said()
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, word string")
    got = sorted(tuple(r) for r in collocations.report(docs, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = phrases_of(rows, least, top)
    assert got == want and want


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [("one two.", "en")]):
        assert collocations.report(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_packed_integers():
    for a in (np.zeros(0, np.int64), np.array([-1, 0, 2**62, -(2**63)]), np.arange(1000) << 40):
        assert collocations.unpacked(collocations.packed(a)).tolist() == a.tolist()


def test_cut_beyond_64_bits(spark):
    df = spark.createDataFrame([(2**62, [2**62, 2**62], [2**62, 2**62])], "a long, heads array<long>, tails array<long>")
    assert df.select(F.expr(collocations.weakest_cut(2)).alias("c")).first().c.score == 1_000_000


# --- op1: the training sample ----------------------------------------------------------


def test_one_long_text_costs_no_other():
    from massweave.llm.toxicity_crf import within

    assert within([(1, 10, 5), (2, 11, 900), (3, 12, 5), (4, 13, 91), (5, 14, 90)], 100) == [10, 12, 14]
    assert within([(1, 10, 500), (2, 11, 400)], 100) == [11] and within([], 100) == []


def test_fit_learns_beside_a_long_labelled_text(spark):
    from massweave.llm import toxicity_crf

    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(30)) + (" vile scum" if i % 2 else "")) for i in range(300)]
    first = min((i for i, _ in rows if i % 2), key=lambda i: zlib.crc32(str(i).encode()))
    rows = [(i, t + " " + "word " * 30000 if i == first else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity_crf.fit(docs, labels, sample_bytes=100_000)
    got = {r.doc_id: r.predicted for r in toxicity_crf.score(docs, model).collect()}
    assert sum(got[i] == i % 2 for i, _ in rows if i != first) > 290
