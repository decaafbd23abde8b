"""Spelling variants: words one edit apart, by a rare-first prefix filter over positional bigrams.

Bigrams are ordered by the number of words that hold them, rare ones first.  One edit destroys at
most two neighbouring bigrams, so two words one edit apart share one of the three rarest of each,
at places that differ by one at most.  The edit lies on one side of the shared bigram: the other
side agrees whole, and so does one half of the side of the edit.  Words are joined by the hash
of these parts with their places and the length, and each candidate pair is then verified by its
edit distance.  The form of a word is its most frequent near word, if that is frequent enough;
roots follow forms by pointer jumping.

Defined cases: null or empty texts have no words; a null id counts as the empty text in the hash
that decides on deletions; repeated rows count again; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import drop, lean, materialise, release, ship, unsent

#: Runs of letters (Latin-1 letters with the two signs between them).
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Every ``CUT``-th occurrence (by its hash) loses a letter.
CUT = 97
#: Least code points and occurrences of a word; how many times as frequent a form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Bigrams of a word that are joined: twice the edits, and one.
PREFIX = 3
#: Words that a task counts before it sends them.
FLUSH = 1 << 18
#: Letters that a word can hold, lower-cased: a-z and the Latin-1 range.  Bigrams: its square at most.
LETTERS = 26 + 64


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts, after the deletions."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if len(w) - w.count(b"\xc3") >= least_length]  # each letter beyond ASCII begins with this byte
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                start = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for w, n in Counter(RUN.findall(text.as_py() or "")).items():
                    w = w.encode().lower()  # A-Z only
                    h = zlib.crc32(w, start)
                    if h % CUT == 0:
                        letters = w.decode()
                        at = h % len(letters)
                        w = (letters[:at] + letters[at + 1 :]).encode()
                    total[w] += n
                if len(total) > FLUSH:
                    yield out()
        yield out()

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(lean(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of each bigram in the global order, rare ones first (at most ``LETTERS`` squared, so it fits the driver)."""
    grams = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))).alias("g"))
    rows = grams.groupBy("g").count().collect()
    return {r.g: k for k, r in enumerate(sorted(rows, key=lambda r: (r["count"], r.g)))}


def rarest(word: str, ranks: dict[str, int], prefix: int = PREFIX) -> list[int]:
    """Places of the rarest bigrams of the word (ties: the first place)."""
    return sorted(range(len(word) - 1), key=lambda i: (ranks[word[i : i + 2]], i))[:prefix]


def join_keys(word: str, at: int, longer: bool) -> list[str]:
    """What a near word agrees with, if the bigram at ``at`` stays: the side without the edit and a half of the other one.

    ``longer``: keys for near words that are one letter shorter, else of the same length or one letter longer.
    """
    n = len(word) - longer
    out = []
    for side, same, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at])):
        size = len(rest) - longer  # the shorter word's rest
        if size >= 0:
            half = size // 2
            out += [f"{n}{side}{same}<{rest[:half]}", f"{n}{side}{same}>{rest[len(rest) - size + half :]}"]
    return out


def _keys(ranks: dict[str, int], kinds: tuple[bool, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            keys: list[int] = []
            kind: list[bool] = []
            for i, w in enumerate(b.column(0).to_pylist()):
                places = rarest(w, ranks)
                for longer in kinds:
                    own = {xxh3_64_intdigest(k) >> 1 for at in places for k in join_keys(w, at, longer)}
                    keys += own
                    rows += [i] * len(own)
                    kind += [longer] * len(own)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.int64()), pa.array(kind, pa.bool_())], ["word", "n", "key", "longer"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), each pair one edit apart in both directions, from a written table (word, n)."""
    ranks, kind = bigram_ranks(words), "word string, n long, key long, longer boolean"
    left = words.mapInArrow(_keys(ranks, (False,)), kind).select(F.col("word").alias("a"), F.col("n").alias("na"), "key")
    right = words.mapInArrow(_keys(ranks, (False, True)), kind).select(F.col("word").alias("b"), F.col("n").alias("nb"), "key", "longer")
    one = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    found = unsent(left).join(right, "key").where(one).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    both = F.explode(F.array(F.struct("a", "na", "b", "nb"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))))
    return found.select(both.alias("p")).select("p.*")


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of a written table (word, n)."""
    best = F.min(F.struct((-F.col("nb")).alias("n"), "b"))
    near = near_pairs(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= times * F.col("n")
    return words.join(unsent(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form of each word that has one; a written table (word, form) without cycles."""
    cur = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = materialise(cur.join(unsent(ahead), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        drop(cur)
        if not moved:
            return new.select("word", "root")
        cur = new.select("word", "root")
        cur._massweave_path = new._massweave_path


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts."""
    spark = docs.sparkSession
    words = materialise(count_words(docs, id_col, text_col), "words")
    release(spark)
    out = materialise(forms(words), "forms")
    drop(words)
    release(spark)
    last = roots(out.where(F.col("form").isNotNull()))
    return out.join(unsent(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
