"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words are compiled, with their token ids as outputs, into a minimal
acyclic automaton (equal suffixes share states).  Each transition carries the
number of words that leave its state by smaller bytes, so the sum along a path is
the word's rank, and the ids are looked up by rank.  The automaton is a handful of
flat arrays in one file, which workers map into memory.  Words that it lacks are
merged exactly, many at a time.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship
from .textvec import ALNUM, Words, slices

#: Fixed value: the split of byte-level BPE into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon, and words that a task proposes for it.
LEXICON = 60_000
PROPOSED = 30_000
#: Characters that are encoded at a time.
RUN = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(spare)] = b
            spare += 1
    return out


#: What a table returns for a key that it lacks.
MISSING = np.iinfo(np.int64).max


class Table:
    """Open-addressed map of 64-bit keys (not -1) to values, built and probed as whole arrays."""

    def __init__(self, key: np.ndarray, val: np.ndarray):
        self.key, self.val, self.mask = key, val, len(key) - 1

    @classmethod
    def of(cls, keys: np.ndarray, vals: np.ndarray) -> Table:
        size = 1 << max(4, (len(keys) * 4 - 1).bit_length()) if len(keys) else 16
        t = cls(np.full(size, -1, np.int64), np.zeros(size, np.int64))
        todo, at = np.arange(len(keys)), t._slot(keys)
        while len(todo):
            free = np.flatnonzero(t.key[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            win = free[first]
            t.key[at[win]] = keys[todo[win]]
            t.val[at[win]] = vals[todo[win]]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, at = todo[rest], (at[rest] + 1) & t.mask
        return t

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(32)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.key[at]
        hit = got == keys
        out = np.where(hit, self.val[at], MISSING)
        open_ = np.flatnonzero(~hit & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.key[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.val[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


class Vocabulary:
    """Tokens and merges of a byte-level BPE file (JSON form)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*model["vocab"].values(), *added.values()]) + 1
        self.bytes = np.empty(n, object)
        self.bytes[:] = b""
        for t, i in model["vocab"].items():
            if t not in added:
                self.bytes[i] = bytes(alphabet[c] for c in t)
        for t, i in added.items():
            self.bytes[i] = t.encode()
        self.specials = dict(sorted(added.items(), key=lambda x: -len(x[0])))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = model["vocab"][c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        v = model["vocab"]
        keys = np.array([(v[a] << 32) | v[b] for a, b in pairs], np.int64)
        made = np.array([v[a + b] for a, b in pairs], np.int64)
        self.merges = Table.of(keys, (np.arange(len(keys)) << 32) | made)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(rank << 32) | merged id of each pair, or a huge number."""
        return self.merges.find(keys)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Exact BPE of many words: in every round each word merges all places of its lowest-ranked pair, left to right."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    lens = np.array([len(w) for w in words], np.int64)
    none = MISSING
    order = np.argsort(lens, kind="stable")
    at = 0
    while at < len(order):
        # Rows of like length share a matrix of at most 2^20 cells (or one row).
        width = int(lens[order[min(len(order), at + 4096) - 1]])
        end = at + max(1, min(4096, (1 << 20) // max(width, 1)))
        rows = order[at:end]
        at += len(rows)
        width = int(lens[rows[-1]])
        if not width:
            continue
        if width > 400:
            for r in rows.tolist():
                out[r] = _merge_long(v, words[r]) if lens[r] > 400 else merge_words(v, [words[r]])[0]
            continue
        s = np.full((len(rows), width), -1, np.int64)
        s[np.arange(width) < lens[rows][:, None]] = v.byte_ids[np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8)]
        n, ids = lens[rows].copy(), np.arange(len(rows))
        while len(ids):
            a, b = s[:, :-1], s[:, 1:]
            if not a.shape[1]:
                break
            val = np.full(a.shape, none, np.int64)
            ok = b >= 0
            val[ok] = v.find((a[ok] << 32) | b[ok])
            best = val.min(axis=1)
            go = best != none
            for i in np.flatnonzero(~go).tolist():
                out[rows[ids[i]]] = s[i, : n[i]].copy()
            s, n, ids, val, best = s[go], n[go], ids[go], val[go], best[go]
            if not len(ids):
                break
            hit = val == best[:, None]
            # In a run of overlapping places (only of one token with itself) take every second from the left.
            if (hit[:, 1:] & hit[:, :-1]).any():
                prev = np.zeros(len(ids), bool)
                for j in range(hit.shape[1]):
                    hit[:, j] &= ~prev
                    prev = hit[:, j]
            new = np.where(hit, best[:, None] & 0xFFFFFFFF, s[:, :-1])
            s = np.concatenate([new, s[:, -1:]], axis=1)
            gone = np.zeros(s.shape, bool)
            gone[:, 1:] = hit
            keep = ~gone & (s >= 0)
            m = keep.sum(axis=1)
            t = np.full((len(ids), int(m.max())), -1, np.int64)
            t[np.arange(t.shape[1]) < m[:, None]] = s[keep]
            s, n = t, m
        for i in range(len(ids)):
            out[rows[ids[i]]] = s[i, : n[i]].copy()
    return out


def _merge_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """Exact BPE of one very long word, by whole-array rounds over distinct ranks.

    Each round merges all places of the lowest-ranked pair, so the rounds are bounded by
    the number of different merges that apply, not by the length.
    """
    s = v.byte_ids[np.frombuffer(word, np.uint8)]
    none = MISSING
    while len(s) > 1:
        val = v.find((s[:-1] << 32) | s[1:])
        best = val.min()
        if best == none:
            break
        hit = val == best
        if (hit[1:] & hit[:-1]).any():
            i = np.flatnonzero(hit)
            run = np.concatenate([[True], np.diff(i) > 1])
            first = np.maximum.accumulate(np.where(run, i, 0))
            hit[i[(i - first) % 2 == 1]] = False
        s = s.copy()
        s[:-1][hit] = best & 0xFFFFFFFF
        keep = np.ones(len(s), bool)
        keep[1:] = ~hit
        s = s[keep]
    return s


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, by incremental minimisation.

    Arrays: ``key`` (state * 256 + byte, sorted), ``to``, ``skip`` (words left behind by
    smaller bytes and an end in the state), ``final``.
    """
    register: dict[tuple, int] = {}
    edges: list[dict[int, int]] = [{}]
    final = [False]

    def close(path: list[tuple[int, int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, byte, child = path.pop()
            sign = (final[child], *edges[child].items())
            if sign in register:
                edges[parent][byte] = register[sign]
            else:
                register[sign] = child

    path: list[tuple[int, int, int]] = []
    last = b""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(path, common)
        state = path[-1][2] if path else 0
        for b in w[common:]:
            edges.append({})
            final.append(False)
            edges[state][b] = len(edges) - 1
            path.append((state, b, len(edges) - 1))
            state = len(edges) - 1
        final[state] = True
        last = w
    close(path, 0)
    # Renumber the states that stay, and count the words below each.
    ids = {0: 0}
    stack, post = [0], []
    while stack:
        s = stack.pop()
        post.append(s)
        for t in edges[s].values():
            if t not in ids:
                ids[t] = len(ids)
                stack.append(t)
    below: dict[int, int] = {}

    def count(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            rest = [t for t in edges[x].values() if t not in below]
            if rest:
                todo += rest
            else:
                below[x] = int(final[x]) + sum(below[t] for t in edges[x].values())
                todo.pop()
        return below[s]

    count(0)
    key, to, skip = [], [], []
    for s in ids:
        n = int(final[s])
        for b, t in sorted(edges[s].items()):
            key.append(ids[s] * 256 + b)
            to.append(ids[t])
            skip.append(n)
            n += below[t]
    order = np.argsort(key)
    fin = np.zeros(len(ids), np.int8)
    for s, i in ids.items():
        fin[i] = final[s]
    pick = lambda x, t: np.array(x, t)[order]
    return {"key": pick(key, np.int64), "to": pick(to, np.int64), "skip": pick(skip, np.int64), "final": fin.astype(np.int64)}


class Lexicon:
    """The compiled automaton with its outputs, in one block of memory."""

    NAMES = ("final", "step_key", "step_val", "out_at", "out")

    def __init__(self, buf: memoryview | bytes | mmap.mmap):
        head = np.frombuffer(buf, np.int64, len(self.NAMES))
        at = len(self.NAMES) * 8
        for name, n in zip(self.NAMES, head.tolist(), strict=True):
            setattr(self, name, np.frombuffer(buf, np.int64, n, at))
            at += n * 8
        self.steps = Table(self.step_key, self.step_val)

    @staticmethod
    def compile(v: Vocabulary, words: list[bytes]) -> bytes:
        words = sorted(set(w for w in words if w))
        a = build_automaton(words)
        ids = merge_words(v, words)
        out_at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        out = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        steps = Table.of(a["key"], (a["to"] << 32) | a["skip"])
        parts = {"final": a["final"], "step_key": steps.key, "step_val": steps.val, "out_at": out_at, "out": out}
        arrays = [np.ascontiguousarray(parts[n], np.int64) for n in Lexicon.NAMES]
        return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)

    def rank(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Rank of every word (bytes flat[start:start+len]), or -1; all words step together."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.final) or not len(starts):
            return out
        live = np.flatnonzero(lens > 0)
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        i = 0
        while len(live):
            got = self.steps.find((state << 8) | flat[starts[live] + i])
            ok = got != MISSING
            live, got = live[ok], got[ok]
            state, total = got >> 32, total[ok] + (got & 0xFFFFFFFF)
            i += 1
            end = lens[live] == i
            if end.any():
                done = end & (self.final[state] == 1)
                out[live[done]] = total[done]
                live, state, total = live[~end], state[~end], total[~end]
        return out


@lru_cache(maxsize=2)
def mapped(digest: str, get) -> Lexicon:
    """The lexicon of this name in mapped memory; its file is unlinked at once, so nothing is left behind."""
    with tempfile.TemporaryFile() as f:
        f.write(get())
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    """Encodes runs of texts; words are told apart once per run, not once per place."""

    def __init__(self, v: Vocabulary, lexicon: Lexicon | None):
        self.v, self.lexicon = v, lexicon
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in v.specials)) if v.specials else None

    def split(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(word bounds per text, word codes, offsets of each code's ids, ids as flat array) in that order of use."""
        flat: list[str] = []
        bounds = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            flat += self.split(t)
            bounds[i + 1] = len(flat)
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        uniq = coded.dictionary
        off = np.frombuffer(uniq.buffers()[1], np.int64)[: len(uniq) + 1] if len(uniq) else np.zeros(1, np.int64)
        data = np.frombuffer(uniq.buffers()[2], np.uint8) if len(uniq) and off[-1] else np.zeros(0, np.uint8)
        starts, lens = off[:-1], np.diff(off)
        rank = self.lexicon.rank(data, starts, lens) if self.lexicon is not None else np.full(len(uniq), -1, np.int64)
        unseen = np.flatnonzero(rank < 0)
        raw = data.tobytes()
        merged = merge_words(self.v, [raw[a : a + n] for a, n in zip(starts[unseen].tolist(), lens[unseen].tolist(), strict=True)])
        for k, i in enumerate(unseen.tolist()):
            if lens[i] < 64 and (w := raw[starts[i] : starts[i] + lens[i]].decode("utf-8", "surrogatepass")) in self.v.specials:
                merged[k] = np.array([self.v.specials[w]], np.int64)
        count = np.zeros(len(uniq), np.int64)
        known = rank >= 0
        if known.any():
            count[known] = self.lexicon.out_at[rank[known] + 1] - self.lexicon.out_at[rank[known]]
        count[unseen] = [len(m) for m in merged]
        at = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(int(at[-1]), np.int64)
        if known.any():
            n = count[known]
            src = np.repeat(self.lexicon.out_at[rank[known]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            dst = np.repeat(at[:-1][known], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[dst] = self.lexicon.out[src]
        if len(unseen):
            n = count[unseen]
            dst = np.repeat(at[:-1][unseen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[dst] = np.concatenate(merged)
        return bounds, codes, at, ids


def gather(codes: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in order, number of ids of each word)."""
    n = (at[1:] - at[:-1])[codes]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return ids[np.repeat(at[:-1][codes] - (end - n), n) + np.arange(total)], n


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of token ids: their bytes in a row, read as UTF-8."""
    return b"".join(v.bytes[ids].tolist()).decode("utf-8", "replace")


def runs(texts: pa.Array, size: int = RUN) -> Iterator[list[str]]:
    """Rows as strings (null: empty), about ``size`` characters at a time."""
    out, n = [], 0
    for t in texts:
        s = t.as_py() or ""
        out.append(s)
        n += len(s)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def frequent_words(docs: DataFrame, text_col: str = "text", keep: int = LEXICON, proposed: int = PROPOSED) -> list[str]:
    """The most frequent words (with the space before them) of all texts, each task proposing its most frequent ones.

    The lexicon only decides which words skip merging, never an id, so a word that a
    task leaves out costs time and nothing else.  Both lists are bounded.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0)):
                w = Words(buf, off, ALNUM)
                at = np.flatnonzero((w.starts > 0) & (buf[np.maximum(w.starts - 1, 0)] == 0x20)) if len(w) else np.zeros(0, np.int64)
                starts, ends = w.starts[at] - 1, w.ends[at]
                _, first, n = np.unique(w.hashes(starts, ends), return_index=True, return_counts=True)
                big = n > 1
                raw = buf.tobytes()
                for i, j, c in zip(starts[first[big]].tolist(), ends[first[big]].tolist(), n[big].tolist(), strict=True):
                    total[raw[i:j]] += c
            if len(total) > 4 * proposed:
                total = Counter(dict(total.most_common(2 * proposed)))
        total = Counter({w.decode(): n for w, n in total.items()})
        top = total.most_common(proposed)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("_t")).mapInArrow(lean(run), "w string, n bigint")
    top = found.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(keep)
    return top.select("w").toArrow().column(0).to_pylist()


def lexicon_bytes(path: str, words: list[str]) -> bytes:
    v = vocabulary(path)
    return Lexicon.compile(v, [w.encode("utf-8", "surrogatepass") for w in words if w not in v.specials])


def _encoder(path: str, digest: str, get) -> Encoder:
    return Encoder(vocabulary(path), mapped(digest, get))


def compiled(docs: DataFrame, path: str, text_col: str = "text"):
    """(digest, broadcast) of the lexicon of ``docs``."""
    blob = lexicon_bytes(path, frequent_words(docs, text_col))
    return hashlib.sha256(blob).hexdigest()[:24], docs.sparkSession.sparkContext.broadcast(blob)


class _Get:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self) -> bytes:
        return self.shared.value

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other) -> bool:
        return isinstance(other, _Get)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    Null texts count as empty: no tokens, the digests of nothing.  Rows that repeat an
    id, or have none, stay rows of their own; no text is cut, whatever its length.
    """
    spark = docs.sparkSession
    ship(spark)
    digest, shared = compiled(docs, path, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    get = _Get(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, digest, get)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n_tok, ids_sha, text_sha, id_rows = [], [], [], []
            for texts in runs(batch.column(1)):
                bounds, codes, at, ids = enc.encode(texts)
                cuts, listed = at.tolist(), list(map(str, ids.tolist()))
                names = [",".join(listed[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                every, per = gather(codes, at, ids)
                ends = np.concatenate([[0], np.cumsum(per)])[bounds].tolist()
                spelt = codes.tolist()
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    mine = every[ends[i] : ends[i + 1]]
                    n_tok.append(len(mine))
                    ids_sha.append(sha(",".join([names[c] for c in spelt[a:b]]).encode()))
                    text_sha.append(sha(decode(enc.v, mine).encode("utf-8", "surrogatepass")))
                    if with_ids:
                        id_rows.append(mine.tolist())
            cols = [batch.column(0), pa.array(n_tok, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names_ = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(id_rows, pa.list_(pa.int64())))
                names_.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names_)

    schema = f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(lean(run), schema)
    return out.withColumnRenamed("_id", id_col)
