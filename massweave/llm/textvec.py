"""Vectorised words, word hashes and shingles over Arrow string batches.

A batch of texts is one byte buffer.  Word borders come from a byte table, and
the 64-bit hash of any byte range comes from one running sum of a polynomial
hash, so the cost per byte is a handful of numpy operations and no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word: space and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes in the sense "anything but white space".
NOT_SPACE = ~SPACE
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_MUL = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 18)
        for i, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def slices(texts: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array (null: empty) into runs of rows of about ``max_bytes``.

    Yields (first row, end row, byte buffer, offsets of the rows in the buffer).
    A longer text makes a run of its own; no text is cut.
    """
    arr = texts.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


class Words:
    """Words of a run of texts.

    starts, ends: byte ranges; bounds: words of row i are bounds[i]:bounds[i+1].
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE, lower: bool = False):
        if lower:
            buf = LOWER[buf]
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        w = word_bytes[buf]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        before[1:] = w[:-1]
        after[:-1] = w[1:]
        first = offsets[:-1]
        first = first[first < n]
        before[first] = False
        after[first[first > 0] - 1] = False
        self.starts = np.flatnonzero(w & ~before)
        self.ends = np.flatnonzero(w & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._sum = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of byte ranges (default: of the words)."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        p, inv = _pow(len(self.buf) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_TABLE[self.buf] * p[:-1], out=self._sum[1:])
        return mix((self._sum[ends] - self._sum[starts]) * inv[starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words of ``h`` (rows not regarded)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _MUL
        out += h[j : j + n]
    return mix(out + np.uint64(k))


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, equal to its window hash at k = its length."""
    return window_hashes(h, len(h))[0]


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row.

    With fewer words the whole sequence is the one shingle; without words the
    set is empty.
    """
    h = words.hashes()
    grams = window_hashes(h, k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif b > a:
            out.append(np.array([sequence_hash(h[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array from one numpy array per row."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))
