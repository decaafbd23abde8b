"""Token counts by offset-mapped attribution.

A document is encoded once, whole.  Every token has a byte span; the spans are
interval-joined to the document's sections, and a token that crosses a border goes
to the section in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _encoder, _Get, compiled, gather, runs
from .common import ship
from .textvec import list_array

#: Sections are what newline bytes end; each newline belongs to the section that it ends.
NEWLINE = 0x0A


def attribute(lengths: np.ndarray, borders: np.ndarray, total: int) -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens cross a border.

    lengths: bytes of the tokens in order; borders: first bytes of the sections
    (the first is 0); total: bytes of the text.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    section = np.searchsorted(borders, starts, "right") - 1
    stop = np.append(borders[1:], total)
    crossing = int((ends > stop[section]).sum()) if len(starts) else 0
    return np.bincount(section, minlength=len(borders)), crossing


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_sections, n_crossing, max_section_tokens, section_tokens (array).

    Sections are lines (a newline ends one; text after the last newline is one more).
    The section counts always add up to n_tokens.  Null and empty texts: no tokens, no
    sections.  Repeated and null ids stay rows of their own.
    """
    spark = docs.sparkSession
    ship(spark)
    digest, shared = compiled(docs, path, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    get = _Get(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, digest, get)
        for batch in batches:
            n_tok, n_cross, parts = [], [], []
            for texts in runs(batch.column(1)):
                bounds, codes, at, ids = enc.encode(texts)
                every, per = gather(codes, at, ids)
                lengths = enc.v.lengths[every]
                ends = np.concatenate([[0], np.cumsum(per)])[bounds].tolist()
                for i, t in enumerate(texts):
                    raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                    if not len(raw):
                        n_tok.append(0)
                        n_cross.append(0)
                        parts.append(np.zeros(0, np.int64))
                        continue
                    borders = np.concatenate([[0], np.flatnonzero(raw[:-1] == NEWLINE) + 1])
                    counts, cross = attribute(lengths[ends[i] : ends[i + 1]], borders, len(raw))
                    n_tok.append(ends[i + 1] - ends[i])
                    n_cross.append(cross)
                    parts.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tok, pa.int64()), pa.array(n_cross, pa.int64()), list_array(parts, pa.int64())],
                ["_id", "n_tokens", "n_crossing", "section_tokens"],
            )

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"_id {kind}, n_tokens bigint, n_crossing bigint, section_tokens array<bigint>")
    return out.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        F.size("section_tokens").cast("long").alias("n_sections"),
        "n_crossing",
        F.coalesce(F.array_max("section_tokens"), F.lit(0)).cast("long").alias("max_section_tokens"),
        "section_tokens",
    )
