"""Sequential folds over sorted rows, cut into blocks of bounded size.

Rows are range-partitioned by key and value, sorted, and packed: one row of the packed table is a
block of at most ``ROWS`` rows, whatever their density.  A fold that opens a group at one row
and closes it at a later one is a jump from row to row, so a block is described by where a group
that comes in from the blocks before lets it go out.  These short descriptions are chained for
each key; then all blocks are assigned in parallel (:func:`anchored`).  Folds whose state has no
such short description pass it from block to block in rounds, in which only blocks whose
entering state has changed run again (:func:`relay`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from ..chem import Tolerance
from ..scratch import drop, few, materialise, ship

#: Rows of a block, and so of the largest frame.
ROWS = 1 << 16

#: Blocks of a round that a filter names.
NAMED = 1000


def pack(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None, few_blocks: bool = False) -> DataFrame:
    """Written table (blk, rows): the rows of ``df`` sorted by ``keys`` and ``order``, in blocks; ``blk`` grows along the order.

    With ``few_blocks`` the blocks are as many as their size asks for, not one for each partition of a shuffle: a fold that
    passes its state on needs as many rounds as a key has blocks.
    """
    spark = df.sparkSession
    ship(spark)
    most = rows or ROWS
    n, written = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    if few_blocks:
        df = written = materialise(df, "unpacked")
        n = -(-df.count() // most) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            s = pa.Table.from_batches(held).combine_chunks().to_struct_array()
            s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
            return pa.RecordBatch.from_arrays([pa.array([blk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), s)], ["blk", "rows"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(most - size, b.num_rows - at)
                held.append(b.slice(at, take))
                size, at = size + take, at + take
                if size == most:
                    yield out()
                    blk, held, size = blk + 1, [], 0
        if size:
            yield out()

    by = [*keys, *order]
    sort = [*by, *[c for c in df.columns if c not in by]]
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*sort)
    out_ = materialise(ranged.mapInArrow(run, StructType([StructField("blk", LongType()), StructField("rows", ArrayType(df.schema))])), "blocks")
    if written is not None:
        drop(written)
    return out_


def starts_of(cols: list[pa.Array], n: int) -> np.ndarray:
    """Where the runs of equal keys begin."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        code = np.asarray(c.dictionary_encode("encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def jumps(m: np.ndarray, starts: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each row as an anchor the first row that its window does not take (the end of its run at most)."""
    run = np.zeros(len(m))
    run[starts[1:]] = 1
    run = np.cumsum(run)
    end = np.append(starts[1:], len(m))[run.astype(np.int64)]
    # Complex numbers are ordered by the run, then by the mass.
    out = np.searchsorted(run + 1j * m, run + 1j * (m + width), "left")
    out = np.maximum(out, np.arange(len(m)) + 1)
    # m - anchor < width can round apart from m < anchor + width at the very border.
    at = np.arange(len(m))
    while (low := (out > at + 1) & ~(m[out - 1] - m < width)).any():
        out[low] -= 1
    while (high := (out < end) & (m[np.minimum(out, len(m) - 1)] - m < width)).any():
        out[high] += 1
    return out


def _entry(m: np.ndarray, end: int, anchor: float, width: float) -> int:
    """The first row (before ``end``) that an anchor from the blocks before does not take."""
    far = ~(m[:end] - anchor < width)
    return int(np.argmax(far)) if far.any() else end


def transfer(m: np.ndarray, to: np.ndarray) -> tuple[float, list[float], list[float]]:
    """Of a block of one key: the last anchor if the block begins the key; and for anchors from before, by the
    largest mass of the rows that they let begin, the last anchor.

    Needs ``mass + width`` to grow with the mass, so that no window from before reaches further than that of the first row.
    """
    n = len(m)
    last = np.arange(n)
    nxt = to.tolist()
    for e in range(n - 1, -1, -1):
        if nxt[e] < n:
            last[e] = last[nxt[e]]
    some = last[: min(nxt[0], n - 1) + 1]
    edge = np.append(np.flatnonzero(np.diff(some)), len(some) - 1)
    return float(m[last[0]]), m[edge].tolist(), m[some[edge]].tolist()


def anchored(df: DataFrame, keys: list[str], tol: Tolerance, mz: str = "mz", out: str = "anchor", rows: int | None = None) -> DataFrame:
    """The rows with the mass that opened their bin: a bin opens at its first mass and takes what follows while
    ``m - anchor < window(anchor)``."""
    packed = pack(df, keys, [mz], rows)
    parts = packed.select("blk", *[F.col(f"rows.{k}").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"rows.{mz}").alias("_m"))
    kinds = [StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    double = "array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cols = [b.column(1 + i)[r].values for i in range(len(keys))]
                m = np.asarray(b.column(1 + len(keys))[r].values)
                starts = starts_of(cols, len(m))
                a = int(starts[-1])
                to = jumps(m[a:], np.zeros(1, np.int64), np.asarray(tol.width_of(m[a:]), float))
                fresh, hi, exits = transfer(m[a:], to)
                rows_ = [(len(m) - 1, len(starts) > 1, True, fresh, hi if len(starts) == 1 else [], exits if len(starts) == 1 else [])]
                if len(starts) > 1:
                    rows_.append((0, False, False, None, [], []))
                at, opens, stays, fresh_, hi_, exits_ = zip(*rows_, strict=True)
                arrays = [c.take(pa.array(at)) for c in cols]
                arrays += [pa.array([b.column(0)[r].as_py()] * len(at), pa.int64()), pa.array(opens, pa.bool_()), pa.array(stays, pa.bool_()), pa.array(fresh_, pa.float64()), pa.array(hi_, pa.list_(pa.float64())), pa.array(exits_, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*[f"_k{i}" for i in range(len(keys))], "blk", "opens", "stays", "fresh", "hi", "exits"])

    found = StructType([*kinds, *StructType.fromDDL(f"blk long, opens boolean, stays boolean, fresh double, hi {double}, exits {double}").fields])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        got, a = [], None
        for r in pdf.sort_values("blk").itertuples(index=False):
            if r.opens:
                a = r.fresh
                continue
            if a is not None:
                got.append((r.blk, a))
            if r.stays:
                if a is None:
                    a = r.fresh
                elif (far := ~(np.asarray(r.hi) - a < float(tol.width_of(a)))).any():
                    a = float(r.exits[int(np.argmax(far))])
        return pd.DataFrame(got, columns=["blk", "entry"]).astype({"blk": "int64", "entry": "float64"})

    links = parts.mapInArrow(scan, found)
    group = [f"_k{i}" for i in range(len(keys))] or [F.lit(0)]
    entries = few(materialise(links.groupBy(*group).applyInPandas(chain, "blk long, entry double"), "entries"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                t = pa.Table.from_struct_array(b.column(1)[r].values)
                m, entry = np.asarray(t[mz].combine_chunks()), b.column(2)[r].as_py()
                starts = starts_of([t[k].combine_chunks() for k in keys], len(m))
                nxt = jumps(m, starts, np.asarray(tol.width_of(m), float)).tolist()
                opens = np.zeros(len(m), np.int64)
                for k, (a, end) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(m)], strict=True)):
                    at = _entry(m, end, entry, float(tol.width_of(entry))) if k == 0 and entry is not None else a
                    while at < end:
                        opens[at] = at
                        at = nxt[at]
                anchor = m[np.maximum.accumulate(opens)]
                if entry is not None:
                    anchor[: _entry(m, int(np.append(starts[1:], len(m))[0]), entry, float(tol.width_of(entry)))] = entry
                yield from t.append_column(out, pa.array(anchor)).to_batches()

    full = StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` double").fields])
    return packed.join(entries, "blk", "left").select("blk", "rows", "entry").select(F.col("blk"), "rows", "entry").mapInArrow(assign, full)


def relay(packed: DataFrame, key: list[str], fold: Callable, new: str, kind: DataType, forgets: bool = True) -> DataFrame:
    """The rows of a packed table with a column from a fold whose state passes from block to block.

    ``fold(table, state)`` gets a run of rows of one key and the state of the run before it (None at first), and returns (values
    of the column, state).  The states are small and travel pickled.  With ``forgets`` all blocks begin at once without a state, and a
    round runs those again whose entering state has changed; a block is final once those before it are, so rounds end, and
    states that soon forget their past need few.  Else a round runs the blocks whose predecessor is done: the n-th of each key together.
    """
    order = packed.select("blk", F.get("rows", 0).alias("a"), F.element_at("rows", -1).alias("z"))
    ends = lambda c: F.struct(*[F.col(f"{c}.{k}") for k in key], F.lit(0).alias("_"))
    w = Window.orderBy("blk")  # one short row for each block; those of a key are neighbours
    seq = order.select("blk", ends("a").alias("a"), F.lag("blk").over(w).alias("prev"), F.lag(ends("z")).over(w).alias("p"))
    seq = materialise(seq.select("blk", F.when(F.col("prev").isNotNull() & F.col("p").eqNullSafe(F.col("a")), F.col("prev")).alias("prev")), "sequence")
    fields = packed.schema["rows"].dataType.elementType.fields

    def runs(b: pa.RecordBatch) -> Iterator[tuple[pa.Table, list[int], object]]:
        for r in range(b.num_rows):
            t = pa.Table.from_struct_array(b.column(1)[r].values).combine_chunks()
            before = b.column(2)[r].as_py()
            yield t, starts_of([t[k].combine_chunks() for k in key], t.num_rows).tolist(), None if before is None else pickle.loads(before)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pickle.dumps(fold(t.slice(starts[-1]), before if len(starts) == 1 else None)[1]) for t, starts, before in runs(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["blk", "exit"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, starts, before in runs(b):
                for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
                    part = t.slice(a, z - a)
                    values = fold(part, before if a == 0 else None)[0]
                    yield from part.append_column(new, pa.array(values, to_arrow_type(kind))).to_batches()

    def left(t: DataFrame, entries: DataFrame) -> DataFrame:
        """The blocks of ``entries`` run from their entering states; of few entries only the files of their blocks are read."""
        due = [r.blk for r in entries.select("blk").limit(NAMED + 1).collect()]
        t = t.where(F.col("blk").isin(due)) if len(due) <= NAMED else t
        return entries.join(t.join(few(entries), "blk").select("blk", "rows", "entry").mapInArrow(exits, "blk long, exit binary"), "blk").select("blk", "prev", "entry", "exit")

    none = F.lit(None).cast("binary").alias("entry")
    begin = seq.select("blk", "prev", none) if forgets else seq.where("prev is null").select("blk", "prev", none)
    state = materialise(left(packed, materialise(begin, "due")), "states")
    while True:
        done = state.select(F.col("blk").alias("prev"), F.col("exit").alias("now"))
        held = seq.where("prev is not null").join(done, "prev").join(state.select("blk", "entry", F.lit(True).alias("ran")), "blk", "left")
        due = materialise(held.where(F.col("ran").isNull() | ~F.col("now").eqNullSafe(F.col("entry"))).select("blk", "prev", F.col("now").alias("entry")), "due")
        if due.isEmpty():
            drop(due)
            break
        nxt = materialise(state.join(due.select("blk"), "blk", "left_anti").unionByName(left(packed, due)), "states")
        drop(state, due)
        state = nxt
    return packed.join(few(state.select("blk", "entry")), "blk").select("blk", "rows", "entry").mapInArrow(final, StructType([*fields, StructField(new, kind)]))
