"""N-gram Jaccard join: components of the links of documents with like shingle sets.

The Jaccard distance d is a metric, but two unrelated documents are at distance 1
from each other and from any pivot, so pivots drawn from the corpus cannot split it:
every document would lie on every border.  So the space is first cut into cells of
documents that share a leading shingle.  All shingles have one order, rare ones first
as far as a sketch of fixed size tells; documents within the radius share one of the
first ``n - ceil(t n) + 1`` of their n shingles, hence a cell.

Cells of at most ``leaf`` members, and of one component, are done by pairs: sizes, places
of the shared shingle, profiles, and at last the sets decide.  A larger cell is a metric
space of its own in which distances differ, and is joined recursively: some members
become pivots, every member is measured against them and belongs to the Voronoi region of
the nearest, and a window around each region, ``d(y, p) <= d(y, nearest) + 2 radius``,
replicates the members across its border that may have a partner inside.  Where windows hold
so much that regions divide nothing, all members stay in the region of one pivot.  In its region
a member is its difference from the pivot, the shingles that it gains and then those that it
lacks: two members differ by what only one of their differences holds.  Members linked to the pivot are
one component.  Of any other pair within the radius the differences must have a part in common, more
than half of each, and so share a leading element: these are the next cells, apart for pairs
with a member linked to the pivot and for pairs without.  What near copies share with their pivot
makes no cell, however many they are.  Pairs there must also fulfil the triangle
inequality ``|d(x, p) - d(y, p)| <= radius``.  Near copies share a run of consecutive cells; a
pair is left to an earlier one if both members name it among the ``BEFORE`` cells before this
one.  Nothing is lost: every pair within the radius
shares a cell at each level until it is measured, known to be connected, or excluded by a
bound.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import drop, few, lean, materialise, release, ship
from .textvec import Words, list_array, shingle_sets, slices

#: Members that are measured against a pivot by one task.
BLOCK = 512
#: Counters of a block of the sketch.
SKETCH_BLOCK = 1 << 16
#: Levels of regions at most; what is left then is done by pairs.
LEVELS = 2
#: Cells before a cell, in the order of a set's leading shingles, that a member of it names.
BEFORE = 16


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, the least similarity num/den of a link, and how the work is cut.

    leaf: members of a cell that is done by pairs (its square bounds the pairs); pivots: of a larger cell; sketch: bits of
    the largest sketch (8 MB at 23).  The result is the same for any of them.
    """

    k: int = 4
    num: int = 85
    den: int = 100
    leaf: int = 64
    pivots: int = 4
    sketch: int = 23

    def lead(self, n):
        """Leading shingles of a set of n."""
        return n + self.num * -n // self.den + 1

    def reach(self, nx: int, n: int, a: int) -> tuple[int, int]:
        """How many elements lead in the difference, of ``a`` elements, of a set of ``nx`` from a pivot of ``n``: (for partners not linked to the pivot, for linked ones).

        Sets are linked if ``(num + den) (a + b - 2 common) <= (den - num) (nx + ny)``, so the common part of
        the differences is bounded from below: against a partner that is not linked to the pivot, so that
        its ``(num + den) b > (den - num) (ny + n)``; and against any, by ``b >= a - (den - num) (nx + ny) / (num + den)``
        and ``num ny <= den nx``.  Two members linked to the pivot need none.
        """
        s, c = self.num + self.den, self.den - self.num
        apart = a - (s * a + c * (n - nx)) // (2 * s)
        if s * a <= c * (nx + n):
            return 0, apart
        return apart, a + 1 - max(1, a - c * nx // self.num)

    @property
    def radius(self) -> float:
        return float(1 - Fraction(self.num, self.den)) + 1e-9


def node_of(s: np.ndarray) -> int:
    """64-bit name of a set: equal sets, equal names."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def profile(s: np.ndarray) -> np.ndarray:
    """Elements of a set per equal range of the hash space; one or two a range, ranges a power of two."""
    bits = max(3, int(len(s) // 2).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int, scheme: Scheme) -> bool:
    """False only if two sets of these sizes and profiles cannot be linked.

    Merging elements into ranges never raises a distance: the profiles differ by no
    more than the sets do.
    """
    if a.max(initial=0) == 255 or b.max(initial=0) == 255:
        return True  # a counter is full
    a, b = a.astype(np.int32), b.astype(np.int32)
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).sum(1)
    return int(np.abs(a - b).sum()) <= na + nb - 2 * -(-scheme.num * (na + nb) // (scheme.num + scheme.den))


def _sets(batch: pa.RecordBatch, column: int, scheme: Scheme) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, buf, off in slices(batch.column(column)):
        yield a, b, shingle_sets(Words(buf, off, lower=True), scheme.k)


def _named(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """_id, _h (hash of the text), _n (size of the set), _node (null for an empty set), _v (profile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, v = [], [], []
            for _, _, sets in _sets(batch, 2, scheme):
                n += [len(s) for s in sets]
                node += [node_of(s) if len(s) else None for s in sets]
                v += [profile(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(v, pa.binary())], ["_id", "_h", "_n", "_node", "_v"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_h", "_t").mapInArrow(lean(run), f"_id {kind}, _h bigint, _n bigint, _node bigint, _v binary")


def _sketch(docs: DataFrame, scheme: Scheme, shingles: int) -> np.ndarray:
    """Class of frequency of every counter of a sketch of all shingles: 0 up to what chance explains, then by doublings.

    The sketch has eight shingles a counter, or ``2**scheme.sketch`` counters if these are
    fewer.  Its counts only order shingles, so that they may be rough: a task counts to 255.
    """
    bits = min(max(10, int(shingles // 8).bit_length()), scheme.sketch)
    size = min(SKETCH_BLOCK, 1 << bits)
    mean = shingles / (1 << bits)
    chance = max(mean + 4 * mean**0.5, 4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = np.zeros(1 << bits, np.uint8), set()
        for batch in batches:
            for _, _, sets in _sets(batch, 0, scheme):
                flat = np.concatenate([_fresh(s, seen) for s in sets])
                u, n = np.unique((flat >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                c[u] = np.minimum(c[u] + n, 255)
        at = [i for i in range(0, len(c), size) if c[i : i + size].any()]
        for i in at:
            yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), pa.array([zlib.compress(c[i : i + size].tobytes(), 1)], pa.binary())], ["block", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            cls = np.where(c > chance, 1 + np.floor(np.log2(np.maximum(c, 1) / chance)), 0).clip(0, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(cls.tobytes(), 1)], pa.binary())], ["block", "c"])

        at, c = None, None
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at, c = block, np.zeros(size, np.int64)
                c += np.frombuffer(zlib.decompress(raw.as_buffer()), np.uint8)
        if at is not None:
            yield done()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select("_t").mapInArrow(lean(count), "block int, c binary").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lean(add), "block int, c binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in blocks.collect():  # 2**scheme.sketch small numbers at most
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(zlib.decompress(row.c), np.uint8)
    return out


def _fresh(s: np.ndarray, seen: set[int]) -> np.ndarray:
    """The set, or an empty one if the task has met it before."""
    if not len(s) or (x := node_of(s)) in seen:
        return s[:0]
    seen.add(x)
    return s


def leading(sets: list[np.ndarray], classes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, shingle) of the leading shingles of non-empty sets, in the order (class of frequency, value)."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    bits = len(classes).bit_length() - 1
    # Sets come sorted, so that an order of (set, class) that keeps ties is all it takes.
    order = np.argsort(doc * 256 + classes[(flat >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    keep = at < np.repeat(scheme.lead(size), size)
    return doc[keep], at[keep], flat[order[keep]]


def _cells(docs: DataFrame, scheme: Scheme, classes) -> DataFrame:
    """(cell, node, n, at): the leading shingles of every set, with their places, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in _sets(batch, 0, scheme):
                sets = [s for s in (_fresh(s, seen) for s in sets) if len(s)]
                if sets:
                    doc, at, s = leading(sets, classes.value, scheme)
                    node, n = np.array([node_of(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(node[doc]), pa.array(n[doc]), pa.array(at.astype(np.int32))], ["cell", "node", "n", "at"])

    return docs.select("_t").mapInArrow(lean(run), "cell bigint, node bigint, n int, at int")


def difference(s: np.ndarray, pivot: np.ndarray, classes: np.ndarray, scheme: Scheme) -> tuple[int, np.ndarray, int, int]:
    """(elements in common, leading elements of the difference, how many lead for partners not linked to the pivot, and for linked ones).

    What the set gains comes before what it lacks, each in the order (class of frequency, value).  In the order that puts
    the pivot's elements last a partner shares a leading element of the set itself: if only gains lead, it is
    also the first element that the differences share, and no more need to lead.
    """
    has = np.isin(s, pivot, assume_unique=True)
    inter = int(has.sum())
    bits = len(classes).bit_length() - 1
    parts = []
    for e in (s[~has], pivot[~np.isin(pivot, s, assume_unique=True)]):
        parts.append(e[np.argsort(classes[(e >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")])
    reach = scheme.reach(len(s), len(pivot), len(s) + len(pivot) - 2 * inter)
    lead = scheme.lead(len(s))
    if len(s) - inter >= lead:
        reach = tuple(min(r, lead) for r in reach)
    return inter, np.concatenate(parts)[: max(reach)], *reach


def _measure(pairs: DataFrame, rows: DataFrame, reps: DataFrame, scheme: Scheme, classes=None) -> DataFrame:
    """(x, p, inter, union, first, apart, linked) of pairs of nodes, as a written table.

    ``first``: with the broadcast ``classes`` the leading elements (half of their bits) of the difference of x from p, of
    which ``apart`` and ``linked`` lead for the two kinds of partners; else none.

    A set travels once for each of its pivots, and a pivot once for each block of
    ``BLOCK`` members, so a pivot of any number of members is shared by many tasks.
    """
    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("p").alias("node"))).distinct()
    wanted = materialise(reps.join(wanted, "node").select("node", F.col("pick._id").alias("_pid"), F.col("pick._h").alias("_h")), "wanted")
    texts = rows.join(few(wanted), (rows["_h"] == wanted["_h"]) & rows["_id"].eqNullSafe(wanted["_pid"])).select("node", "_t")
    texts = texts.dropDuplicates(["node", "_t"])
    per = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("s"))
    to = pairs.join(per, "p").select(F.col("x").alias("node"), "p", F.pmod(F.xxhash64("x", "p"), F.col("s")).cast("int").alias("salt"), F.lit(1).alias("role"))
    own = per.select(F.col("p").alias("node"), "p", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.lit(0).alias("role"))
    sent = texts.join(to.unionByName(own), "node").select("node", "p", "salt", "role", "_t")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, "p", "salt").sortWithinPartitions("p", "salt", "role")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, None
        for batch in batches:
            out: list[tuple] = []
            x, p, salt, role = (batch.column(i).to_pylist() for i in range(4))
            for a, _, sets in _sets(batch, 4, scheme):
                for i, s in enumerate(sets, a):
                    if node_of(s) != x[i]:
                        continue  # another text with the same id and hash
                    if role[i] == 0:
                        at, pivot = (p[i], salt[i]), s
                    elif at == (p[i], salt[i]):
                        if classes is None:
                            inter, lead, apart, linked = int(np.isin(s, pivot, assume_unique=True).sum()), np.zeros(0, np.uint64), 0, 0
                        else:
                            inter, lead, apart, linked = difference(s, pivot, classes.value, scheme)
                        out.append((x[i], p[i], inter, len(s) + len(pivot) - inter, apart, linked, (lead >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], [], [], []]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], list_array(list(cols[6]), pa.int32())], ["x", "p", "inter", "union", "apart", "linked", "first"])

    done = materialise(dealt.mapInArrow(lean(meet), "x bigint, p bigint, inter bigint, union bigint, apart bigint, linked bigint, first array<int>"), "measured")
    drop(wanted)
    release(pairs.sparkSession)
    return done


def _bounded(pairs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (x, p) whose profiles, a byte for one or two shingles, leave a link open."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            a, b = batch.column(4), batch.column(5)
            ok = [may_link(np.frombuffer(a[i].as_buffer(), np.uint8), np.frombuffer(b[i].as_buffer(), np.uint8), n[i], m[i], scheme) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    x, p = (reps.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("v").alias(f"v{k}")) for k in ("x", "p"))
    return pairs.join(x, "x").join(p, "p").select("x", "p", "nx", "np", "vx", "vp").mapInArrow(lean(keep), "x bigint, p bigint")


def _fits(nx: Column, ny: Column, ax: Column, ay: Column, scheme: Scheme, a: Column | None = None, b: Column | None = None) -> Column:
    """Whether sizes and the places of a shared element leave a link open.

    The places are those in the sets, or in their differences of ``a`` and ``b`` elements from one pivot.
    If it is the first that two share, they share no more than what follows in either.
    """
    nx, ny = nx.cast("bigint"), ny.cast("bigint")
    a, b = (nx if a is None else a), (ny if b is None else b)
    sizes = F.least(nx, ny) * scheme.den >= F.greatest(nx, ny) * scheme.num
    s = scheme.num + scheme.den
    return sizes & (F.least(a - ax, b - ay) * (2 * s) >= (a + b) * s - (nx + ny) * (scheme.den - scheme.num))


def _near(scheme: Scheme) -> Column:
    return F.col("inter") * scheme.den >= F.col("union") * scheme.num


def link(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach).

    Jobs run when this is called.  Pairs within one component are not all measured, so
    links are not counted.  Null and empty texts have an empty set and are components of
    their own.  Rows with equal sets are one class, whatever their number, and count as
    linked; rows that repeat an id share it, and rows with a null id keep a null component
    only when no other member has an id.
    """
    out = _linked(docs, scheme, id_col, text_col)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id")


def _linked(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str) -> DataFrame:
    """Per row: _id, _h (hash of the text), _n, comp (name of the component, null for an empty set), component_id."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).withColumn("_h", F.xxhash64("_t"))
    named = materialise(_named(rows, scheme), "named")
    some = named.where(F.col("_node").isNotNull())
    reps = materialise(some.groupBy(F.col("_node").alias("node")).agg(F.min("_id").alias("first"), F.max("_n").alias("n"), F.min(F.struct("_id", "_h")).alias("pick"), F.first("_v").alias("v")), "reps")
    shingles = reps.agg(F.sum("n")).first()[0] or 0
    classes = spark.sparkContext.broadcast(_sketch(rows, scheme, shingles))
    # A cell of a single set is none.  Its least member is the first that all others are held against.
    w = Window.partitionBy("cell")
    cells = _cells(rows, scheme, classes).withColumn("p", F.min(F.struct("node", "n", "at")).over(w)).withColumn("_q", F.max("node").over(w))
    cells = materialise(cells.where(F.col("p.node") != F.col("_q")).distinct(), "cells")
    release(spark)
    star = cells.where((F.col("node") != F.col("p.node")) & _fits(F.col("n"), F.col("p.n"), F.col("at"), F.col("p.at"), scheme))
    star = materialise(star.select(F.col("node").alias("x"), F.col("p.node").alias("p")).distinct(), "star")
    measured = _measure(materialise(_bounded(star, reps, scheme), "todo"), rows, reps, scheme)
    comp = materialise(components(measured.where(_near(scheme)), "x", "p"), "comp")
    drop(star)
    level = materialise(cells.select("cell", "node", "n", "at", F.lit(0).cast("bigint").alias("region"), F.lit(0.0).alias("d"), F.lit(True).alias("home"), F.col("n").cast("bigint").alias("a"), F.lit(True).alias("apart"), F.lit(False).alias("between")), "level")
    drop(cells)
    for depth in range(LEVELS + 1):
        open_ = materialise(_open(level, comp), "open")
        drop(level)
        leaf = open_ if depth == LEVELS else open_.where(F.col("m") <= scheme.leaf**2)
        comp = _more(_bounded(_pairs(leaf, scheme), reps, scheme), comp, rows, reps, scheme)
        large = open_.where(F.col("m") > scheme.leaf**2).drop("m", "comp", "before")
        if depth == LEVELS or large.isEmpty():
            drop(open_)
            break
        level, comp = _regions(materialise(_open(large, comp).drop("m", "comp", "before"), "large"), comp, rows, reps, scheme, classes)
        drop(open_)
    cls = reps.join(comp, "node", "left").select(F.col("node").alias("_node"), "first", F.coalesce("comp", "node").alias("comp"))
    least = cls.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = materialise(cls.join(least, "comp").select("_node", "comp", "component_id"), "classes")
    drop(reps, comp)
    out = named.join(of, "_node", "left").select("_id", "_h", "_n", "comp", F.coalesce("component_id", "_id").alias("component_id"))
    out = materialise(out, "linked")
    drop(named, of)
    return out


def _more(todo: DataFrame, comp: DataFrame, rows: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """Measure further pairs and connect what they link."""
    todo = materialise(todo, "todo")
    if todo.isEmpty():
        drop(todo)
        return comp
    new = _measure(todo, rows, reps, scheme)
    drop(todo)
    return _connect(new, comp, scheme)


def _connect(measured: DataFrame, comp: DataFrame, scheme: Scheme) -> DataFrame:
    links = measured.where(_near(scheme))
    if links.isEmpty():
        return comp
    edges = links.select(F.col("x").alias("a"), F.col("p").alias("b")).unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    return materialise(components(edges), "comp")


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the cells that hold more than one component and a pair to look at: one of it at home, and of both kinds where a pair needs both.

    With their component, the number ``m`` of pairs that the kinds and homes of the cell's members leave, and the cells ``before`` it that are open as well.
    """
    order = Window.partitionBy("node", "region", "between").orderBy("at").rowsBetween(-BEFORE, -1)
    j = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    all_, home, apart = F.count(F.lit(1)), F.count_if("home"), F.count_if("apart")
    both = F.count_if(F.col("home") & F.col("apart"))
    m = F.when(F.max("between"), both * (all_ - apart) + apart * (home - both)).otherwise(home * all_)
    per = j.groupBy("cell").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), m.alias("m"))
    return j.join(per.where((F.col("_a") != F.col("_b")) & (F.col("m") > 0)).select("cell", "m"), "cell").withColumn("before", F.collect_list("cell").over(order))


def _pairs(cells: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs of a cell's members from different components that no bound excludes; one of the two is at home in the region.

    Of the cells that a pair shares the first always lists it: bounds by places hold there, and no cell before it is shared.
    """
    x = cells.select("cell", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("d").alias("dx"), F.col("home").alias("hx"), F.col("comp").alias("cx"), F.col("before").alias("bx"), F.col("a").alias("lx"), F.col("apart").alias("ux"), "between")
    y = cells.select("cell", F.col("node").alias("p"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("d").alias("dy"), F.col("home").alias("hy"), F.col("comp").alias("cy"), F.col("before").alias("by"), F.col("a").alias("ly"), F.col("apart").alias("uy"))
    triangle = (F.abs(F.col("dx") - F.col("dy")) <= scheme.radius) & (F.col("hx") | F.col("hy"))
    kinds = ~F.col("between") | (F.col("ux") != F.col("uy"))
    places = _fits(F.col("nx"), F.col("ny"), F.col("ax"), F.col("ay"), scheme, F.col("lx"), F.col("ly"))
    ok = (F.col("x") < F.col("p")) & (F.col("cx") != F.col("cy")) & kinds & places & triangle & ~F.arrays_overlap("bx", "by")
    return x.join(y, "cell").where(ok).select("x", "p").distinct()


def _regions(cells: DataFrame, comp: DataFrame, rows: DataFrame, reps: DataFrame, scheme: Scheme, classes) -> tuple[DataFrame, DataFrame]:
    """The cells of the next level, inside the Voronoi regions of the pivots of ``cells``, and the components so far.

    The members of a cell are dealt into as many hands as there are pivots; each hand's member
    of most cells is a pivot, so that few pivots serve many cells.  Cells with the same pivots are
    one space, in which a member occurs once.  Of two regions that a pair is at home in, the one whose pivot has
    more cells gets the member of the other.  A space whose members lie in more than one and a half
    regions on average is one region, that of the pivot with the least differences.  A member is listed only
    for the kinds of partners that its region has in other components.
    """
    rank = cells.groupBy("node").agg(F.count(F.lit(1)).alias("_c"))
    hand = F.pmod(F.xxhash64("node"), F.lit(scheme.pivots))
    dealt = cells.join(rank, "node")
    best = [F.max(F.when(hand == i, F.struct("_c", "node"))) for i in range(scheme.pivots)]
    ranked = F.transform(F.array_compact(F.array(*best)), lambda e: F.struct((-e["_c"]).alias("r"), e["node"].alias("p")))
    pivots = dealt.groupBy("cell").agg(F.array_sort(ranked).alias("ps"))
    pivots = materialise(pivots, "pivots")
    # All pairs of a pivot in its cell are measured: it is no member any more.
    rest = cells.select("cell", F.col("node").alias("x"), "n").join(pivots, "cell").where(~F.array_contains("ps.p", F.col("x")))
    of = rest.select("ps", "x", "n").distinct().withColumn("q", F.explode("ps")).select("ps", "x", "n", F.col("q.r").alias("r"), F.col("q.p").alias("p"))
    of = materialise(of, "of")
    among = pivots.select("ps.p").distinct().withColumn("x", F.explode("p")).select("x", F.explode("p").alias("p")).where("x < p")
    measured = _measure(materialise(of.select("x", "p").unionByName(among).distinct(), "todo"), rows, reps, scheme, classes)
    comp = _connect(measured, comp, scheme)
    d = measured.select("x", "p", (1 - F.col("inter") / F.col("union")).alias("d"), (F.col("union") - F.col("inter")).alias("a"))
    # Of the few pivots of its space a member keeps the nearest, and those before it whose windows it lies in.
    held = of.join(d, ["x", "p"]).groupBy("ps", "x").agg(F.max("n").alias("n"), F.collect_list(F.struct("d", "r", "p", "a")).alias("all")).withColumn("near", F.array_min("all"))
    each = held.select("ps", "x", "n", "near", F.explode("all").alias("e")).withColumn("home", F.col("e.p") == F.col("near.p"))
    inside = F.col("home") | ((F.col("e.d") <= F.col("near.d") + 2 * scheme.radius) & (F.struct("e.r", "e.p") < F.struct("near.r", "near.p")))
    each = materialise(each.select("ps", "x", "n", "home", inside.alias("inside"), "e.p", "e.d", "e.a"), "each")
    spread = each.groupBy("ps", "p").agg(F.sum("a").alias("_a"), F.count_if("inside").alias("_k"), F.count(F.lit(1)).alias("_n"))
    spread = spread.groupBy("ps").agg(F.min(F.struct("_a", "p"))["p"].alias("only"), F.sum("_k").alias("_k"), F.max("_n").alias("_n"))
    whole = materialise(spread.where(2 * F.col("_k") > 3 * F.col("_n")).select("ps", "only"), "whole")
    only = F.col("p") == F.col("only")
    both = each.join(few(whole), "ps", "left").where(F.coalesce(only, "inside")).select("x", "n", "p", "d", F.coalesce(only, "home").alias("home"))
    region = both.groupBy("x", "p").agg(F.max("n").alias("n"), F.max("d").alias("d"), F.max("home").alias("home"))
    how = measured.select("x", "p", "first", F.col("apart").alias("_a"), F.col("linked").alias("_l"), (F.col("union") - F.col("inter")).alias("a"), (~_near(scheme)).alias("apart"))
    held = region.join(how, ["x", "p"]).join(comp.select(F.col("node").alias("x"), "comp"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    held = materialise(held, "held")
    # The component of the pivot, if a member is linked to it, and the least and greatest of those that are not.
    apart = F.when(F.col("apart"), F.col("comp"))
    others = materialise(held.groupBy("p").agg(F.max(F.when(~F.col("apart"), F.col("comp"))).alias("_c"), F.min(apart).alias("_lo"), F.max(apart).alias("_hi")), "others")
    other = F.when(F.col("apart"), F.col("comp") != F.col("_c")).otherwise((F.col("_lo") != F.col("_c")) | (F.col("_hi") != F.col("_c")))
    led = held.join(few(others), "p").withColumn("_a", F.when(F.col("_lo") != F.col("_hi"), F.col("_a")).otherwise(0)).withColumn("_l", F.when(other, F.col("_l")).otherwise(0))
    led = led.select("x", "p", "n", "d", "home", "a", "apart", "_a", "_l", F.posexplode(F.slice("first", F.lit(1), F.greatest("_a", "_l").cast("int"))).alias("at", "s"))
    kinds = F.array_compact(F.array(F.when(F.col("at") < F.col("_a"), F.lit(False)), F.when(F.col("at") < F.col("_l"), F.lit(True))))
    level = led.withColumn("between", F.explode(kinds))
    level = level.select(F.xxhash64("p", "s", "between").alias("cell"), F.col("x").alias("node"), "n", F.col("at").cast("int").alias("at"), F.col("p").alias("region"), "d", "home", "a", "apart", "between")
    level = materialise(level, "level")
    drop(of, measured, pivots, cells, each, whole, held, others)
    release(cells.sparkSession)
    return level, comp


def keep_one(docs: DataFrame, scheme: Scheme = Scheme(5, 80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, that with the smallest id, with all its columns.

    Members without an id come last.  Of rows with equal id and text one stays; null and
    empty texts are in no component and stay.
    """
    f = _linked(docs, scheme, id_col, text_col)
    first = f.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_h")).alias("b"))
    chosen = first.select(F.col("b._id").alias("_kid"), F.col("b._h").alias("_kh")).unionByName(f.where("comp is null").select(F.col("_id").alias("_kid"), F.col("_h").alias("_kh")).distinct())
    rows = f.where("comp is not null").groupBy(F.col("_id").alias("_rid"), F.col("_h").alias("_rh")).agg(F.count(F.lit(1)).alias("_rows"))
    same = F.col("_kid").eqNullSafe(F.col("_rid")) & (F.col("_kh") == F.col("_rh"))
    found = materialise(chosen.join(rows, same, "left").select("_kid", "_kh", F.coalesce("_rows", F.lit(1)).alias("_rows")), "kept")
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    here = F.col(id_col).eqNullSafe(F.col("_kid")) & (text_hash == F.col("_kh"))
    once = docs.join(few(found.where("_rows = 1").select("_kid", "_kh")), here, "left_semi")
    again = found.where("_rows > 1").select("_kid", "_kh")
    if again.isEmpty():
        return once
    w = Window.partitionBy(id_col, text_hash).orderBy(F.lit(0))
    repeated = docs.join(again, here, "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return once.unionByName(repeated)
