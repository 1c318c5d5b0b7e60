"""N-gram Jaccard self-join with a count-vector R-tree.

Method. A document is the set of its distinct word shingles, each a 64-bit
hash. Hashes fall into groups, and the number of hashes in each group is the
document's point. Two sets share at most the sum of the smaller counts over the
groups, so a pair of points, or of boxes around points, is dropped when that
sum is below what the threshold asks for. Surviving pairs are verified on the
shingle sets themselves.

Scale. Rows with equal sets are one node. The upper level of the index is
a partition: the coordinates are cut into more blocks than the shingles in
which two linked documents can differ, so that at least one block of counts
must be equal, and that block is the cell where they meet (for blocks this fine
grouping, each hash is a group of its own). A document with so few filled
blocks that only empty ones might agree with a partner's also meets others of its
kind by these; a partner of the next size class has empty blocks of its own, where
only documents of different classes are compared.

Cells that hold one document only are left out first: a task sends each key once,
packed into seven bytes with the document's number, to the bucket of its first
bits, and the entries of keys that it met twice itself go past the count, dealt
out by document. Within a cell an R-tree is packed over the points and searched.

A first search looks into ``FEW`` cells of each document, a cell of more than
``CELL`` documents in parts, and finds a spanning forest of the surviving pairs,
of which each document tries one. A second search emits all surviving pairs whose
ends are still in different components, from all cells that hold such; there
a large cell is cut by component, and two parts of one component don't meet. So no link
between different components is lost and copies aren't expanded. Two documents
may share hundreds of cells: each brings along the ``FIRST`` smallest keys of its
cells, and a pair that has one of these in common is emitted in the cell of the
smallest such only.

Defined cases. Null and empty texts have no shingles and link with nothing; a
text with fewer words than a shingle is one shingle. Every row is a document of its
own, also if its id is null or occurs again: such rows share a component only by
links. A component is named by its smallest id, and is null if none of its rows has
an id. Input columns besides id and text aren't read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_arrow, materialize, release, small, tables, text_of
from .graph import connected_components

#: Coordinates of a point.
GROUPS = 256
#: Points in a leaf of the R-tree, and nodes below an inner node.
LEAF = 64
#: Documents of a cell that one task searches at once.
CELL = 2048
#: Cells of a document in the first search.
FEW = 8
#: Cells of a document, by key, that it names in every other of its cells.
FIRST = 16
#: Documents whose sets one task compares with a document, or with as many others.
BLOCK = 64
#: Bits of a cell's key, bytes of it within a bucket of the count, and entries that a task packs at once.
KEY_BITS, LOW, PACKED = 48, 5, 3_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (wraps on purpose)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes(dict):
    """64-bit hashes of words, kept for the next occurrence."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, width: int, hashes: Hashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; A-Z count as a-z, words end at ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def blocks(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, number of blocks) for a set of ``n``: of the size classes from its smallest partner's to its own."""
    tops = [1 << k for k in range((-(-percent * n // 100)).bit_length(), n.bit_length() + 1)]
    return [(top, (top - 1) * (100 - percent) // percent + 2) for top in tops]


def apart(n: int, other: int, percent: int) -> int:
    """The most shingles in which linked sets of these sizes differ."""
    return (n + other) * (100 - percent) // (100 + percent)


def cell_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The keys of the cells in which the set's partners can be found; odd ones are for partners of another size class only.

    If two sets agree in empty blocks only, they differ in every block that one
    of them fills, so neither fills more than the shingles in which they can differ.
    """
    n, out = len(s), []
    if not n * (100 - percent) // percent:
        return np.empty(0, np.int64)
    most = n * 100 // percent
    value = _mix(s + _U(0x632BE59BD9B4E019))
    for top, m in blocks(n, percent):
        salt = _U(top * 0x9E3779B97F4A7C15 % (1 << 64))
        at = (s % _U(m)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        filled, starts = np.unique(at[order], return_index=True)
        content = np.add.reduceat(value[order], starts)
        where = _mix(filled.astype(np.uint64) + salt)
        out.append(_mix(where ^ content) >> _U(64 - KEY_BITS) & ~_U(1))
        # Partners are looked for in the class of the smaller set, which has up to top - 1 shingles.
        within = n < top and len(filled) <= apart(n, min(top - 1, most), percent)
        across = max(n, most) >= top and len(filled) <= apart(n, most if n < top else top - 1, percent)
        if within or across:
            empty = np.setdiff1d(np.arange(m), filled).astype(np.uint64)
            empty = _mix(_mix(empty + salt) ^ _U(0x5851F42D4C957F2D)) >> _U(64 - KEY_BITS)
            out += [empty & ~_U(1)] * within + [empty | _U(1)] * across
    return np.concatenate(out).astype(np.int64)


def point_of(s: np.ndarray) -> bytes:
    counts = np.bincount((s >> _U(56)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def points_of(packed: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == GROUPS else np.uint32).astype(np.int32) for p in packed])


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each number, (values, width)."""
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)[:, :width]


def _widen(raw: np.ndarray) -> np.ndarray:
    """Numbers from their lowest bytes."""
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<i8").ravel()


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t and h, two hashes of the text; id and h tell rows apart, but for exact repetitions."""
    src = df.select(F.col(id_col).cast("long").alias("id"), text_of(df, text_col).alias("t"))
    return src.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64("t", F.lit(1))})


def sketch(df: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """r (the row's number), id, h1, h2, n (size of the set), f1 and f2 (its fingerprint), keys (its cells, packed) and point of every row."""

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            n, f1, f2, keys, points = [], [], [], [], []
            for text in batch.column(4).to_pylist():
                s = shingles(text, width, hashes)
                n.append(len(s))
                f1.append(int(s.sum().astype(np.int64)))
                f2.append(int(_mix(s ^ _U(0xD6E8FEB86659FD93)).sum().astype(np.int64)))
                keys.append(_narrow(cell_keys(s, percent), KEY_BITS // 8).tobytes())
                points.append(point_of(s))
            out = [*(batch.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.binary()), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["r", "id", "h1", "h2", "n", "f1", "f2", "keys", "point"])

    src = _source(df, id_col, text_col).select(F.monotonically_increasing_id().alias("r"), "id", "h1", "h2", "t")
    return map_arrow(src, run, "r long, id long, h1 long, h2 long, n long, f1 long, f2 long, keys binary, point binary")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, r) of all cells that hold more than one of the nodes, which have r and keys (packed).

    An entry is packed as the key's low bytes and 16 bits: the low 15 of the
    row's number (the row it is packed in has the rest) and a mark on the one that
    a task sends for all its entries of a key, which it doesn't count itself.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = min(8 * LOW, KEY_BITS - (4 * parts).bit_length())

    def packed(key, row, mark, salted):
        bucket, base = key >> low, row >> 15
        order = np.lexsort((base, bucket))
        key, row, mark, bucket, base = key[order], row[order], mark[order], bucket[order], base[order]
        cut = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(base) != 0)]) if len(key) else np.empty(0, np.int64)
        raw = np.concatenate([_narrow(key & ((1 << low) - 1), LOW), _narrow((row & 0x7FFF) * 2 + mark, 2)], axis=1)
        ends = np.r_[cut, len(key)].astype(np.int32) * (LOW + 2)
        values = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
        salt = base[cut] % 1021 + 1 if salted else np.zeros(len(cut), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(salt), pa.array(base[cut]), values], ["bucket", "salt", "base", "entries"])

    def deal(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            key, row = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            first = np.r_[True, np.diff(key) != 0]
            met = ~(first & np.r_[first[1:], True])
            yield packed(key[first], row[first], met[first], False)
            if met.any():
                yield packed(key[met], row[met], np.zeros(int(met.sum()), np.int64), True)

        for batch in batches:
            raw = batch.column(1)
            counts = np.diff(np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)) // (KEY_BITS // 8)
            keys = _widen(np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, KEY_BITS // 8))
            held.append((keys, np.repeat(batch.column(0).to_numpy(), counts)))
            size += len(keys)
            if size > PACKED:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def entries(bucket, base, packed):
        raw = np.frombuffer(packed, np.uint8).reshape(-1, LOW + 2)
        tail = _widen(raw[:, LOW:])
        return _widen(raw[:, :LOW]) | bucket << low, base << 15 | tail >> 1, tail & 1

    def rows(key, row):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(row, pa.int64())], ["key", "r"])

    def count(batches):
        now, held = None, []

        def counted():
            key, row, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            _, of, times = np.unique(key, return_inverse=True, return_counts=True)
            met = (times[of] > 1) & (mark == 0)
            return rows(key[met], row[met])

        for batch in batches:
            for bucket, salt, base, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if salt:  # known to be met
                    yield rows(*entries(bucket, base, raw)[:2])
                    continue
                if bucket != now and held:
                    yield counted()
                    held = []
                now = bucket
                held.append(entries(bucket, base, raw))
        if held:
            yield counted()

    dealt = map_arrow(nodes.select("r", "keys"), deal, "bucket long, salt long, base long, entries binary")
    return map_arrow(dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt"), count, "key long, r long")


class RTree:
    """A packed R-tree: boxes are kept by their upper corner and the smallest set within."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        spread = points.astype(np.float32).var(axis=0)
        axis = int(np.argmax(spread)) if len(points) else 0
        slab = np.argsort(sizes, kind="stable")
        per = LEAF * max(1, int(np.ceil(np.sqrt(len(points) / LEAF))))
        self.order = np.concatenate([part[np.argsort(points[part, axis], kind="stable")] for part in np.split(slab, range(per, len(slab), per))])
        self.points, self.sizes = points[self.order], sizes[self.order]
        top = int(self.points.max(initial=0))
        # Sum of minima = number of levels that both reach: a product of two 0-1 matrices if the counts are small.
        used = np.flatnonzero(self.points.any(axis=0))
        self.steps = np.concatenate([self.points[:, used] >= k for k in range(1, top + 1)], axis=1).astype(np.float32) if 0 < top <= 16 else None
        self.levels = [(self._upper(self.points), self._least(self.sizes))]
        while len(self.levels[-1][1]) > LEAF:
            up, low = self.levels[-1]
            self.levels.append((self._upper(up), self._least(low)))

    @staticmethod
    def _upper(x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x, range(0, len(x), LEAF), axis=0)

    @staticmethod
    def _least(x: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(x, range(0, len(x), LEAF))

    def _may(self, shared: np.ndarray, a, b) -> np.ndarray:
        return shared * (100 + self.percent) >= self.percent * (a + b)

    def leaves_for(self, leaf: int) -> np.ndarray:
        """Leaves from ``leaf`` on that can hold a partner of one of its points, found from the root down."""
        upper, least = self.levels[0][0][leaf], self.levels[0][1][leaf]
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            up, low = self.levels[depth]
            nodes = nodes[self._may(np.minimum(up[nodes], upper).sum(axis=1), low[nodes], least)]
            if depth:
                below = len(self.levels[depth - 1][1])
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < below]
        return nodes[nodes >= leaf]

    def adjacency(self) -> np.ndarray:
        """Which points (in the order given) may be linked, by the bound on their overlap."""
        n = len(self.points)
        out = np.zeros((n, n), bool)
        for leaf in range(len(self.levels[0][1])):
            rows = np.arange(leaf * LEAF, min(n, (leaf + 1) * LEAF))
            found = self.leaves_for(leaf)
            if not len(found):
                continue
            cols = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
            cols = cols[cols < n]
            if self.steps is not None:
                shared = self.steps[rows] @ self.steps[cols].T
            else:
                shared = np.stack([np.minimum(self.points[cols], p).sum(axis=1) for p in self.points[rows]])
            out[np.ix_(rows, cols)] = self._may(shared, self.sizes[rows][:, None], self.sizes[cols][None, :])
        out |= out.T
        np.fill_diagonal(out, False)
        back = np.empty_like(out)
        back[np.ix_(self.order, self.order)] = out
        return back


def forest(may: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph, by breadth-first search."""
    fresh = np.ones(len(may), bool)
    for root in range(len(may)):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            u = queue.pop(0)
            for v in np.flatnonzero(may[u] & fresh).tolist():
                fresh[v] = False
                queue.append(v)
                yield u, v


def fresh_pairs(may: np.ndarray, key: int, low: list[list[int]]) -> Iterator[tuple[int, int]]:
    """The pairs of a cell without those that an earlier cell emits.

    low: of each document the smallest even keys of its cells. One that two documents both
    name is that of a cell which they share, and the smallest such cell emits them.
    """
    named = {i: {k for k in low[i] if key & 1 or k < key} for i in np.flatnonzero(may.any(axis=0) | may.any(axis=1)).tolist()}
    for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
        if named[i].isdisjoint(named[j]):
            yield i, j


def _cells(batches) -> Iterator[dict[str, list]]:
    """The rows of each cell, from rows sorted by cell."""
    held: dict[str, list] = {}
    for batch in batches:
        cols = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        key, part = cols["key"].to_numpy(zero_copy_only=False), cols["part"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
            rows = {k: c.slice(a, b - a).to_pylist() for k, c in cols.items()}
            if held and (held["key"][0], held["part"][0]) == (rows["key"][0], rows["part"][0]):
                for k in held:
                    held[k] += rows[k]
                continue
            if held:
                yield held
            held = rows
    if held:
        yield held


def search(cells: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) that may be linked: a spanning forest of each cell, or ``every`` one between components.

    For the latter, cells also have low, the ``FIRST`` smallest even keys of a document's cells.
    """

    def run(batches):
        a, b = [], []
        for cell in _cells(batches):
            label = np.array(cell["label"])
            order = np.argsort(cell["r"], kind="stable").tolist()
            cell, label = {k: [v[i] for i in order] for k, v in cell.items()}, label[order]
            if len(label) < 2 or (label == label[0]).all():
                continue
            sizes = np.array(cell["n"])
            may = RTree(points_of(cell["point"]), sizes, percent).adjacency()
            if cell["key"][0] & 1:
                of = np.frexp(sizes)[1]  # the size class
                may &= of[:, None] != of[None, :]
            rows = cell["r"]
            pairs = fresh_pairs(np.triu(may & (label[:, None] != label[None, :])), cell["key"][0], cell["low"]) if every else forest(may)
            for i, j in pairs:
                a.append(min(rows[i], rows[j]))
                b.append(max(rows[i], rows[j]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = cells.select("key", "part", "r", "n", "label", "point", *["low"] * every).repartition("key", "part").sortWithinPartitions("key", "part")
    return map_arrow(dealt, run, "a long, b long").filter("a < b").distinct()


def parted(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """key, r and part of the entries (key, r, label) of hot cells, so that any two of different labels share a part.

    A label of many entries is cut into parts of its own, the others of its cell
    share parts; a task gets two parts of half a cell's size, but never two of the same label.
    """
    half = CELL // 2
    of = entries.join(small(hot.select("key")), "key")
    sizes = of.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    large = sizes.filter(f"c > {half}").select("key", "label", F.col("label").alias("own"))
    of = of.join(small(materialize(large, "large")), ["key", "label"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    subs = materialize(of.groupBy("key", "own").agg(F.ceil(F.count(F.lit(1)) / half).alias("subs")), "subs")
    of = of.join(small(subs), ["key", "own"]).withColumn("sub", F.pmod(F.xxhash64("r"), F.col("subs")))
    one = subs.select("key", F.expr("explode(transform(sequence(0L, subs - 1), k -> struct(own, k as sub)))").alias("x"))
    two = one.withColumnRenamed("x", "y")
    met = one.join(two, "key").filter("x <= y and (x.own <> y.own or x.own = -1)").withColumn("part", F.xxhash64("x.own", "x.sub", "y.own", "y.sub"))
    met = materialize(met.select("key", "part", F.explode(F.array_distinct(F.array("x", "y"))).alias("x")).select("key", "part", "x.own", "x.sub"), "parts")
    return of.join(small(met), ["key", "own", "sub"]).select("key", "r", "part")


def verify(pairs: DataFrame, known: DataFrame, docs: DataFrame, width: int, percent: int, meshed: bool = False) -> DataFrame:
    """The pairs of rows whose shingle sets reach the threshold; known has r with id and hashes, docs these with t.

    Pairs are dealt to tasks so that a set is sent to few of them. As a rule,
    pairs meet at their smaller row, ``BLOCK`` partners at a time. ``meshed`` pairs,
    many among the same documents, meet by component: its documents are cut
    into blocks of about ``BLOCK``, and a task gets the sets of two blocks.
    """
    if meshed:
        labels = small(materialize(connected_components(pairs), "mesh"))
        sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        of = pairs.join(labels.withColumnRenamed("id", "a"), "a").join(small(sizes), "label")
        x, y = (F.pmod(F.xxhash64(c), F.col("parts")) for c in ("a", "b"))
        dealt = of.select("a", "b", F.col("label").alias("task"), F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    else:
        degrees = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        dealt = pairs.join(small(degrees), "a").select("a", "b", F.col("a").alias("task"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("x"), F.lit(0).cast("long").alias("y"))
    dealt = materialize(dealt, "dealt")
    task = ["task", "x", "y"]

    def sets(batches):
        hashes = Hashes()
        for batch in batches:
            out = [shingles(t, width, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["r", "s"])

    def compare(batches):
        now, held = None, {}
        for batch in batches:
            a, b = [], []
            for *key, first, second, s in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != now:
                    now, held = key, {}
                if second is None:
                    held[first] = np.frombuffer(s, np.uint64)
                    continue
                g, h = held[first], held[second]
                both = len(np.intersect1d(g, h, assume_unique=True))
                if 100 * both >= percent * (len(g) + len(h) - both):
                    a.append(first)
                    b.append(second)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    needed = materialize(dealt.select(*task, F.col("a").alias("r")).union(dealt.select(*task, "b")).distinct(), "needed")
    rows = small(materialize(known.join(small(needed.select("r").distinct()), "r", "left_semi").select("r", "id", "h1", "h2"), "texts"))
    same = rows["id"].eqNullSafe(docs["id"]) & (rows["h1"] == docs["h1"]) & (rows["h2"] == docs["h2"])
    found = map_arrow(docs.join(rows, same).select("r", "t"), sets, "r long, s binary").join(small(needed), "r")
    rows = found.select(*task, F.col("r").alias("a"), F.lit(None).cast("long").alias("b"), "s").union(dealt.select(*task, "a", "b", F.lit(None).cast("binary")))
    met = rows.repartition(*task).sortWithinPartitions(*task, F.asc_nulls_first("b"))
    return map_arrow(met, compare, "a long, b long").distinct()


def components(df: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A table of r, id, h1, h2, n and component (smallest row number reachable by links) of every row."""
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be from 1 to 100, and width 1 at least")
    before = tables()
    table = materialize(sketch(df, width, percent, id_col, text_col), "sketch")
    same = table.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("r").alias("node"), F.max("r").alias("last")).filter("node < last").drop("last")
    same = materialize(same, "same")
    rows = table.select("r", "id", "h1", "h2", "n", "f1", "f2").join(small(same), ["f1", "f2", "n"], "left")
    rows = materialize(rows.select("r", "id", "h1", "h2", "n", F.coalesce("node", "r").alias("node")), "rows")
    copies = rows.filter("node <> r").select("r")
    nodes = table.filter("length(keys) > 0").join(small(copies), "r", "left_anti")

    met = materialize(shared_keys(nodes), "met")
    of = met.groupBy("r").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # of one document
    cells = materialize(table.select("r", "n", "point").join(of, "r"), "cells")
    release(keep=before | {x._table for x in (same, rows, met, cells)})
    hot = materialize(met.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(f"c > {CELL}"), "hot")
    docs = _source(df, id_col, text_col)

    # Of the pairs that a document is the larger end of, one is tried first; as a rule it links the document.
    tried = cells.select("r", "n", "point", F.col("r").alias("label"), F.explode(F.slice("keys", 1, FEW)).alias("key"))
    part = F.expr(f"pmod(xxhash64(r, key), coalesce(ceil(c / {CELL}), 1L))")
    first = search(tried.join(small(hot), "key", "left").withColumn("part", part), percent, every=False)
    pairs = materialize(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = materialize(verify(pairs, rows, docs, width, percent), "links")
    labels = materialize(connected_components(links), "labels")

    labelled = cells.join(small(labels.withColumnRenamed("id", "r")), "r", "left").withColumn("label", F.coalesce("label", "r"))
    low = F.slice(F.filter("keys", lambda k: k % 2 == 0), 1, FIRST).alias("low")
    labelled = labelled.select("r", "n", "point", "label", low, F.explode("keys").alias("key"))
    mixed = materialize(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key"), "mixed")
    # A search passes over cells of one label; where these can be told by a broadcast, they aren't sent to it.
    still = labelled.join(F.broadcast(mixed), "key", "left_semi") if mixed.count() <= BROADCAST_ROWS else labelled
    if hot.isEmpty():
        dealt = still.withColumn("part", F.lit(0).cast("long"))
    else:
        parts = parted(still.select("key", "r", "label"), hot)
        dealt = still.join(small(hot.select("key")), "key", "left_anti").withColumn("part", F.lit(0).cast("long"))
        dealt = dealt.unionByName(still.join(parts, ["key", "r"]).select(dealt.columns))
    rest = materialize(search(dealt, percent, every=True).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = materialize(verify(rest, rows, docs, width, percent, meshed=True), "links")
        if not more.isEmpty():
            labels = materialize(connected_components(links.union(more)), "labels")
    labels = small(labels.select(F.col("id").alias("node"), "label"))
    out = materialize(rows.join(labels, "node", "left").select("r", "id", "h1", "h2", "n", F.coalesce("label", "node").alias("component")), "components")
    release(keep=before | {out._table})
    return out


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` (the smallest id reachable by links, its own included) of every row."""
    found = components(df, width, percent, id_col, text_col)
    # Rows that are a component of their own name it; the others take the smallest id of the rows of theirs.
    groups = found.groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    out = found.join(small(materialize(groups, "groups")), "component", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with one, that of the smallest id (null is the largest), of each component."""
    found = components(df, width, percent, id_col, text_col)
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("r"))
    groups = found.groupBy("component").agg(F.min(rank).alias("kept"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    member = found.join(small(materialize(groups, "groups")), "component").withColumn("keep", F.col("kept.r") == F.col("r"))
    # Rows are told apart by id and text; exact repetitions of a kept row are left to dropDuplicates.
    member = member.groupBy("id", "h1", "h2").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("c"))
    member = materialize(member.select("id", "h1", "h2", (F.col("keep") & (F.col("c") > 1)).alias("twice"), (~F.col("keep")).alias("gone")).filter("gone or twice"), "gone")
    text, key = text_of(df, text_col), F.col(id_col).cast("long")

    def of(which: str) -> tuple[DataFrame, Column]:
        m = small(member.filter(which).select(F.col("id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")))
        return m, key.eqNullSafe(m["_id"]) & (F.xxhash64(text) == m["_h1"]) & (F.xxhash64(text, F.lit(1)) == m["_h2"])

    out = df.join(*of("gone or twice"), "left_anti")
    if member.filter("twice").isEmpty():
        return out.select(df.columns)
    again = df.join(*of("twice"), "left_semi").withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(text, F.lit(1))})
    return out.select(df.columns).union(again.dropDuplicates([id_col, "_h1", "_h2"]).select(df.columns))


#: The query op2 in SQL, for tables whose ids are unique: all pairs that share a shingle, and reachability by links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
