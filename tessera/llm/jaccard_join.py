"""Exact n-gram Jaccard join in metric space (operator 7).

Documents become sets of hashed word shingles; equal sets are one class. Classes x and y link when
J(x, y) >= t. Jaccard distance d = 1 - J is a metric, and with it everything is cut into regions:

1. Pivots are single shingles, the rarest first (by a count of hashed shingles over all documents).
   A class lies nearest to all shingles that it has, and two linked classes share one of the first
   n - ceil(t n) + 1 of each, so a class goes to the regions of those (its boundary window).
   Where more of them must be shared (the windows are a little wider than that), pairs met in small
   regions alone count only if they meet often enough.
2. Inside a region, counts of a class's shingles by the first bits of their hash are compared, more
   counts the more shingles there are. Their L1 distance never exceeds the size of the symmetric
   difference, so it is a metric that can only let through too much. Classes are compared in the
   order of their sizes with those that aren't too small for them, which alone are held in memory;
   pairs met in small regions are compared likewise. Regions that many classes share are split by
   salt. There, leaders capture the classes within a radius; by the triangle inequality anything
   linked to a captured class lies within a wider radius of the leader, and is joined with it
   loosely. Leaders are joined once more across salts.
3. What is loosely connected is joined exactly, with whole sets: a pivot captures what lies within
   1 - t, and only classes in the triangle-inequality window around that sphere are looked at
   again, by recursion on smaller regions. Loose components too large for one task are first cut
   into Voronoi regions around several pivots, boundary classes (d <= nearest + 2 (1 - t)) being
   replicated, and this again for regions that stay large; what is far from every pivot stays one
   region and isn't replicated. The rest is joined block by block.

All pairs within a group are never listed: a link is looked for only between classes that are not
yet known to be connected. A document without words, or a null text, links with nothing. Repeated
rows are equal sets. Null doc_ids take part; a component's id is the smallest that is not null.
Texts of any length are read whole; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_staged, stage
from .textnum import chunks, shingles

#: Buckets that shingles are counted in, and counts in a row of that table.
BUCKETS, BLOCK = 1 << 22, 1 << 14
#: Least and most counts, as powers of two, that bound the difference of two sets; leaders have the least.
CELL_BITS = (6, 12)
CELLS = 1 << CELL_BITS[0]
#: Regions of at most so many classes have their pairs compared directly.
SMALL = 8
#: Least and most bits, as powers of two, of the table of classes whose sets are needed again; 32 MB at most.
BLOOM = (24, 28)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, data, offsets in chunks(column):
        row, h = shingles(data, offsets, width)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(h[a:b])


def _key(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def _id(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _cells(u: np.ndarray, bits: int = CELL_BITS[0]) -> np.ndarray:
    return np.minimum(np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _folded(raw: list[bytes], bits: int) -> np.ndarray:
    """Cells of at least so many bits as rows of that many; a count that was cut at 255 stays cut."""
    out = np.empty((len(raw), 1 << bits), np.int16)
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        cells = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(len(at), 1 << bits, -1)
        out[at] = cells[:, :, 0] if size == 1 << bits else np.minimum(cells.sum(2, dtype=np.int32), 255)
    return out


def classes(docs: DataFrame, width: int, bounds: Bounds) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, k, id, cells) of all documents, k a digest of the set, null if empty, and id its first eight bytes; and the number of documents by bucket of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        names = ["doc_id", "n", "k", "id", "cells", "block", "counts"]
        for batch in batches:
            n, k, cells = [], [], []
            for u in _sets(batch.column(1), width):
                n.append(len(u))
                k.append(_key(u) if len(u) else None)
                cells.append(_cells(u, bounds.bits(len(u))).tobytes() if len(u) else None)
                np.add.at(total, (u & np.uint64(BUCKETS - 1)).astype(np.int64), np.int32(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.binary()), pa.array([x and _id(x) for x in k], pa.int64()), pa.array(cells, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        packed = [zlib.compress(x.tobytes(), 1) for x in total.astype("<u4", copy=False).reshape(-1, BLOCK)] if total.any() else []
        if packed:
            m = len(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, batch.column(0).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(m), pa.int32()), pa.array(packed, pa.binary())], names
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
                sums[i] = sums[i] + v if i in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["block", "counts"])

    made = stage(docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, k binary, id long, cells binary, block int, counts binary"), "shingles")
    counts = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)
    partial = made.where("block is not null").select("block", "counts").repartition("block")
    for r in partial.mapInArrow(add, "block int, counts binary").collect():  # BUCKETS / BLOCK rows
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return made.where("block is null").select("doc_id", "n", "k", "id", "cells"), counts.reshape(-1)


class Bounds:
    """What J >= num / den means for sizes and differences."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.t = num, den, num / den

    def shares(self, n: np.ndarray | int) -> np.ndarray | int:
        """So many pivots at least are shared by linked classes, the smaller of which has size n, if each goes to prefix(n) regions."""
        return 1 + (n - -(-self.num * n // self.den)) // 8

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + self.shares(n)

    def difference(self, distance: float, sizes: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of two sets of these sizes in sum at a Jaccard distance."""
        return distance / (2 - distance) * sizes + 1e-9

    def wide(self, radius: float) -> float:
        """A class linked to one within radius * n of a leader of size n is within wide(radius) * n of it."""
        return radius + (1 - self.t) / self.t * (1 + radius) + 1e-9

    def bits(self, n: int) -> int:
        """Cells for a set of size n, as a power of two: so many that sets that have nothing in common differ by about twice what linked ones may."""
        a_cell = (0.56 / self.difference(1 - self.t, 2)) ** 2
        return min(max(int(n / a_cell).bit_length(), CELL_BITS[0]), CELL_BITS[1])

    def linked(self, inter: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
        return self.den * inter >= self.num * (a + b - inter)

    def apart(self, inter: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
        return 1 - inter / (a + b - inter)


def region_rows(docs: DataFrame, width: int, counts: np.ndarray, bounds: Bounds, hot: int) -> DataFrame:
    """(s, salt, id, n): each class in the regions of its first shingles, rarest first; once at most in a task. Regions that aren't split have salt -1."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, done = shared.value, set()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for u in _sets(batch.column(0), width):
                if not len(u) or (key := _key(u)) in done:
                    continue
                done.add(key)
                c = of[(u & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64)
                order = np.argsort((np.minimum(c, (1 << 23) - 1) << 40) | (u >> np.uint64(24)).astype(np.int64), kind="stable")[: bounds.prefix(len(u))]
                salts, m = 1 + c[order] // hot, len(order)
                parts[0].append(u[order].view(np.int64))
                parts[1].append(np.where(salts > 1, int.from_bytes(key[:4], "little") % salts, -1).astype(np.int32))
                parts[2].append(np.full(m, _id(key)))
                parts[3].append(np.full(m, len(u), np.int32))
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], ["s", "salt", "id", "n"])

    return docs.select("text").mapInArrow(emit, "s long, salt int, id long, n int")


def met_pairs(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b, need, s, salt, id): the pairs (a, b) of each small region, of which `need` regions must have them; and the rows (s, salt, id) of other regions."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, salt, ids, n = (c.to_numpy() for c in batch.columns)
            cut = np.flatnonzero((np.diff(s) != 0) | (np.diff(salt) != 0)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(s)]))
            size = ends - starts
            # a region that reaches over an end of the batch may be larger than it seems
            small = (size <= SMALL) & (starts > 0) & (ends < len(s)) & (salt[starts] < 0)
            last = np.repeat(np.where(small, ends, 0), size)
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for gap in range(1, SMALL):
                i = np.flatnonzero(np.arange(len(s)) + gap < last)
                if not len(i):
                    break
                near = (bounds.den * np.minimum(n[i], n[i + gap]) >= bounds.num * np.maximum(n[i], n[i + gap])) & (ids[i] != ids[i + gap])
                one.append(i[near])
                two.append(i[near] + gap)
            i, j = np.concatenate(one), np.concatenate(two)
            need = np.minimum(bounds.shares(n[i]), bounds.shares(n[j])).astype(np.int32)
            rest = np.flatnonzero(np.repeat(~small & ((size > 1) | (starts == 0) | (ends == len(s)) | (salt[starts] >= 0)), size))
            x, y = pa.nulls(len(rest), pa.int64()), pa.nulls(len(i), pa.int64())
            join = lambda values, nulls, first: pa.concat_arrays([pa.array(values), nulls] if first else [nulls, pa.array(values)])
            yield pa.RecordBatch.from_arrays(
                [
                    join(np.minimum(ids[i], ids[j]), x, True), join(np.maximum(ids[i], ids[j]), x, True), join(need, x.cast(pa.int32()), True),
                    join(s[rest], y, False), join(salt[rest], y.cast(pa.int32()), False), join(ids[rest], y, False),
                ],
                ["a", "b", "need", "s", "salt", "id"],
            )

    dealt = rows.repartition("s", "salt").sortWithinPartitions("s", "salt", "id")
    return dealt.mapInArrow(meet, "a long, b long, need int, s long, salt int, id long")


def near_pairs(pairs: DataFrame, known: DataFrame, bounds: Bounds) -> DataFrame:
    """Those of the pairs (a, b) that may link, as far as the cells of known (id, n, cells) tell."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            bits = np.array([min(len(p), len(q)).bit_length() - 1 for p, q in zip(x, y, strict=True)], np.int64)
            kept = np.zeros(len(n), bool)
            for b in np.unique(bits).tolist():
                at = np.flatnonzero(bits == b)
                far = np.abs(_folded([x[i] for i in at.tolist()], b) - _folded([y[i] for i in at.tolist()], b)).sum(1)
                kept[at] = far <= bounds.difference(1 - bounds.t, n[at])
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    side = lambda id, n, cells: known.select(F.col("id").alias(id), F.col("n").alias(n), F.col("cells").alias(cells))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return both.select("a", "b", (F.col("m") + F.col("n")).alias("n"), "x", "y").mapInArrow(test, "a long, b long")


class Window:
    """Rows of unsplit regions in the order of their sizes: those of the last region that are large enough for what may follow."""

    #: Regions of more classes are gone through row by row, so that what is tied already isn't compared again; at first with so many before it.
    LARGE, LAST = 64, 256

    def __init__(self, bounds: Bounds) -> None:
        self.bounds = bounds
        self.s = self.ids = self.n = self.root = np.zeros(0, np.int64)
        self.raw: list[bytes] = []

    def add(self, s: np.ndarray, ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """The next rows, sorted by region, size and id; the pairs of ids that may link and aren't tied yet."""
        old = len(self.s)
        s, ids, n, raw = np.concatenate((self.s, s)), np.concatenate((self.ids, ids)), np.concatenate((self.n, n)), self.raw + raw
        root = np.concatenate((self.root, np.arange(old, len(s))))
        new = np.concatenate(([True], (np.diff(s) != 0) | (np.diff(ids) != 0)))  # a class may come from several tasks
        if not new.all():
            s, ids, n, raw = s[new], ids[new], n[new], [x for x, a in zip(raw, new.tolist(), strict=True) if a]
            root = np.concatenate((root[:old], np.arange(old, len(s))))
        cut = np.flatnonzero(np.diff(s) != 0) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(s)]))
        self.s, self.ids, self.n, self.raw, self.root = s, ids, n, raw, root
        self.bits = np.array([len(x).bit_length() - 1 for x in raw])
        large = ends - starts > self.LARGE
        found = [self._small(old, np.repeat(np.where(large, 0, ends), ends - starts))]
        for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
            found.append(self._large(a, max(a, old), b))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        out = np.stack((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])), 1)
        a = starts[-1] + np.searchsorted(self.bounds.den * n[starts[-1] :], self.bounds.num * n[-1])
        _, first, back = np.unique(self.root[a:], return_index=True, return_inverse=True)
        self.s, self.ids, self.n, self.raw, self.root = s[a:], ids[a:], n[a:], raw[a:], first[back]
        return np.unique(out, axis=0)

    def _small(self, old: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within each region, all regions at once; ends: of each row's region."""
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in np.unique(self.bits[ends > 0]).tolist():  # the smaller set has fewer cells or as many
            i, at = np.flatnonzero((self.bits == b) & (ends > 0)), np.flatnonzero((self.bits >= b) & (ends > 0))
            place = np.zeros(len(ends), np.int64)
            place[at] = np.arange(len(at))
            cells = _folded([self.raw[x] for x in at.tolist()], b)
            gap = 0
            while len(i):
                gap += 1
                i = i[i + gap < ends[i]]
                i = i[self.bounds.den * self.n[i] >= self.bounds.num * self.n[i + gap]]
                x = i[(i + gap >= old) & (self.root[i] != self.root[i + gap])]
                step = max(1, (1 << 20) >> b)
                for lo in range(0, len(x), step):
                    p = x[lo : lo + step]
                    far = np.abs(cells[place[p]] - cells[place[p + gap]]).sum(1)
                    p = p[far <= self.bounds.difference(1 - self.bounds.t, self.n[p] + self.n[p + gap])]
                    if len(p):
                        one.append(p)
                        two.append(p + gap)
                        a, c = self.root[p], self.root[p + gap]
                        np.minimum.at(self.root, np.maximum(a, c), np.minimum(a, c))
                        while ((up := self.root[self.root]) != self.root).any():
                            self.root = up
        return np.concatenate(one), np.concatenate(two)

    def _large(self, start: int, old: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within one region, rows from start to end, of which those before old have been compared."""
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = start + np.searchsorted(self.bounds.den * self.n[start:end], self.bounds.num * self.n[old:end])
        held: dict[int, tuple[int, np.ndarray]] = {}
        for j, lo in zip(range(old, end), low.tolist(), strict=True):
            last = max(lo, j - self.LAST)
            for a, b in ((last, j), (lo, last)):
                others = a + np.flatnonzero(self.root[a:b] != self.root[j])
                for bits in np.unique(self.bits[others]).tolist():
                    if bits not in held:  # of those with as many cells or more
                        first = start + np.searchsorted(self.bits[start:end], bits)
                        held[bits] = first, _folded(self.raw[first:end], bits)
                    (first, cells), x = held[bits], others[self.bits[others] == bits]
                    far = np.abs(cells[x - first] - cells[j - first]).sum(1)
                    x = x[far <= self.bounds.difference(1 - self.bounds.t, self.n[x] + self.n[j])]
                    x = x[np.unique(self.root[x], return_index=True)[1]]  # one of each group
                    if len(x):
                        one.append(x)
                        two.append(np.full(len(x), j))
                        part, all_ = self.root[start:end], np.append(self.root[x], self.root[j])
                        part[np.isin(part, all_)] = all_.min()
        return np.concatenate(one), np.concatenate(two)


class Leaders:
    """The leaders of one region and, by number, which of them are loosely connected."""

    #: With so many leaders, new ones capture within this radius (as a share of their size); at last everything.
    RADII = ((64, None), (256, 0.4), (1 << 60, 1e9))

    def __init__(self, bounds: Bounds) -> None:
        self.bounds = bounds
        self.k: list[int] = []
        self.n: list[int] = []
        self.cells: list[np.ndarray] = []
        self.radius: list[float] = []
        self.group: list[int] = []

    def add(self, k: list, n: np.ndarray, cells: np.ndarray, edges: list[tuple]) -> None:
        """New classes of the region; appends the loose edges."""
        cells = cells.astype(np.int16)
        left = np.arange(len(k))
        group = np.full(len(k), -1)  # of those that an edge already ties to a leader
        at = 0
        while len(left):
            if at == len(self.k):  # every leader has been compared: the next class leads
                i = int(left[0])
                radius = next(r for most, r in self.RADII if at < most)
                self.k.append(k[i])
                self.n.append(int(n[i]))
                self.cells.append(cells[i])
                self.radius.append(1 - self.bounds.t if radius is None else radius)
                self.group.append(int(group[i]) if group[i] >= 0 else max(self.group, default=-1) + 1)
                left = left[1:]
                if not len(left):
                    return
            far = np.abs(cells[left] - self.cells[at]).sum(1)
            size, radius, mine = self.n[at], self.radius[at], self.group[at]
            near = left[far <= self.bounds.wide(radius) * size]
            for g in np.unique(group[near]).tolist():
                if g == mine:
                    continue
                these = near[group[near] == g]
                if g < 0:
                    edges += [(k[j], self.k[at]) for j in these.tolist() if k[j] != self.k[at]]
                    group[these] = mine
                else:
                    edges.append((k[int(these[0])], self.k[at]))
                    group[group == g] = mine
                    self.group = [mine if x == g else x for x in self.group]
            left = left[far > radius * size]
            at += 1


def loose_edges(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b, s, k, n, cells, radius): loose edges (a, b) of large regions, rows (s, salt, id, n, cells); and the leaders of salted ones (s and what follows)."""
    rows = rows.repartition("s", "salt").sortWithinPartitions("s", "salt", "n", "id").select("s", "salt", "id", "n", "cells")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, state, window = None, None, Window(bounds)
        for batch in batches:
            if not batch.num_rows:
                continue
            s, salt, ids, n = (batch.column(c).to_numpy().astype(np.int64) for c in range(4))
            raw, whole = batch.column(4).to_pylist(), np.flatnonzero(salt < 0)
            edges: list[tuple[int, int]] = []
            closed = []
            if len(whole):
                edges += map(tuple, window.add(s[whole], ids[whole], n[whole], [raw[i] for i in whole.tolist()]).tolist())
            split = np.flatnonzero(salt >= 0)
            s, salt, ids, n, cells = s[split], salt[split], ids[split], n[split], _folded([raw[i] for i in split.tolist()], CELL_BITS[0])
            cut = np.flatnonzero((np.diff(s) != 0) | (np.diff(salt) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(s)], strict=True) if len(s) else ():
                if (s[a], salt[a]) != region:
                    if state is not None:
                        closed.append((region[0], state))
                    region, state = (s[a], salt[a]), Leaders(bounds)
                state.add(ids[a:b].tolist(), n[a:b], cells[a:b], edges)
            yield _edges(edges, closed)
        if state is not None:
            yield _edges([], [(region[0], state)])

    return rows.mapInArrow(lead, "a long, b long, s long, k long, n int, cells binary, radius double")


def _edges(edges: list, closed: list) -> pa.RecordBatch:
    led = [(int(s), k, n, c.astype(np.uint8).tobytes(), min(d, 1e9)) for s, x in closed for k, n, c, d in zip(x.k, x.n, x.cells, x.radius, strict=True)]
    edges = list(dict.fromkeys(edges))
    rows = [(a, b, None, None, None, None, None) for a, b in edges] + [(None, None, *x) for x in led]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["a", "b", "s", "k", "n", "cells", "radius"])


def salted_edges(leaders: DataFrame, bounds: Bounds, most: int = 2048) -> DataFrame:
    """(a, b): loose edges between the leaders of a region that lies in several salts; with more than `most` leaders, or one that captures everything, all of them are tied together."""
    sorted_ = leaders.repartition("s").sortWithinPartitions("s", "k").select("s", "k", "n", "cells", "radius")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held, tied = None, [], False
        for batch in batches:
            edges = []
            for s, k, n, raw, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != region:
                    region, held, tied = s, [], False
                c = np.frombuffer(raw, np.uint8).astype(np.int16)
                if not tied and (radius >= 1e8 or len(held) >= most):
                    # anything may lie near this leader, or there are too many: from now on one stands for all, earlier ones too
                    edges += [(key, held[0][0]) for key, *_ in held[1:]]
                    del held[1:]
                    tied = True
                if tied and held:
                    edges.append((k, held[0][0]))
                    continue
                for key, size, r, other in held:
                    # x near one leader and y near the other: their links, seen from either side
                    span = max(bounds.wide(radius) * n + r * size, bounds.wide(r) * size + radius * n)
                    if np.abs(c - other).sum() <= span:
                        edges.append((k, key))
                held.append((k, n, radius, c))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])

    return sorted_.mapInArrow(tie, "a long, b long")


class Region:
    """Whole sets of one region, laid end to end."""

    def __init__(self, sets: list[np.ndarray], bounds: Bounds) -> None:
        self.bounds = bounds
        self.n = np.array([len(x) for x in sets])
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.all = np.concatenate(sets)
        width = int(np.clip(np.ceil(np.log2(self.n.mean() / 4)), 6, 12))  # longer sets need more cells to tell apart
        self.cells = np.stack([np.minimum(np.bincount((x >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width), 30_000) for x in sets]).astype(np.int16)
        self.root = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []

    def set(self, i: int) -> np.ndarray:
        return self.all[self.at[i] : self.at[i + 1]]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with the others."""
        x, n = self.set(i), self.n[others]
        ends = np.cumsum(n)
        flat = self.all[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[others] - (ends - n), n)]
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        sums = np.concatenate(([0], np.cumsum(hit)))
        return sums[ends] - sums[ends - n]

    def near(self, i: int, others: np.ndarray, distance: float) -> np.ndarray:
        """Those of the others that may lie within the distance of i, as far as cells tell."""
        kept = []
        for lo in range(0, len(others), 4096):
            o = others[lo : lo + 4096]
            kept.append(o[np.abs(self.cells[o] - self.cells[i]).sum(1) <= self.bounds.difference(min(distance, 1.0), self.n[o] + self.n[i])])
        return np.concatenate(kept) if kept else others

    def tie(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.edges.append((i, j))
            self.root[self.root == b] = a

    def look(self, i: int, others: np.ndarray) -> None:
        """Ties i to those of the others that it links with, one of each component at most; those whose cells differ too much aren't read."""
        others = others[self.root[others] != self.root[i]]
        others = self.near(i, others, 1 - self.bounds.t)
        if len(others):
            for j in others[self.bounds.linked(self.shared(i, others), self.n[others], self.n[i])].tolist():
                self.tie(i, j)

    def join(self) -> list[tuple[int, int]]:
        """Ties until what is linked is connected."""
        r = 1 - self.bounds.t
        _, back, often = np.unique(self.all, return_inverse=True, return_counts=True)
        sums = np.concatenate(([0], np.cumsum(often[back])))
        common = (sums[self.at[1:]] - sums[self.at[:-1]]) / self.n
        left = np.argsort(-common, kind="stable")  # pivots are those whose shingles most others have
        free = np.ones(len(left), bool)
        for p in left.tolist():
            if not free[p]:
                continue
            free[p] = False
            others = self.near(p, left[free[left]], 2 * r)  # the triangle inequality keeps the rest from all that p catches
            if not len(others):
                continue
            inter = self.shared(p, others)
            d = self.bounds.apart(inter, self.n[others], self.n[p])
            caught = self.bounds.linked(inter, self.n[others], self.n[p])
            free[others[caught]] = False
            for j in others[caught].tolist():
                self.tie(p, j)
            inside, din = np.concatenate(([p], others[caught])), np.concatenate(([0.0], d[caught]))
            around = ~caught & (d <= 2 * r + 1e-9)
            for i, di in zip(others[around].tolist(), d[around].tolist(), strict=True):
                self.look(i, inside[din >= di - r - 1e-9])
        return self.edges


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[bytes], list[np.ndarray]]]:
    """(region, keys, sets) of rows (region, k, set) that are sorted by region and k; equal keys once."""
    region, keys, sets = None, [], []
    for batch in batches:
        for g, k, raw in zip(*(batch.column(c).to_pylist() for c in ("region", "k", "set")), strict=True):
            if g != region:
                if len(keys) > 1:
                    yield region, keys, sets
                region, keys, sets = g, [], []
            if not keys or keys[-1] != k:
                keys.append(k)
                sets.append(np.frombuffer(raw, "<u8"))
    if len(keys) > 1:
        yield region, keys, sets


def exact_edges(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b): enough links within each region of rows (region, k, set) to connect what is linked there."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, sets in _groups(batches):
            found = Region(sets, bounds).join()
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.binary()), pa.array([keys[j] for _, j in found], pa.binary())], ["a", "b"])

    return rows.select("region", "k", "set").repartition("region").sortWithinPartitions("region", "k").mapInArrow(join, "a binary, b binary")


def voronoi(rows: DataFrame, bounds: Bounds, pivots: int = 16) -> DataFrame:
    """Rows (region, k, set) in the regions around pivots of each region: nearest and boundary ones; with d, and the edge (a) to the pivot where it links.

    A class within 2 (1 - t) of some pivot is at home with its nearest, and what links with it lies
    within 3 (1 - t). Classes that are farther from every pivot are at home together, as one region
    more. Pivots lie farther than 2 (1 - t) from each other.
    """
    part = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(pivots))
    chosen = (
        rows.groupBy("region", part.alias("j"))
        .agg(F.min_by(F.struct("k", "set"), F.xxhash64("k", F.lit(12))).alias("p"))
        .groupBy("region")
        .agg(F.array_sort(F.collect_list(F.struct("j", "p.k", "p.set"))).alias("pivots"))
    )
    r = 1 - bounds.t

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region", "k", "set", "d", "a"]
        mine, apart = None, []  # the region, and its pivots

        def to(x: np.ndarray, y: np.ndarray) -> tuple[float, bool]:
            inter, n = np.array(len(np.intersect1d(x, y, assume_unique=True))), np.array(len(x))
            return float(bounds.apart(inter, n, len(y))), bool(bounds.linked(inter, n, len(y)))

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for g, k, raw, around in zip(*(batch.column(c).to_pylist() for c in ("region", "k", "set", "pivots")), strict=True):
                if g != mine:
                    mine, apart = g, []
                    for p in around:
                        y = np.frombuffer(p["set"], "<u8")
                        if all(to(y, z)[0] > 2 * r for *_, z in apart):
                            apart.append((p["j"], p["k"], y))
                x = np.frombuffer(raw, "<u8")
                met = [(*to(x, y), j, p) for j, p, y in apart]
                nearest = min(d for d, *_ in met)
                at = [(f"{g}/{j}", d, p if tied else None) for d, tied, j, p in met if d <= min(nearest + 2 * r, 3 * r) + 1e-9]
                if nearest > 2 * r:
                    at.append((f"{g}/-", 1.0, None))
                for region, d, p in at:
                    for column, value in zip(out, (region, k, raw, d, p), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.binary())], names)

    return rows.join(chosen, "region").select("region", "k", "set", "pivots").mapInArrow(cut, "region string, k binary, set binary, d double, a binary")


def large_edges(rows: DataFrame, bounds: Bounds, most: int, levels: int = 3) -> DataFrame:
    """(a, b) of regions whose sets take more than `most` bytes."""
    found = None
    r = 1 - bounds.t
    for level in range(levels):
        cut = stage(voronoi(rows, bounds), "voronoi")
        tied = cut.where("a is not null").select("a", F.col("k").alias("b"))
        found = tied if found is None else found.unionByName(tied)
        # of what a pivot has caught, only what may link with something outside its sphere goes on
        edge = cut.groupBy("region").agg(F.min(F.when(F.col("a").isNull(), F.col("d"))).alias("first"))
        rows = cut.join(edge, "region").where(F.col("a").isNull() | (F.col("d") >= F.col("first") - r - 1e-9)).select("region", "k", "set")
        rows = stage(rows.dropDuplicates(["region", "k"]) if level else rows, "regions")
        size = rows.groupBy("region").agg(F.sum(F.length("set")).alias("bytes"))
        size = stage(size, "bytes")
        small = rows.join(size.where(F.col("bytes") <= most), "region", "left_semi")
        found = found.unionByName(exact_edges(small, bounds))
        rows = rows.join(size.where(F.col("bytes") > most), "region", "left_semi")
        if not size.where(F.col("bytes") > most).limit(1).count():
            return stage(found, "exact")
        rows = stage(rows, "regions")
    # regions that pivots don't cut: block by block, each pair of blocks in a task of its own
    size = rows.groupBy("region").agg(F.ceil(F.sum(F.length("set")) * 2 / most).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("k", F.lit(13)), F.col("blocks"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(":", F.least(mine, j), F.greatest(mine, j))))
    blocks = rows.join(size, "region").select("region", "k", "set", pairs.alias("pair"))
    blocks = blocks.select(F.concat_ws("/", "region", "pair").alias("region"), "k", "set")
    return stage(found.unionByName(exact_edges(blocks, bounds)), "exact")


def wanted_sets(docs: DataFrame, width: int, members: DataFrame) -> DataFrame:
    """(k, id, set) of the classes with an id in members (node), and a few more; once at most in a task.

    The table has 16 bits a member, within bounds: beyond some 16 million members more sets come along
    that the join with the members then drops.
    """
    size = 1 << min(max((16 * members.count()).bit_length(), BLOOM[0]), BLOOM[1])
    bits = F.col("node").bitwiseAND(size - 1)
    maps = (
        members.select(F.shiftright(bits, 15).alias("i"), bits.bitwiseAND(32767).alias("at"))
        .groupBy("i")
        .agg(F.bitmap_construct_agg("at").alias("map"))
        .collect()  # size / 32768 rows
    )
    table = np.zeros((size // 32768, 4096), np.uint8)
    for row in maps:
        table[row["i"]] = np.frombuffer(bytes(row["map"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, done = shared.value, set()
        for batch in batches:
            k, raw, held = [], [], 0
            for u in _sets(batch.column(0), width):
                if not len(u) or (key := _key(u)) in done:
                    continue
                at = _id(key) & (size - 1)
                if there[at >> 3] >> (at & 7) & 1:
                    done.add(key)
                    k.append(key)
                    raw.append(u.tobytes())
                    held += len(raw[-1])
                    if held > 1 << 24:
                        yield pack(k, raw)
                        k, raw, held = [], [], 0
            yield pack(k, raw)

    def pack(k: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array([_id(x) for x in k], pa.int64()), pa.array(raw, pa.binary())], ["k", "id", "set"])

    return docs.select("text").mapInArrow(emit, "k binary, id long, set binary")


def jaccard_components(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), hot: int = 20_000, task_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document.

    hot: documents with a shingle from which its region is split by salt. task_bytes: bytes of sets
    that one task joins. class_id is a digest of the set, null for an empty one.
    """
    spark, batch = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1000")  # rows are whole texts and sets: a task holds few at a time
    try:
        return _components(docs, width, Bounds(*similarity), hot, task_bytes)
    finally:
        spark.conf.set(batch, before)


def _components(docs: DataFrame, width: int, bounds: Bounds, hot: int, task_bytes: int) -> DataFrame:
    made, counts = classes(docs, width, bounds)
    kinds = made.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    known = made.where("k is not null").groupBy("id").agg(F.max("n").cast("int").alias("n"), F.min_by("cells", "k").alias("cells"))
    met = stage(met_pairs(region_rows(docs, width, counts, bounds, hot), bounds), "met")
    pairs = met.where("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    pairs = near_pairs(pairs, known, bounds)
    loose = stage(loose_edges(met.where("s is not null").select("s", "salt", "id").join(known, "id"), bounds), "loose")
    edges = pairs.unionByName(loose.where("a is not null").select("a", "b")).unionByName(salted_edges(loose.where("s is not null"), bounds))
    loosely = stage(connected_components(edges), "loosely")
    size = loosely.join(known.select("id", "n"), F.col("node") == F.col("id")).groupBy("root").agg((8 * F.sum("n")).alias("bytes"))
    of = stage(loosely.join(size, "root").select("node", F.col("root").cast("string").alias("region"), "bytes"), "of")
    sets = lambda of: wanted_sets(docs, width, of).join(of, F.col("id") == F.col("node")).select("region", "k", "set")
    exact = exact_edges(sets(of.where(F.col("bytes") <= task_bytes)), bounds)
    if of.where(F.col("bytes") > task_bytes).limit(1).count():
        large = stage(sets(of.where(F.col("bytes") > task_bytes)).dropDuplicates(["region", "k"]), "sets")
        exact = exact.unionByName(large_edges(large, bounds, task_bytes))
    roots = connected_components(exact)
    low = roots.join(kinds, F.col("node") == F.col("k")).groupBy("root").agg(F.min("rep").alias("low"))
    low_of = roots.join(low, "root").select(F.col("node").alias("k"), "low")
    named = stage(kinds.join(low_of, "k", "left").select("k", F.coalesce("low", "rep").alias("component_id")), "named")
    drop_staged(met)
    drop_staged(loose)
    return made.join(named, "k", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("k").alias("class_id"), F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, then text hash (a null doc_id comes first). Documents without words stay."""
    row = F.struct("doc_id", F.xxhash64("text").alias("h"))
    found = jaccard_components(docs.select(row.alias("doc_id"), "text"), width, similarity).where("class_id is not null")
    found = stage(found.select(F.col("doc_id.doc_id").alias("_d"), F.col("doc_id.h").alias("_h"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "components")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    left = docs.join(found.where(~F.col("stays")).select("_d", "_h").distinct(), same, "left_anti")
    # rows repeated with doc_id and text: one of them
    repeated = stage(found.where("stays").groupBy("_d", "_h").count().where("count > 1").select("_d", "_h"), "repeated")
    if not repeated.limit(1).count():
        return left
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same, "left_anti").unionByName(once)
