"""SimHash near-duplicates by vantage-point trees (operator 12).

1. A text's fingerprint: of the XXH64 hashes (seed 42) of its shingles, repeats included, each bit
   that is set in over half. Equal fingerprints are one class; classes link at `radius` or fewer
   differing bits.
2. A bounded sample of the classes gives a vantage-point tree: each node has a fingerprint and a
   Hamming distance that halves its sample. Every class goes down to one leaf, its shard. By the
   triangle inequality two linked classes that a node parts lie within `radius` of its distance on
   both sides, so near ones of that boundary also visit the far side; other branches are pruned.
   Shards that are still large are parted again, each by a vantage point of its own.
3. Inside a shard the same is done in memory, down to blocks that are compared bit by bit. A shard
   gives the roots of its local components, never a list of all pairs.
4. Components of those edges give component_id.

Null and empty texts have fingerprint zero and link like any other. Repeated rows keep a row each.
A null id is never the smallest; a component without another has a null component_id. An empty
table gives no rows. Texts of any length are worked on in blocks of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stage
from .textnum import LOWER, SPACE, chunks, spans

#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
#: Classes of the sample that the tree is made from; classes wanted in a shard; and in a shard that is parted again.
SAMPLE, SHARD, LARGE = 1 << 16, 1 << 10, 1 << 15
#: Classes compared bit by bit.
BLOCK = 512


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each row of a matrix of bytes."""
    n, length = rows.shape
    seed = np.uint64(seed)
    lane = lambda lo, kind: np.ascontiguousarray(rows[:, lo : lo + np.dtype(kind).itemsize]).view(kind)[:, 0].astype(np.uint64)
    turn = lambda acc, x: _rotl(acc + x * P2, 31) * P1
    at = 0
    with np.errstate(over="ignore"):
        if length >= 32:
            acc = [np.full(n, x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while at + 32 <= length:
                acc = [turn(a, lane(at + 8 * k, "<u8")) for k, a in enumerate(acc)]
                at += 32
            h = sum((_rotl(a, r) for a, r in zip(acc, (1, 7, 12, 18), strict=True)), np.uint64(0))
            for a in acc:
                h = (h ^ turn(np.uint64(0), a)) * P1 + P4
        else:
            h = np.full(n, seed + P5, np.uint64)
        h = h + np.uint64(length)
        while at + 8 <= length:
            h = _rotl(h ^ turn(np.uint64(0), lane(at, "<u8")), 27) * P1 + P4
            at += 8
        if at + 4 <= length:
            h = _rotl(h ^ (lane(at, "<u4") * P1), 23) * P2 + P3
            at += 4
        for k in range(at, length):
            h = _rotl(h ^ (rows[:, k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of spans of bytes, those of each length together."""
    out, sizes = np.zeros(len(starts), np.uint64), ends - starts
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            length = int(sizes[rows[0]])
            step = max(1, (1 << 24) // length)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                out[part] = xxh64(data[starts[part][:, None] + np.arange(length)])
    return out


def fingerprint_of(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The fingerprints of some rows of text."""
    starts, ends, row = spans(~SPACE[data], offsets)
    n_rows = len(offsets) - 1
    words = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(words)))[:-1]
    # a shingle begins at each word that has width - 1 more after it in its row, or that is the first of a short row
    last = np.minimum(np.arange(len(row)) + width, (first + words)[row]) - 1
    begins = np.flatnonzero((last - np.arange(len(row)) == width - 1) | (np.arange(len(row)) == first[row]))
    set_bits, n = np.zeros((n_rows, 64), np.int64), np.bincount(row[begins], minlength=n_rows)
    for lo in range(0, len(begins), AT_ONCE):
        at = begins[lo : lo + AT_ONCE]
        w0, w1 = int(at[0]), int(last[at[-1]]) + 1
        sizes = ends[w0:w1] - starts[w0:w1]
        joined_at = np.concatenate(([0], np.cumsum(sizes + 1)))
        joined = np.full(int(joined_at[-1]), 0x20, np.uint8)
        part = LOWER[data[starts[w0] : ends[w1 - 1]]]
        letters = ~SPACE[part]
        joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = part[letters]
        h = _spans_hashed(joined, joined_at[at - w0], joined_at[last[at] - w0] + sizes[last[at] - w0])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = row[at]
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        set_bits[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(2 * set_bits > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(data, offsets, width).view(np.int64) for _, _, data, offsets in chunks(batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(read, f"doc_id {kind}, fp long")


def _apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _half(d: np.ndarray) -> int:
    """The distance that parts them best; some lie beyond it unless all are equal."""
    return min(int(np.median(d)), int(d.max()) - 1)


class Tree:
    """A vantage-point tree: of each node the fingerprint, the distance, and the nodes for those within it and beyond, or ~shard."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int) -> None:
        self.radius, self.shards = radius, 0
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.root = self._grow(sample, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        if len(points) > leaf:
            # of some vantage points the one that leaves fewest at the boundary
            best = None
            for at in points[:: max(1, len(points) // 8)][:8]:
                d = _apart(points, at)
                mu = _half(d)
                if d.max() > d.min():
                    edge, even = np.mean((d > mu - self.radius) & (d <= mu)), min(np.mean(d <= mu), np.mean(d > mu))
                    best = min(best or (2.0, 0, 0), (float(edge + max(0.0, 0.25 - even)), int(at), mu))
            if best:
                d = _apart(points, np.uint64(best[1]))
                k = len(self.nodes)
                self.nodes.append((np.uint64(best[1]), best[2], 0, 0))
                self.nodes[k] = (np.uint64(best[1]), best[2], self._grow(points[d <= best[2]], leaf), self._grow(points[d > best[2]], leaf))
                return k
        self.shards += 1
        return ~(self.shards - 1)

    def deal(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places of those that live there, places of those that visit)."""
        todo = [(self.root, np.arange(len(fps)), np.zeros(0, np.int64))]
        while todo:
            k, home, guest = todo.pop()
            if not len(home) + len(guest):
                continue
            if k < 0:
                yield ~k, home, guest
                continue
            at, mu, near, far = self.nodes[k]
            todo += [(near, *x) if side == 0 else (far, *x) for side, x in enumerate(part(_apart(fps[home], at), _apart(fps[guest], at), mu, self.radius, home, guest))]


def part(d: np.ndarray, g: np.ndarray, mu: int, radius: int, home: np.ndarray, guest: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(members, visitors) within distance mu and beyond it, members being at distances d and visitors at g."""
    near = (home[d <= mu], guest[g <= mu + radius])
    far = (home[d > mu], np.concatenate((home[(d <= mu) & (d > mu - radius)], guest[g > mu - radius])))
    return near, far


class Roots:
    """Components of numbered things."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def of(self, x: np.ndarray) -> np.ndarray:
        while (self.up[self.up[x]] != self.up[x]).any():
            self.up = self.up[self.up]
        return self.up[x]

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of(a), self.of(b)
            left = x != y
            a, b, x, y = a[left], b[left], x[left], y[left]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def tie_linked(fps: np.ndarray, home: np.ndarray, guest: np.ndarray, radius: int, roots: Roots) -> None:
    """Ties all members and visitors within radius of a member: parts them by vantage points as long as that helps, then compares them."""
    todo = [(home, guest)]
    while todo:
        home, guest = todo.pop()
        if len(home) > BLOCK:
            at = fps[home[len(home) // 2]]
            d = _apart(fps[home], at)
            mu = _half(d)
            if 20 * min((d <= mu).sum(), (d > mu).sum()) >= len(home):
                todo += part(d, _apart(fps[guest], at), mu, radius, home, guest)
                continue
        step = max(1, AT_ONCE * 32 // max(len(home), 1))
        for rows, own in ((home, True), (guest, False)):
            for lo in range(0, len(rows), step):
                some, others = rows[lo : lo + step], home[lo:] if own else home
                i, j = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[others][None, :]) <= radius)
                roots.tie(some[i], others[j])


def shard_rows(classes: DataFrame, radius: int, sample: int = SAMPLE, shard: int = SHARD, large: int = LARGE) -> DataFrame:
    """(shard, fp, home): each class in its shard, and as a visitor in those beyond a boundary that is near."""
    n = classes.count()
    share = min(1.0, sample / max(n, 1))
    least = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    drawn = classes.where(F.xxhash64("fp", F.lit(1)) <= least).select("fp").collect()  # about `sample` rows
    points = np.sort(np.array([r.fp for r in drawn], np.int64)).view(np.uint64)
    sent = classes.sparkSession.sparkContext.broadcast(Tree(points, max(8, int(shard * share)), radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k, home, guest in sent.value.deal(fps.view(np.uint64)):
                both = np.concatenate((home, guest))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), str(k))), pa.array(fps[both]), pa.array(np.arange(len(both)) < len(home))], ["shard", "fp", "home"])

    rows = stage(classes.select("fp").mapInArrow(deal, "shard string, fp long, home boolean"), "shards")
    return _part_large(rows, radius, large)


def _bits_apart() -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("at")))


def _part_large(rows: DataFrame, radius: int, large: int) -> DataFrame:
    """Shards of more than `large` members parted by vantage points of their own, level by level, as long as that makes them smaller."""
    kept: list[DataFrame] = []
    while True:
        sizes = stage(rows.where("home").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", "shard")).alias("at")).where(F.col("n") > large), "large")
        if sizes.limit(1).count() == 0:
            break
        met = rows.join(sizes.drop("n"), "shard").withColumn("d", _bits_apart())
        cut = met.where("home").groupBy("shard").agg(F.least(F.percentile_approx("d", 0.5, 1000), F.max("d") - 1).alias("mu"), F.percentile_approx("d", F.array(F.lit(0.05), F.lit(0.95)), 1000).alias("ends"))
        # where 90 % lie at one distance, parting doesn't help: such a shard is compared as it is
        cut = sizes.join(cut, "shard").where("ends[0] < ends[1]").select("shard", "at", "mu")
        cut = stage(cut, "cuts")
        kept.append(rows.join(cut.select("shard"), "shard", "left_anti"))
        if cut.limit(1).count() == 0:
            return _all(kept)
        near = F.when(F.col("home"), F.col("d") <= F.col("mu")).otherwise(F.col("d") <= F.col("mu") + radius)
        far = F.col("d") > F.col("mu") - radius
        sides = F.array(
            F.when(near, F.struct(F.lit("n").alias("side"), F.col("home").alias("lives"))),
            F.when(far, F.struct(F.lit("f").alias("side"), (F.col("home") & (F.col("d") > F.col("mu"))).alias("lives"))),
        )
        dealt = rows.join(cut, "shard").withColumn("d", _bits_apart()).select("shard", "fp", F.explode(F.array_compact(sides)).alias("to"))
        rows = stage(dealt.select(F.concat("shard", "to.side").alias("shard"), "fp", F.col("to.lives").alias("home")), "shards")
    return _all([*kept, rows])


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def linked(classes: DataFrame, radius: int, **sizes: int) -> DataFrame:
    """(a, b): classes tied to the root of their local component in a shard."""

    def tie(table: pa.Table) -> pa.Table:
        fps, home = table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy()
        roots = Roots(len(fps))
        tie_linked(fps, np.flatnonzero(home), np.flatnonzero(~home), radius, roots)
        up = roots.of(np.arange(len(fps)))
        at = np.flatnonzero(up != np.arange(len(fps)))
        return pa.table({"a": fps[at].view(np.int64), "b": fps[up[at]].view(np.int64)})

    return shard_rows(classes, radius, **sizes).groupBy("shard").applyInArrow(tie, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest doc_id that links reach."""
    prints = stage(fingerprints(docs, width, doc_id, text), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = connected_components(linked(classes, radius, **sizes))
    least = nodes.join(classes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(nodes.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
