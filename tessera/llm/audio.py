"""Chroma fingerprints of recordings and their alignment (operator 5).

A recording's samples become frames of energy by pitch class. Filters that compare rectangles of
frames and pitch classes, taken from an integral image, give two bits each; sixteen of them pack into
one 32-bit integer a frame. Recordings with equal fingerprints are one class. Query classes are
aligned with all classes: equal integers vote for an offset, and every offset with enough votes is
scored by the share of differing bits where the two overlap; the lowest share decides.

A run of equal integers (silence, a held note) votes once, at its start: a long silence says no more
than a short one. Query classes are those with a media_id divisible by `every`, a stated set against
all rows. Blocks of them of bounded size go to every task in turn, which counts votes and bits for its
own classes in numpy: no vote is shuffled, none is left out, and no task holds the partners of a query
or of a class.

Null or empty samples, and recordings shorter than one filter, have empty fingerprints and align with
nothing; so have all recordings without enough changes to reach `votes`. A missing rate or one of 0
counts as 1 sample a second. Repeated rows are one class and each keeps its row. Ties between offsets
go to the smallest, between query classes to the smallest id. Spectra are taken a slice of frames at a
time, so a long recording needs no more memory than its own samples. Columns other than media_id,
samples and rate are not looked at and not returned, whatever their names. An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Samples of a frame and between frames, at any rate; frames of a filter.
FRAME, STEP, SPAN = 1024, 256, 8
#: Filters (first pitch class, pitch classes, kind): 0 compares halves in time, 1 in pitch, 2 the middle with the rest, 3 the quarters.
FILTERS = tuple((p, h, k) for k, h, firsts in ((0, 4, (0, 4, 8)), (0, 12, (0,)), (1, 4, (0, 4, 8, 2)), (1, 6, (0, 6)), (2, 6, (0, 3, 6)), (3, 6, (0, 2, 6))) for p in firsts)
#: Bytes of query fingerprints that go to the tasks at once, in the mean of the blocks.
BLOCK = 8 << 20
#: Votes that are listed one by one; beyond it those of a pair are counted by offset at once.
LISTED = 1 << 21
_GRAY = np.array([0, 1, 3, 2], np.uint32)
_WINDOW = np.hanning(FRAME)


@cache
def _fold(rate: int) -> tuple[int, int, np.ndarray]:
    """First and last bin of the spectrum that count, and the pitch class of each between."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    there = np.flatnonzero((hertz >= 110) & (hertz <= min(3520, rate / 2)))
    if not len(there):
        return 0, 0, np.zeros((0, 12))
    fold = np.zeros((len(there), 12))
    fold[np.arange(len(there)), np.round(12 * np.log2(hertz[there] / 440)).astype(int) % 12] = 1
    return there[0], there[-1] + 1, fold


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy by pitch class of each frame, as shares (frames, 12)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    n = 1 + (len(samples) - FRAME) // STEP
    lo, hi, fold = _fold(rate)
    out = np.empty((n, 12))
    for at in range(0, n, 512):  # a slice stays in the processor's cache
        part = samples[at * STEP : (min(at + 512, n) - 1) * STEP + FRAME].astype(np.float64)
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::STEP]
        spectrum = np.fft.rfft(frames * _WINDOW, axis=1)[:, lo:hi]
        out[at : at + 512] = (spectrum.real**2 + spectrum.imag**2) @ fold
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One unsigned 32-bit integer for each position of the filters."""
    c = chroma(samples, rate)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        late, early = image[t1 : t1 + n], image[t0 : t0 + n]
        return late[:, p1] - early[:, p1] - late[:, p0] + early[:, p0]

    out = np.zeros(n, np.uint32)
    for i, (p, h, kind) in enumerate(FILTERS):
        q, half, s = p + h, p + h // 2, SPAN // 2
        if kind == 0:
            a, b = box(0, s, p, q), box(s, SPAN, p, q)
        elif kind == 1:
            a, b = box(0, SPAN, p, half), box(0, SPAN, half, q)
        elif kind == 2:
            a, b = box(0, SPAN, p + h // 3, p + 2 * h // 3), box(0, SPAN, p, q) / 2
        else:
            a, b = box(0, s, p, half) + box(s, SPAN, half, q), box(0, s, half, q) + box(s, SPAN, p, half)
        d = np.log((a + 0.01) / (b + 0.01))
        out |= _GRAY[np.digitize(d, (-0.7, 0.0, 0.7))] << np.uint32(2 * i)
    return out


def pcm(samples: bytes | None, rate: int | None) -> tuple[np.ndarray, int]:
    """Little-endian 16-bit samples; an odd last byte is left out."""
    return np.frombuffer(samples or b"", "<i2", len(samples or b"") // 2), rate or 1


def fingerprints(media: DataFrame, columns: tuple[str, ...] = ("samples", "rate"), decode: Callable = pcm) -> DataFrame:
    """(media_id, fp, k) of media: fp the integers as little-endian bytes, k their digest.

    decode turns a row's `columns` into samples and their rate.
    """
    kind = media.schema["media_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fps = [fingerprint(*decode(*row)).astype("<u4").tobytes() for row in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                keys = [hashlib.blake2b(fp, digest_size=16).digest() for fp in fps]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.binary())], ["media_id", "fp", "k"])

    return media.select("media_id", *columns).mapInArrow(make, f"media_id {kind}, fp binary, k binary")


def starts(fp: np.ndarray) -> np.ndarray:
    """Positions at which the integer differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, np.int64)


def offset_votes(q_at: np.ndarray, q: np.ndarray, x_at: np.ndarray, x: np.ndarray, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """(offsets x_at - q_at, their votes) of two recordings' items, in memory of their lengths.

    Integers with many positions on both sides are counted by correlation, the rest one by one.
    """
    first, length = int(q_at.max()), int(q_at.max() + x_at.max()) + 1
    total = np.zeros(length, np.int64)
    size = 1 << int(length).bit_length()
    values, q_n = np.unique(q, return_counts=True)
    for value, n in zip(values, q_n, strict=True):
        a, b = q_at[q == value], x_at[x == value]
        if n * len(b) <= listed:
            total += np.bincount((b[None, :] - a[:, None]).ravel() + first, minlength=length)
        else:
            one, two = np.zeros(size), np.zeros(size)
            one[first - a], two[b] = 1, 1
            total += np.rint(np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), size))[:length].astype(np.int64)
    at = np.flatnonzero(total)
    return at - first, total[at]


def bit_error(q: np.ndarray, x: np.ndarray, offset: int) -> float:
    """Share of differing bits where q, moved by offset, and x overlap."""
    a, b = q[max(-offset, 0) :], x[max(offset, 0) :]
    n = min(len(a), len(b))
    return int(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n)


class Queries:
    """A block of query fingerprints, sorted by integer."""

    def __init__(self, ids: list[int], fps: list[bytes]) -> None:
        self.ids = ids
        self.fps = [np.frombuffer(fp, "<u4") for fp in fps]
        at = [starts(fp) for fp in self.fps]
        item = np.concatenate([fp[p] for fp, p in zip(self.fps, at, strict=True)])
        order = np.argsort(item, kind="stable")
        self.item = item[order]
        self.which = np.repeat(np.arange(len(ids)), [len(p) for p in at])[order]
        self.at = np.concatenate(at)[order]

    def candidates(self, x: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, offset) of every offset with enough votes of recording x."""
        x_at = starts(x)
        items = x[x_at]
        lo, hi = np.searchsorted(self.item, items, "left"), np.searchsorted(self.item, items, "right")
        n = hi - lo
        if n.sum() > LISTED:
            found = [(i, o) for i in range(len(self.ids)) for o in self._of_pair(i, x_at, items, votes)]
            return np.array([i for i, _ in found], np.int64), np.array([o for _, o in found], np.int64)
        hits = np.repeat(hi - n.cumsum(), n) + np.arange(n.sum())  # every position between lo and hi
        wide = len(x) + max(map(len, self.fps)) + 1
        keys, count = np.unique(self.which[hits] * (2 * wide) + np.repeat(x_at, n) - self.at[hits] + wide, return_counts=True)
        keys = keys[count >= votes]
        return keys // (2 * wide), keys % (2 * wide) - wide

    def _of_pair(self, i: int, x_at: np.ndarray, items: np.ndarray, votes: int) -> np.ndarray:
        at = starts(self.fps[i])
        offsets, n = offset_votes(at, self.fps[i][at], x_at, items)
        return offsets[n >= votes]

    def links(self, x_id: int, x: np.ndarray, votes: int, errors: float) -> Iterator[tuple[int, int, float]]:
        """(query id, offset, error) of each query that x aligns with."""
        best: dict[int, tuple[float, int]] = {}
        for i, offset in zip(*(a.tolist() for a in self.candidates(x, votes)), strict=True):
            if self.ids[i] != x_id:
                best[i] = min(best.get(i, (2.0, 0)), (bit_error(self.fps[i], x, offset), offset))
        yield from ((self.ids[i], offset, error) for i, (error, offset) in best.items() if error <= errors)


def linked(classes: DataFrame, block: Queries, votes: int, errors: float) -> DataFrame:
    """(x, n_links, error, q, offset) of each class that aligns with queries of the block: their number and the best."""
    kind = classes.schema["class_id"].dataType.simpleString()
    sent = classes.sparkSession.sparkContext.broadcast(block)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            rows = []
            for x_id, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := list(block.links(x_id, np.frombuffer(fp, "<u4"), votes, errors)):
                    error, q, offset = min((e, q, o) for q, o, e in found)
                    rows.append((x_id, len(found), error, q, offset))
            x, n, e, q, o = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, batch.column(0).type), pa.array(n, pa.int64()), pa.array(e, pa.float64()), pa.array(q, batch.column(0).type), pa.array(o, pa.int64())],
                ["x", "n_links", "error", "q", "offset"],
            )

    return classes.select("class_id", "fp").mapInArrow(vote, f"x {kind}, n_links long, error double, q {kind}, offset long")


def align(prints: DataFrame, every: int = 100, votes: int = 4, errors: float = 0.30, block: int = BLOCK) -> DataFrame:
    """(media_id, class_id, n_frames, n_links, best_class, best_offset, best_error) of every recording.

    n_links: query classes, other than its own, that the class aligns with; best_*: the one with the
    lowest share of differing bits, then the smallest id. best_offset: frames by which the query's
    part stands earlier.
    """
    prints = stage(prints, "prints")
    asked = F.max((F.pmod("media_id", F.lit(every)) == 0).cast("int")).alias("asked")
    kinds = stage(prints.where(F.octet_length("fp") > 0).groupBy("k").agg(F.min("media_id").alias("class_id"), asked, F.first("fp").alias("fp")), "classes")
    queries = kinds.where("asked = 1").select("class_id", "fp")
    blocks = -(-(queries.agg(F.sum(F.octet_length("fp"))).first()[0] or 0) // block)
    links = None
    for b in range(blocks):  # each block is bounded; their number grows with the stated query set
        rows = queries.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == b).orderBy("class_id").collect()
        if rows:
            part = stage(linked(kinds, Queries([r.class_id for r in rows], [bytes(r.fp) for r in rows]), votes, errors), "links")
            links = part if links is None else links.unionByName(part)
    if links is None:
        links = prints.sparkSession.createDataFrame([], "x long, n_links long, error double, q long, offset long")
    links = links.groupBy("x").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("error", "q", "offset")).alias("b"))
    named = kinds.select("k", "class_id").join(links, F.col("class_id") == F.col("x"), "left").drop("x")
    return prints.select("media_id", "k", (F.octet_length("fp") / 4).cast("long").alias("n_frames")).join(named, "k", "left").select(
        "media_id", F.coalesce("class_id", "media_id").alias("class_id"), "n_frames", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("b.q").alias("best_class"), F.col("b.offset").alias("best_offset"), F.round("b.error", 6).alias("best_error"),
    )


#: The notes of played(): samples a second, samples a note, and two octaves of tones.
RATE, NOTE = 8000, 800
_TONES = np.array([np.sin(2 * np.pi * 220 * 2 ** (p / 12) * np.arange(NOTE) / RATE) * np.hanning(NOTE + 2)[1:-1] * 12_000 for p in range(24)]).astype("<i2")


def played(vector: list[float] | None) -> tuple[np.ndarray, int]:
    """A recording made from a vector, one note for each number: the tables hold no sound."""
    x = np.array([0.0 if c is None or not np.isfinite(c) else c for c in vector or []])
    pitch = np.clip(np.floor((x * np.sqrt(max(len(x), 1)) + 2) / 4 * 24), 0, 23).astype(int)
    return _TONES[pitch].reshape(-1), RATE
