"""Best-fit packing planned on the histogram of lengths (operator 4).

Texts become token ids once and are cut into pieces of at most `limit` tokens. The plan needs only
how many pieces have each length, at most `limit` numbers: best fit, longest first, moves whole
groups of equal sequences at a time and gives runs of slots. Pieces then take slots by their rank
within their length. A rank is a piece's number within its task (counted while the task makes its
pieces) plus the pieces of that length in earlier tasks, so no length is ever sorted or gathered,
however many rows share it.

The plan goes to every task; it has some 12,400 runs for 10^6 pieces and no more for 10^10, as there
are only `limit` lengths and rooms. The counts before each task grow with the tasks and are joined by
sorting, without their ids.

Nulls: a null text counts as empty and gives the end token alone; doc_id is passed through, so
repeated rows are packed each for itself, and pieces of equal length take slots in the order of tasks
and rows. Very long texts are cut as they are encoded, a text at a time. Columns of docs other than
doc_id and text are not looked at, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Chunks, and words, that a worker remembers the ids of, and as many again from before; longer ones are not remembered.
CHUNKS = 200_000
WORDS = 300_000
LONGEST = 40


class _Whole(Exception):
    """A chunk that only the tokenizer itself can encode, with the text around it."""


class _Kept(dict):
    """Values by key, made where they are missing. When it is full it starts anew and takes back from before what is used again, so that frequent keys stay."""

    def __init__(self, make: Callable, most: int) -> None:
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, equal to those of the tokenizer in `path`.

    The tokenizer splits a text into words, none with white space inside, and encodes each alone. So
    the ids of what stands between white space (a chunk), and of its words, can be kept. That holds
    for texts of Latin letters, digits and ASCII signs, on which Python's lower() and \\w agree with
    the tokenizer's rules; all others go through the tokenizer whole.
    """

    #: The tokenizer's word pattern, and the characters but white space on which Python's classes agree with it.
    WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    PLAIN = re.compile("[\x21-\x7e¡-¬®-±´-¸º»¿-įı-ɏ]*")
    SPECIAL = "<|"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words, self.chunks = _Kept(self._word, WORDS), _Kept(self._chunk, CHUNKS)

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)  # ASCII signs and letters stand for themselves
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters alone
            return self.words[chunk.lower().decode()]
        text = chunk.decode()
        if self.PLAIN.fullmatch(text) is None or self.SPECIAL in text:
            raise _Whole
        return b"".join(map(self.words.__getitem__, self.WORD.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        return self.encode_utf8(text.encode())

    def encode_utf8(self, text: bytes) -> bytes:
        try:
            return b"".join(map(self.chunks.__getitem__, text.split()))  # bytes are split at ASCII white space only
        except _Whole:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): the pieces of each text; nth is a piece's number among those of its length in its task."""
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary, task int, nth long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, words = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                ids = words.encode_utf8(text.as_py() or b"") + end
                for n, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for column, value in zip(rows, (i, n, at // 4, len(part) // 4, part, seen[len(part)]), strict=True):
                        column.append(value)
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    pa.array(rows[1], pa.int32()),
                    pa.array(rows[2], pa.int64()),
                    pa.array(rows[3], pa.int64()),
                    pa.array(rows[4], pa.binary()),
                    pa.array([task] * len(rows[0]), pa.int32()),
                    pa.array(rows[5], pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids", "task", "nth"],
            )
        pa.default_memory_pool().release_unused()  # the worker may live on beside the next stage

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan_slots(counts: dict[int, int], limit: int) -> dict[int, np.ndarray]:
    """Best fit, longest first, on counts: for each length its runs of slots, as rows (first rank, slots in a sequence, first sequence, offset).

    A run gives the pieces of consecutive ranks to consecutive sequences, so many to each.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    room: list[int] = []  # rooms that some sequences have left, ascending
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)
    made = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not groups[left]:
                bisect.insort(room, left)
            groups[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                left = room[at]
                first, n = groups[left].pop()
                if not groups[left]:
                    room.pop(at)
            else:
                left, first = limit, made
                n = -(-todo // (limit // length))
                made += n
            each = min(left // length, todo)
            full = min(n, todo // each)
            runs[length].append((rank, each, first, limit - left))
            put(left - each * length, first, full)
            put(left, first + full, n - full)
            rank, todo = rank + each * full, todo - each * full
    return {length: np.array(r, dtype=np.int64) for length, r in runs.items()}


def place(cut: DataFrame, limit: int) -> DataFrame:
    """cut (with length, task and nth) with sequence_id and offset for task and nth."""
    local = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = stage(local.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "lengths")
    sent = cut.sparkSession.sparkContext.broadcast(plan_slots({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit))
    # by sorting: the counts grow with the tasks and go to no task whole
    ranked = cut.join(counts.drop("n").hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "task")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                runs, ranks = slots[int(length[part[0]])], rank[part]
                first, each, base, at = runs[np.searchsorted(runs[:, 0], ranks, side="right") - 1].T
                sequence[part] = base + (ranks - first) // each
                offset[part] = at + (ranks - first) % each * length[part[0]]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(take, schema)


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, **keep: Column) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset) and what `keep` makes of the column ids; ids themselves unless it names anything."""
    keep = keep or {"ids": F.col("ids")}
    made = pieces(docs, tokenizer_path, limit, end_id)
    cut = stage(made.select("doc_id", "piece", "start", "length", *(c.alias(n) for n, c in keep.items()), "task", "nth"), "pieces")
    return place(cut, limit).select("doc_id", "piece", "start", "length", *keep, "sequence_id", "offset")
