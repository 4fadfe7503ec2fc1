"""Groups of spelling variants by full neighbourhood generation (operator 11).

1. Words are counted: maximal runs of Latin letters, A-Z lower-cased; a fixed share of the runs
   (a rule on the crc32 of document and run) loses one letter first, which plants slips.
2. Every word emits all distinct strings one deletion, replacement or insertion away, over the
   letters that the vocabulary has. Strings that no word can be are held back before the shuffle by
   a bitmap of the vocabulary's hashes, of 32 MB at most: beyond some 16 million words it fills up
   and lets more through, but never holds a word back.
3. What is left is hash-joined with the vocabulary by the string itself. A match is exactly one edit
   away, so no distance is computed; each word keeps its number of matches and the most frequent.
4. A form is at least twice as frequent as its word, so chains of forms have no cycles and fewer
   than 64 links; their ends are found by doubling.

Null texts have no words; a null id counts as the empty string in the crc32; repeated rows count
once each; ties of frequency go to the smaller string in code-point order; an empty table gives no
rows. Texts and runs may have any length: long ones are worked on in pieces that end at no letter,
candidates in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage
from .textnum import _BASE, _INVERSE, _TABLE, LOWER, chunks, mix, spans

#: Bytes of letters in UTF-8: A-Z, a-z, and 0xC3, which leads all of U+00C0 to U+00FF.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
#: Every so many runs, by their crc32, lose a letter.
SLIP = 97
#: Words have at least so many letters and occurrences.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Least and most bits, as powers of two, of the bitmap of the vocabulary; and bits in a block of it.
BITMAP, BLOCK = (20, 28), 1 << 20
#: Bits a word, probes of a candidate, and candidates made at once.
SPARSE, PROBES, AT_ONCE = 16, 4, 1 << 20

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> 1) ^ np.uint32(0xEDB88320), _crc >> 1).astype(np.uint32)


def _pieces(data: np.ndarray, limit: int = 1 << 22) -> Iterator[np.ndarray]:
    """The text in pieces of about `limit` bytes that end before no letter; a longer run stays whole."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        while hi < len(data):
            inside = _letters(data[lo : hi + 1])
            if len(stop := np.flatnonzero(~inside)):
                hi = lo + int(stop[-1]) + 1
                break
            hi = min(hi + limit, len(data))
        yield data[lo:hi]
        lo = hi


def _letters(data: np.ndarray) -> np.ndarray:
    is_letter = LETTER[data]
    is_letter[1:] |= data[:-1] == 0xC3
    return is_letter


def crc32_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The crc32 of spans of bytes, each carried on from the crc32 `state` of what stands before it."""
    out = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    at, n, s = starts[order], sizes[order], out[order]
    long = int(np.searchsorted(-n, -64, side="left"))
    for i in range(long):
        s[i] = zlib.crc32(data[at[i] : at[i] + n[i]].tobytes(), int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(n[long]) if long < len(n) else 0):
        k = int(np.searchsorted(-n, -j, side="left"))  # the first k spans are longer than j
        s[long:k] = _crc[(s[long:k] ^ data[at[long:k] + j]) & 0xFF] ^ (s[long:k] >> 8)
    out[order] = s
    return out ^ np.uint32(0xFFFFFFFF)


def _words(data: np.ndarray, offsets: np.ndarray, ids: list[str]) -> list[pa.Array]:
    """The words of some rows, repeats included, slips made."""
    data = LOWER[data]
    starts, ends, row = spans(_letters(data), offsets)
    if not len(starts):
        return []
    before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
    h = crc32_of(data, starts, ends - starts, before[row])
    points = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    letters = points[ends] - points[starts]
    slip = h % SLIP == 0
    whole = ~slip & (letters >= LEAST_LETTERS)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[whole]] += 1
    edge[ends[whole]] -= 1  # a run ends before a byte that is no letter or a new row, where another may begin
    body = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate(([0], np.cumsum((ends - starts)[whole]))).astype(np.int32)
    out = [pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])]
    slipped = []
    for i in np.flatnonzero(slip & (letters > LEAST_LETTERS)).tolist():
        run = data[starts[i] : ends[i]].tobytes().decode()
        k = int(h[i]) % len(run)
        slipped.append(run[:k] + run[k + 1 :])
    return [*out, pa.array(slipped, pa.string())]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of the texts, slips made, with at least LEAST_COUNT occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).fill_null("").to_pylist(), []
            for lo, hi, data, offsets in chunks(batch.column(1), 1 << 22):
                if hi - lo == 1:
                    for piece in _pieces(data):
                        found += _words(piece, np.array([0, len(piece)]), ids[lo:hi])
                else:
                    found += _words(data, offsets, ids[lo:hi])
            if found:
                counted = pa.chunked_array(found).value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])

    made = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the words, one byte each, and where the words begin."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    words = words.cast(pa.large_string())
    _, at, data = words.buffers()
    offsets = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    lead = raw == 0xC3
    skipped = np.concatenate(([0], np.cumsum(lead)))
    where = offsets - offsets[0]
    return np.where(raw >= 0x80, raw + 0x40, raw).astype(np.uint8)[~lead], where - skipped[where]


def _strings(rows: np.ndarray) -> pa.Array:
    """Strings of a matrix of one-byte letters."""
    n, length = rows.shape
    flat = rows.reshape(-1)
    wide = flat >= 0x80
    at = np.concatenate(([0], np.cumsum(1 + wide)))
    out = np.empty(int(at[-1]), np.uint8)
    out[at[:-1][wide]] = 0xC3
    out[at[1:] - 1] = np.where(wide, flat - 0x40, flat)
    offsets = np.ascontiguousarray(at[:: max(length, 1)] if length else np.zeros(n + 1, np.int64))
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _place(h: np.ndarray, length: int, k: int, bits: int) -> np.ndarray:
    """The k-th place in the bitmap of strings with these hashes."""
    return mix(h + np.uint64(length + (k << 40))) >> np.uint64(64 - bits)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of letters) of the words of each length, in blocks."""
    codes, at = _codes(words)
    sizes = np.diff(at)
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        for lo in range(0, len(rows), 2048):
            part = rows[lo : lo + 2048]
            yield part, codes[at[part][:, None] + np.arange(length)]


def bitmap(words: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, bytes) of the vocabulary's hashes: 2 ** bits places, whose number follows the words, 32 MB at most."""
    bits = min(max((SPARSE * max(n, 1) - 1).bit_length(), BITMAP[0]), BITMAP[1])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, m in _by_length(batch.column(0)):
                h = (_TABLE[m] * _powers(m.shape[1])).sum(axis=1, dtype=np.uint64)
                found += [_place(h, m.shape[1], k, bits) for k in range(PROBES)]
            p = np.unique(np.concatenate(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((p // BLOCK).astype(np.int32)), pa.array((p % BLOCK).astype(np.int32))], ["block", "place"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            block, place = (c.to_numpy() for c in batch.columns)
            for b in np.unique(block).tolist():
                drawn.setdefault(b, np.zeros(BLOCK, bool))[place[block == b]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(drawn), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in drawn.values()], pa.binary())], ["block", "bytes"])

    out = np.zeros((1 << bits) // BLOCK * (BLOCK // 8), np.uint8).reshape(-1, BLOCK // 8)
    made = words.select("word").mapInArrow(places, "block int, place int").repartition("block").mapInArrow(draw, "block int, bytes binary")
    for r in made.collect():  # 256 blocks of 128 KB at most
        out[r["block"]] = np.frombuffer(r["bytes"], np.uint8)
    return bits, out.reshape(-1)


def neighbourhood(m: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """All distinct strings one edit from words of one length, in blocks: (change of length, positions, hash and whether to take it, by word, position and letter).

    A letter is deleted only where the one before differs, and inserted only where it differs from
    the one before, so that no string is made twice.
    """
    n, length = m.shape
    up, down = _powers(length + 2), np.uint64(_INVERSE)
    value = _TABLE[m] * up[:length]
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(value, axis=1, out=before[:, 1:])
    after = before[:, -1:] - before
    letter = _TABLE[alphabet]
    new = np.ones((n, length), bool)
    new[:, 1:] = m[:, 1:] != m[:, :-1]
    yield -1, np.arange(length), (before[:, :-1] + after[:, 1:] * down)[:, :, None], new[:, :, None]
    step = max(1, AT_ONCE // (n * len(alphabet)))
    for lo in range(0, length, step):
        cols = np.arange(lo, min(lo + step, length))
        yield 0, cols, (before[:, -1:] - value[:, cols])[:, :, None] + letter * up[cols][:, None], m[:, cols][:, :, None] != alphabet
    for lo in range(0, length + 1, step):
        cols = np.arange(lo, min(lo + step, length + 1))
        there = m[:, np.maximum(cols - 1, 0)][:, :, None] != alphabet
        there[:, cols == 0] = True
        yield 1, cols, (before[:, cols] + after[:, cols] * np.uint64(_BASE))[:, :, None] + letter * up[cols][:, None], there


def _edited(m: np.ndarray, change: int, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The words of m, one edit made in each."""
    k, length = m.shape
    cols = np.arange(length + change)
    if change < 0:
        return m[np.arange(k)[:, None], cols + (cols >= at[:, None])]
    out = m.copy() if not change else m[np.arange(k)[:, None], np.minimum(cols - (cols > at[:, None]), length - 1)]
    out[np.arange(k), at] = letters
    return out


def _let_through(m: np.ndarray, alphabet: np.ndarray, bits: int, table: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(words, strings) one edit away from words of one length that the bitmap has in all probed places."""
    for change, cols, h, there in neighbourhood(m, alphabet):
        length = m.shape[1] + change
        has = lambda x, k, length=length: (table[(p := _place(x, length, k, bits)) >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        word, at, a = np.nonzero(has(h, 0) & there)
        for k in range(1, PROBES):
            left = has(h[word, at, a], k)
            word, at, a = word[left], at[left], a[left]
        if len(word):
            yield word, _strings(_edited(m[word], change, cols[at], alphabet[a]))


def candidates(words: DataFrame, alphabet: np.ndarray, bits: int, table: np.ndarray) -> DataFrame:
    """(word, near): the strings one edit away from each word, as far as the bitmap lets them through."""
    sent = words.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for rows, m in _by_length(column):
                for word, near in _let_through(m, alphabet, bits, sent.value):
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(rows[word])).cast(pa.string()), near], ["word", "near"])

    return words.select("word").mapInArrow(emit, "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the end of its chain of forms, found by doubling."""
    links = stage(forms.where("form is not null").select("word", F.col("form").alias("up"), F.lit(True).alias("moved")), "forms")
    while links.where("moved").limit(1).count():
        on = links.select(F.col("word").alias("up"), F.col("up").alias("further"))
        after = stage(links.join(on, "up", "left").select("word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "forms")
        drop_staged(links)
        links = after
    return links.select("word", F.col("up").alias("root"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    form: the most frequent of the words one edit away (ties: the smallest), if it is at least twice
    as frequent; root: the last of the chain of forms, the word itself where it has none.
    """
    words = stage(word_counts(docs, doc_id, text), "vocabulary")
    letters = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # at most 90 letters
    alphabet = np.array(sorted(ord(r.c) for r in letters if r.c), np.uint8)
    bits, table = bitmap(words, words.count())
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = candidates(words, alphabet, bits, table).join(known, "near")
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    often = -F.col("best.less") >= 2 * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("best.less")).alias("form_n")
    )
    forms = stage(forms, "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB: the crc32 byte by byte; neighbours by equal strings after a deletion or with one letter covered.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i::UBIGINT AS i, 0 AS k, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(list_reduce(
    flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::UBIGINT] ELSE [195::UBIGINT, (unicode(ch) - 64)::UBIGINT] END)),
    lambda s, b: xor(t[(xor(s, b) & 255)::BIGINT + 1], s >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM runs, crc
), made AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT DISTINCT word, other, m FROM (
    SELECT c.word, v.word AS other, v.n AS m FROM cuts c JOIN words v ON v.word = c.a || c.b
    UNION ALL SELECT v.word, c.word, c.n FROM cuts c JOIN words v ON v.word = c.a || c.b
    UNION ALL SELECT c.word, d.word, d.n FROM cuts c JOIN cuts d ON c.a || '*' || c.b = d.a || '*' || d.b AND c.word <> d.word)
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word
), near AS (
  SELECT b.word, b.n_near, b.m, min(p.other) AS other FROM best b JOIN pairs p ON p.word = b.word AND p.m = b.m GROUP BY ALL
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN near USING (word)
), chains AS (
  SELECT word, word AS root, 0 AS d FROM forms
  UNION ALL SELECT c.word, f.form, d + 1 FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, d) AS root FROM chains GROUP BY word) USING (word)
"""
