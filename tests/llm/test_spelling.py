"""Operator 11 against plain Python; tests/test_oracle.py holds its query against DuckDB."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, near long, form string"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def plain(rows):
    """{word: (form, root, n, n_near, form_n)} by comparing all words."""
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: (k := h % len(run))] + run[k + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    forms = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    forms = {w: v for w, v in forms.items() if words[v] >= 2 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None)
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(spelling.variants(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_ties_and_letters_beyond_ascii(spark):
    # a chain of forms, two forms of equal frequency, letters doubled and beyond ASCII, case kept beyond A-Z
    words = {"alpha": 5, "alphas": 12, "alphass": 30, "alphasss": 80, "straße": 5, "strase": 14, "strace": 14, "strate": 14, "naïve": 20, "naive": 5, "NAÏVE": 4, "aaaaa": 3, "aaaaaa": 9, "aaaaaaa": 20, "÷÷÷÷÷": 5}
    rows = [(i, w) for w, n in words.items() for i in range(n)]
    random.Random(3).shuffle(rows)
    rows = [(k, " ".join(w for _, w in rows[lo : lo + 7])) for k, lo in enumerate(range(0, len(rows), 7))]
    docs = spark.createDataFrame([(d, t, "w", 1, 2, "f") for d, t in rows], SCHEMA)
    got = found(spelling.variants(docs))
    assert got == plain(rows) and got["alpha"][:2] == ("alphas", "alphasss")
    most = max(got[w][2] for w in ("strase", "strace", "strate"))  # slips may have taken some
    assert got["straße"][0] == min(w for w in ("strase", "strace", "strate") if got[w][2] == most)


def test_slips_are_made(spark):
    rows = [(d, "gardens window") for d in range(2000)]
    docs = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA)
    got = found(spelling.variants(docs))
    assert got == plain(rows) and got["gardens"][2] < 2000 and len(got) > 4


def test_odd_rows(spark):
    long = "x" * 3000
    rows = [(1, None), (2, ""), (None, "seven seven"), (None, "seven sevens"), (3, f"{long} {long} {long} {long[1:]}y {long[1:]}y {long[1:]}y"), (4, "sevens sevens " * 3), (4, "sevens sevens " * 3), (5, "one 2 ,.;")]
    docs = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA)
    got = found(spelling.variants(docs))
    assert got == plain(rows) and len(got) >= 3
    for empty in (docs.limit(0), docs.where("text is null"), docs.where("doc_id = 5")):
        assert spelling.variants(empty).collect() == []


def test_long_texts_in_pieces():
    text = np.frombuffer(" ".join(["abcdefgh", "éèàüöçñ", "q" * 50, "12 34"] * 40).encode(), np.uint8)
    for limit in (1, 7, 64, 1000):
        parts = list(spelling._pieces(text, limit))
        assert b"".join(p.tobytes() for p in parts) == text.tobytes()
        assert LETTERS.findall(text.tobytes().decode()) == [w for p in parts for w in LETTERS.findall(p.tobytes().decode())]


def test_every_edit_once():
    words = ["banana", "aaa", "zéro", "a"]
    alphabet = sorted(set("".join(words)))
    codes = np.array([ord(c) for c in alphabet], np.uint8)
    everything = np.full((1 << 20) // 8, 255, np.uint8)
    for w in words:
        (_, m), = spelling._by_length(pa.array([w]))
        made = [s for _, near in spelling._let_through(m, codes, 20, everything) for s in near.to_pylist()]
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        other = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} - {w}
        more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        assert collections.Counter(made) == collections.Counter(cut | other | more)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "garden gardens wardens warden " * 4)], "doc_id long, text string")
    want = found(spelling.variants(docs))
    monkeypatch.setattr(spelling, "bitmap", lambda words, n: (20, np.full((1 << 20) // 8, 255, np.uint8)))
    assert found(spelling.variants(docs)) == want and want["garden"][3] == 2


def test_crc32():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts = rng.integers(0, 3000, 200)
    sizes = rng.integers(0, 200, 200)
    state = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    want = [zlib.crc32(data[s : s + n].tobytes(), int(x)) for s, n, x in zip(starts, sizes, state, strict=True)]
    assert spelling.crc32_of(data, starts, sizes, state).tolist() == want
