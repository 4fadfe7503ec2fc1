"""Operator 13 against plain Python; tests/test_oracle.py holds its query against DuckDB."""

import math
import random

import numpy as np
import pytest

from tessera.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, row long, at int, part string, error double"


def plain(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, label, code, error, label_error)] and the codebooks, loop by loop, over rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * c) for c in v], lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 1 << 17 for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, at, strict=True) if k == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, by = [], {}
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by[lab] = by.get(lab, 0) + error
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), error))
    return sorted(((*r, by[r[1]]) for r in out), key=repr), books


def check(spark, rows, **how):
    vectors = spark.createDataFrame([(*r, 1, 2, "p", 0.5) for r in rows], SCHEMA)
    coded, books = vector_codes.compress(vectors, **how)
    want, want_books = plain(rows, **how)
    assert books.tolist() == want_books
    assert sorted((tuple(r) for r in coded.select("vec_id", "label", "code", "error", "label_error").collect()), key=repr) == want
    return want


def test_rounds_ties_and_floors(spark):
    r = random.Random(1)
    rows = [(i, [r.choice((-1.5, -0.001, 0.0, 0.25, 0.0009, 2.0)) for _ in range(8)], r.choice((None, 1, 2))) for i in range(300)]
    check(spark, rows, entries=5)
    check(spark, rows, entries=256)
    check(spark, rows, entries=3, parts=2, rounds=1)


def test_odd_rows(spark):
    v = [0.5, -0.25, 0.125, 1.0, 2.0, -3.0, 0.0, 0.75, 9.0]  # nine components: the last part is filled up
    rows = [(3, v, 1), (3, v, 1), (3, v[::-1], 1), (None, v, None), (None, [0.0] * 9, None), (1, None, 1), (2, [], 1), (4, [None] * 9, 1), (5, [math.nan] * 9, 1), (6, [math.inf] + v[1:], 1), (7, [1e30] * 9, 1), (8, v[:8], 1), (9, [-x for x in v], 2)]
    assert len(check(spark, rows)) == 6
    check(spark, rows, entries=2)
    vectors = spark.createDataFrame([(1, None, 1, 1, 2, "p", 0.5)], SCHEMA)
    for none in (vectors, vectors.limit(0)):
        assert vector_codes.compress(none)[0].collect() == []


def test_most_rows_alike(spark):
    check(spark, [(i, [0.0] * 8 if i % 3 else [i / 7.0] * 8, i % 2) for i in range(400)], entries=16)


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 27])
def test_distances_are_exact(size):
    rng = np.random.default_rng(size)
    rows, book = rng.integers(-size, size, (200, 7)), rng.integers(-size, size, (40, 7))
    book[9] = book[3]
    d = ((rows[:, None, :].astype(object) - book.astype(object)) ** 2).sum(axis=2)
    code, error = vector_codes.assign(rows, book)
    assert code.tolist() == [min(range(40), key=lambda k, r=r: (r[k], k)) for r in d.tolist()] and error.tolist() == d.min(axis=1).tolist()
