"""Operator 7 against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.jaccard_join import Bounds, Leaders, Region, jaccard_components
from tessera.llm.queries import op7_ngram_jaccard_join

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, k int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, width):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, width, num, den):
    """(n, component) of each row, by comparing all pairs that share a shingle."""
    sets = [shingle_set(t, width) for _, t in rows]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in list(s)[: len(s) - len(s) * num // den + 1] for j in by[x] if j != i}:
            if (j, i) not in seen:
                seen.add((i, j))
                inter = len(s & sets[j])
                if den * inter >= num * len(s | sets[j]):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = op7_ngram_jaccard_join(spark, f"/root/testdata/{sf}").collect()
    assert order(got) == order(brute(docs, 3, 90, 100))


def families(seed, n, base_words, edits):
    """Texts in families: each a base text with some words replaced, at distances on both sides of the limit."""
    rng = random.Random(seed)
    texts = []
    for f in range(n):
        words = [f"f{f}w{rng.randrange(10**6)}" for _ in range(base_words)]
        for _ in range(rng.randrange(1, 30)):
            w = list(words)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(w))
            if rng.random() < 0.3:
                words = w  # chains
            if rng.random() < 0.2:
                texts.append(" ".join(w).upper())
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot, task_bytes, width, similarity", [(20_000, 1 << 24, 3, (90, 100)), (3, 20_000, 3, (90, 100)), (5, 4_000, 5, (80, 100))])
def test_families(spark, hot, task_bytes, width, similarity):
    rows = families(hot, 12, 120, 9) + [(10**6 + i, t) for i, t in families(hot + 1, 6, 14, 3)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(3)
    got = jaccard_components(df, width, similarity, hot=hot, task_bytes=task_bytes).select("doc_id", "n_shingles", "component_id").collect()
    assert order(got) == order(brute(rows, width, *similarity))


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "One", "two words", "Two\x0bwords", "a b c", "a  b\tc", "a b c d", "É f g", "é f g", "x " * 30_000, "x " * 29_999, "q", None]
    rows = [*enumerate(texts), (None, "only here"), (None, "a b c"), (3, "one"), (7, "z z z z")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(2)
    got = jaccard_components(df, 3, (90, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert order(got) == order(brute(rows, 3, 90, 100))
    assert jaccard_components(df.where("false"), 3, (90, 100)).count() == 0


def test_leaders_lose_no_link():
    rng = np.random.default_rng(3)
    bounds = Bounds(80, 100)
    base = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(6)]
    sets = []
    for i in range(900):
        s = base[i % 6].copy()
        s[rng.choice(100, rng.integers(0, 25), replace=False)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
        sets.append(np.unique(s))
    from tessera.llm.jaccard_join import _cells

    edges, state = [], Leaders(bounds)
    for lo in range(0, 900, 128):
        part = sets[lo : lo + 128]
        state.add([lo + i for i in range(len(part))], np.array([len(x) for x in part]), np.stack([_cells(x) for x in part]), edges)
    root = {i: i for i in range(900)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    for i in range(0, 900, 7):
        for j in range(900):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                assert find(i) == find(j)
    assert len(edges) < 3 * 900
    exact = Region(sets[:300], bounds).join()
    assert len(exact) < 300


@pytest.mark.parametrize("radii, most", [(((6, None), (1 << 60, 1e9)), 2048), (((1 << 60, None),), 3), (((1 << 60, None),), 2048)])
def test_salted_leaders_lose_no_link(spark, radii, most):
    """Links across salts where a leader captures everything, where there are too many leaders, and where neither holds."""
    from tessera.llm.jaccard_join import _cells, salted_edges

    class Few(Leaders):
        RADII = radii

    rng = np.random.default_rng(5)
    bounds = Bounds(90, 100)
    base = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) << np.uint64(1) for _ in range(12)]
    sets, salts = [], []
    for i in range(240):
        x = base[i % 12].copy()
        x[rng.choice(100, rng.integers(0, 4), replace=False)] = rng.integers(0, 1 << 63)
        sets.append(np.unique(x))
        salts.append(int(rng.integers(0, 3)))
    keys = rng.permutation(240).tolist()  # the order in which leaders are met has nothing to do with who leads
    edges, rows = [], []
    for salt in range(3):
        mine = [i for i in range(240) if salts[i] == salt]
        state = Few(bounds)
        state.add([keys[i] for i in mine], np.array([len(sets[i]) for i in mine]), np.stack([_cells(sets[i]) for i in mine]), edges)
        rows += [(1, k, n, c.astype(np.uint8).tobytes(), float(r)) for k, n, c, r in zip(state.k, state.n, state.cells, state.radius, strict=True)]
    leaders = spark.createDataFrame(rows, "s long, k long, n int, cells binary, radius double")
    across = [tuple(r) for r in salted_edges(leaders, bounds, most).collect()]
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges + across:
        root[find(a)] = find(b)
    linked = 0
    for i in range(240):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 90 * (len(sets[i]) + len(sets[j]) - inter):
                linked += salts[i] != salts[j]
                assert find(keys[i]) == find(keys[j])
    assert linked > 100
    assert most > 3 or len(across) <= 2 * len(rows)


def near_copies(seed, n, size, edits):
    """Sets of about `size` hashes, of several near copies each, and sets with nothing in common; all share one hash."""
    rng = np.random.default_rng(seed)
    sets = []
    while len(sets) < n:
        base = rng.integers(1, 1 << 64, int(size * rng.uniform(0.7, 1.4)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 6))):
            x = base.copy()
            x[rng.choice(len(x), int(rng.integers(0, edits)), replace=False)] = rng.integers(1, 1 << 64, dtype=np.uint64)
            sets.append(np.unique(np.append(x, np.uint64(0))))
    return [sets[i] for i in rng.permutation(n).tolist()]


def links(sets, bounds):
    """The pairs that link."""
    return [(i, j) for i, x in enumerate(sets) for j in range(i) if bounds.linked(len(set(x.tolist()) & set(sets[j].tolist())), len(x), len(sets[j]))]


@pytest.mark.parametrize("n, size, similarity", [(40, 300, (80, 100)), (180, 1500, (80, 100)), (180, 60, (90, 100)), (90, 900, (90, 100))])
def test_unrelated_sets_of_a_region_stay_apart(spark, n, size, similarity):
    """Long sets that share a shingle, in a region of more than eight classes, aren't tied together: that made components of everything that is long, whose disk grew with every level that they were cut in."""
    from tessera.llm.jaccard_join import _cells, loose_edges

    bounds = Bounds(*similarity)
    sets = near_copies(n, n, size, size // 8)
    rows = [(s, -1, i, len(x), bytearray(_cells(x, bounds.bits(len(x))).tobytes())) for s in (5, 9) for i, x in enumerate(sets)]
    rows += [rows[0], (7, -1, 0, len(sets[0]), rows[0][-1])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # regions reach over several batches
    try:
        edges = [tuple(r) for r in loose_edges(spark.createDataFrame(rows, "s long, salt int, id long, n int, cells binary"), bounds).where("a is not null").select("a", "b").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    assert all(find(i) == find(j) for i, j in links(sets, bounds))
    assert max(np.unique([find(i) for i in range(n)], return_counts=True)[1]) <= 5


def test_pairs_that_cannot_link_go(spark):
    """Short sets that met once in a small region, too: their cells tell."""
    from tessera.llm.jaccard_join import _cells, near_pairs

    bounds = Bounds(80, 100)
    sets = near_copies(1, 60, 30, 5) + near_copies(2, 20, 2000, 300)
    known = spark.createDataFrame([(i, len(x), bytearray(_cells(x, bounds.bits(len(x))).tobytes())) for i, x in enumerate(sets)], "id long, n int, cells binary")
    every = spark.createDataFrame([(j, i) for i in range(80) for j in range(i)], "a long, b long")
    kept = {tuple(r) for r in near_pairs(every, known, bounds).collect()}
    linked = {(j, i) for i, j in links(sets, bounds)}
    assert linked <= kept and len(kept) < 3 * len(linked)


def test_what_is_far_from_pivots_is_not_copied(spark):
    """Sets that no pivot is near to stay one region; each was copied to the regions of all 16 pivots, level by level."""
    from tessera.llm.jaccard_join import large_edges, voronoi

    bounds = Bounds(80, 100)
    sets = near_copies(3, 240, 120, 20)
    rows = spark.createDataFrame([("r", bytearray(i.to_bytes(4, "big")), bytearray(x.astype("<u8").tobytes())) for i, x in enumerate(sets)], "region string, k binary, set binary")
    assert len(sets) <= voronoi(rows, bounds).count() < 1.5 * len(sets)
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in large_edges(rows, bounds, 20_000).collect():
        root[find(int.from_bytes(r.a, "big"))] = find(int.from_bytes(r.b, "big"))
    want = list(range(240))
    for i, j in links(sets, bounds):
        a, b = want[i], want[j]
        want = [a if x == b else x for x in want]
    assert all((find(i) == find(j)) == (want[i] == want[j]) for i in range(240) for j in range(i))
