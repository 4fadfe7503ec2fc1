"""Operator 12 against plain Python: every fingerprint, and components by comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.queries import op12_simhash_near_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, fp string, shard int, home int, root long"


def fingerprint(text, width=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, radius=2):
    """The smallest id that links reach, for each fingerprint."""
    v, up = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[:i]) <= radius).tolist():
            up[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(v))]


def want(rows):
    fps = [fingerprint(t) for _, t in rows]
    return order((d, f"{fp:016x}", c) for (d, _), fp, c in zip(rows, fps, components(fps, [d for d, _ in rows]), strict=True))


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_xxh64():
    rng = np.random.default_rng(2)
    for length in [*range(0, 75), 96, 201]:
        m = rng.integers(0, 256, (4, length), dtype=np.uint8)
        assert simhash.xxh64(m).tolist() == [xxhash.xxh64_intdigest(r.tobytes(), 42) for r in m]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    got = order(op12_simhash_near_dedup(spark, f"/root/testdata/{sf}").collect())
    assert got == want([tuple(r) for r in docs.collect()])


def clouds(seed, n):
    """Fingerprints in clouds of a few differing bits, between clouds one bit further, and alone."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = r.choice([*centres, *list(out)[:50], r.getrandbits(64)])
        for b in r.sample(range(64), r.randint(0, 4)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("sizes", [dict(sample=50, shard=16, large=40), dict(sample=1, shard=1, large=60), dict(sample=400, shard=8, large=1 << 15), dict()])
def test_no_link_is_lost_between_shards(spark, sizes):
    for radius in (0, 2, 5):
        fps = clouds(radius, 700)
        classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, 0) for x in fps], "fp long, least long")
        ties = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.linked(classes, radius, **sizes).collect()]
        whole = components(fps, range(len(fps)), radius)
        at = {x: i for i, x in enumerate(fps)}
        up = list(range(len(fps)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in ties:
            assert whole[at[a]] == whole[at[b]]
            up[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
        assert [find(i) for i in range(len(fps))] == whole


def test_every_class_lives_in_one_shard(spark):
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, 0) for x in clouds(9, 500)], "fp long, least long")
    rows = simhash.shard_rows(classes, 2, sample=100, shard=16, large=20)
    assert rows.where("home").count() == rows.where("home").select("fp").distinct().count() == 500
    assert rows.groupBy("shard").agg({"home": "count"}).count() > 8


def test_blocks_in_memory():
    fps = np.array(clouds(4, 3000), np.uint64)
    home, guest = np.arange(2000), np.arange(2000, 3000)
    roots = simhash.Roots(3000)
    simhash.tie_linked(fps, home, guest, 2, roots)
    got = roots.of(np.arange(3000))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :2000]) <= 2
    assert all((got[i] == got[np.flatnonzero(near[i])]).all() for i in range(3000))
    whole = components(fps.tolist(), range(3000))
    assert all(whole[i] == whole[got[i]] for i in range(3000))


def test_odd_rows(spark):
    text = " ".join(f"w{i % 97}x{i % 89}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e f g"), (7, "A b\tC  d e\nf g"), (7, "a b c d e f g"), (None, None), (8, "one"), (9, "one two"), (10, text), (11, text + " tail"), (12, "É é"), (13, "é é")]
    docs = spark.createDataFrame([(d, t, "f", 1, 2, 3) for d, t in rows], SCHEMA)
    assert order(simhash.simhash_components(docs).collect()) == want(rows)
    alone = docs.where("doc_id is null and text is not null")
    assert [tuple(r) for r in simhash.simhash_components(alone).collect()] == [(None, f"{fingerprint('a b c d e f g'):016x}", None)]
    assert simhash.simhash_components(docs.limit(0)).collect() == []
