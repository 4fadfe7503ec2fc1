"""Operators 8 and 10 against plain Python."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix
from tessera.llm.queries import op8_source_mixing, op10_quality_rules
from tessera.llm.quality_rules import quality_verdicts

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = {i + d for i, t in enumerate(tri) if n[t] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def by_hand(sizes):
    """Targets by repeated resharing; sizes: {source: size}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rate = (total - sum(3 * sizes[s] for s in capped)) / (sum(w[s] for s in free) or 1)
        over = {s for s in free if rate * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else rate * w[s] for s in order}
        capped |= over


def odd_rows():
    rep = "a b c d\nx y z\na b c d\n" * 30
    return [(1, None, "en", "a", "q"), (2, "", None, None, None), (3, rep, "en", "b", None), (3, rep, "en", "b", None), (None, "  \t one\x0btwo \n ", None, "a", None),
            (5, "é ü | $$ x😀 " * 40, "de", "a", None), (6, "ab cd ef " * 5000 + "tail", "en", "a", None), (7, "a a a a", "en", "Ω", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_measures_whole_table(spark, docs):
    got = {r.doc_id: r for r in op10_quality_rules(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        m = measured(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.kept and r.base_failed)
    assert sum(r.kept for r in got.values()) > 0.5 * len(got)


def test_measures_odd_rows(spark):
    rows = odd_rows()
    out = quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(measured(r[1]) for r in rows)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    assert quality_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_measures_of_equal_rows_and_clashing_names(spark):
    """Ties: values at a fence are kept, equal rows get equal verdicts; columns named like ours give way."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(80)), "en", "a", "x") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA).withColumns({"kept": F.lit("mine"), "n_words": F.lit(-1)})
    out = quality_verdicts(df, min_group=50).collect()
    assert len(out) == 305 and {r.n_words for r in out} == {80} and {type(r.kept) for r in out} == {bool}
    assert all(r.kept for r in out)  # all measures tie, so that every fence lies on them
    assert len({(r.doc_id, r.kept) for r in out}) == 300


def test_mixing_whole_table(spark, docs):
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    total = collections.Counter()
    for d in docs:
        total[d.source] += size[d.doc_id]
    want = by_hand(dict(total))
    source = {d.doc_id: d.source for d in docs}
    out = op8_source_mixing(spark, SF).collect()
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s])
        assert r.target == pytest.approx(want[s])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert sorted(map(tuple, out)) == sorted(map(tuple, op8_source_mixing(spark, SF).collect()))


def test_mixing_odd_rows(spark):
    out = mix(spark.createDataFrame(odd_rows(), SCHEMA)).collect()
    assert len(out) == len(odd_rows())
    assert all(r.taken <= 3 * r["size"] for r in out)
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.taken for r in mix(spark.createDataFrame([(1, None, "en", None, None)], SCHEMA)).collect()} == {0}


def test_mixing_budgets_nest(spark):
    from tessera.llm.mixing import sizes, thresholds

    rows = [(i, "w " * (i % 7 + 1), "en", "s" if i % 3 else None, None) for i in range(600)]
    sized = sizes(spark.createDataFrame(rows, SCHEMA)).cache()
    before = set()
    for extra in (0.0, 1.0, 40.0, 41.0, 300.0, 790.0):
        budgets = spark.createDataFrame([("s", extra), (None, extra)], "source string, extra double")
        cut = {r.source: r.upto for r in thresholds(sized, budgets).collect()}
        picked = [r for r in sized.collect() if cut.get(r.source) is not None and (r.h ^ -(1 << 63)) <= cut[r.source]]
        for s in ("s", None):
            assert abs(sum(r["size"] for r in picked if r.source == s) - extra) <= 3.5
        assert before <= (now := {r.doc_id for r in picked})
        before = now


def test_mixing_equal_rows(spark):
    """Equal rows are taken one by one: a source of copies comes as near its target as any."""
    from tessera.llm.mixing import mixed

    rows = [(7, "w " * 10, "en", "a", None)] * 100 + [(i, "w " * 10, "en", "b", None) for i in range(100, 160)] + [(1, "x y", "en", "c", None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = mix(docs).collect()
    want = by_hand({"a": 1000, "b": 600, "c": 6})
    assert len(out) == len(rows)
    for s, near in (("a", 5), ("b", 5), ("c", 1)):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= near, s
        assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in mine)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix(docs).collect()))
    whole = collections.Counter(r.source for r in mixed(docs.withColumn("h", F.lit(1)).withColumn("copies", F.lit("x"))).collect())
    assert abs(10 * whole["a"] - want["a"]) <= 5 and abs(10 * whole["b"] - want["b"]) <= 5 and abs(2 * whole["c"] - want["c"]) <= 1


def test_mixing_ties(spark):
    """Half a document is as near as none: the larger choice counts, here and wherever a budget ends."""
    from tessera.llm.mixing import sizes, thresholds

    sized = sizes(spark.createDataFrame([(i, "w " * 4, "en", "s", None) for i in range(40)], SCHEMA)).cache()
    for extra in (2.0, 6.0, 78.0):
        upto = thresholds(sized, spark.createDataFrame([("s", extra)], "source string, extra double")).first().upto
        assert sum(4 for r in sized.collect() if (r.h ^ -(1 << 63)) <= upto) == extra + 2
