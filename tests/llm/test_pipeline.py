"""The stages of the pipeline, each on its own input."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_jaccard_join import brute  # noqa: E402
from tests.llm.test_pii import PLAIN, good  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected int"


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, step in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.collect()} if "text" in docs.columns else set()
        docs = step(spark, docs, SF).cache()
        seen.append(docs.count())
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name in ("language_id", "ngram_jaccard_join"):
            assert set(after) <= before and len(after) > 0.6 * len(before)
        if name == "ngram_jaccard_join":
            assert all(n == 1 for n in collections.Counter(c for _, k, c in brute(after, 5, 80, 100)).values())
            assert {c for _, _, c in brute(sorted(before), 5, 80, 100)} == {d for d, _ in after}
        if name == "pii":
            import re

            assert not any(good(k, m[0]) for _, t in after for k, p in PLAIN.items() for m in re.finditer(p, t))
        if name == "source_mixing":
            assert set(after) <= before and max(collections.Counter(after).values()) <= 3
    assert seen[0] >= 190 and corpus_pipeline.run(spark, SF).count() == seen[-1]


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, 1.0, 1), (None, "the same few words here again", "en", "a", 3, None, 0), (None, "the same few words here again", "en", "a", 3, None, 0),
            (2, "the same few words here again", "en", "a", 3, None, 0), (3, "", "en", "b", 0, None, 0), (4, "x " * 9000, "en", None, 1, None, 0), (4, "call +1 (269) 555-3296 now", None, "b", 1, None, 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for name, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SF)
            if name == "ngram_jaccard_join" and data:
                assert sum(r.text == "the same few words here again" for r in docs.collect()) == 1
        assert (docs.count() > 0) == bool(data)


def test_memory_of_workers(spark):
    import itertools
    import tracemalloc

    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from tessera.llm import langid, packing

    # texts whose counts are held at a time take a few MB, not tens of them
    sample = {"en": np.array([langid.counts("a few words of text")], np.float32), "de": np.array([langid.counts("ein paar Worte")], np.float32)}
    model = langid.Centroids(np.ones(langid.WIDTH), sample, 4, 0.5)
    inside: dict = {}

    class Docs:
        columns, schema = ["text"], []

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            inside["f"] = f

    langid.identify(Docs(), model)
    batch = pa.RecordBatch.from_arrays([pa.array([f"a few words of text {chr(97 + i % 26)}" for i in range(1000)])], ["text"])
    list(inside["f"]([batch.slice(0, 1)]))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in inside["f"]([batch])) == 1000
        assert tracemalloc.get_traced_memory()[1] < 20_000_000
    finally:
        tracemalloc.stop()
    # ids of a bounded number of words are kept
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    every = map("".join, itertools.product("abcdefghij", repeat=6))
    for _ in range(15):
        words.encode(" ".join(itertools.islice(every, 10_000)))
    assert 0 < len(words.known) <= 120_000


def test_language_id_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang", "text", "source as `a.b`", "n_chars as `_0`", "0.5D as cosine")
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.schema.simpleString() == docs.schema.simpleString() and out.count() > 100
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
