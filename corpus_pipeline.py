"""The corpus pipeline: five operators of tessera.llm in turn, each stage written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, langid, mixing, packing, pii
from tessera.llm.common import in_training, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest centroids don't reject; where no row has a language to learn from, all.

    Null texts and those without a letter are rejected; rows with a null lang only aren't learned
    from. Repeated rows get the same answer, long texts are read whole, equal cosines go to the first
    language. Columns of any name pass through; an empty table gives an empty one.
    """
    model = langid.fit(docs.where(in_training(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if not model.langs:
        return docs
    names = [c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)]  # a text goes to Python and back once
    return langid.identify(docs.toDF(*names), model).where(~F.col("rejected")).select(*names).toDF(*docs.columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Null and empty texts link with nothing and stay, but for rows that repeat. Of a group one row
    stays: that of the smallest doc_id, of several such rows one; null ids are never the smallest.
    Columns of any name pass through; an empty table gives an empty one.
    """
    return jaccard_join.one_of_each(docs, width=5, similarity=(80, 100))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text.

    Null texts stay null, texts without a span as they are, n_chars too. Overlapping spans go
    together, under the first one's kind. Repeated rows are read each for itself; long texts are read
    whole; columns of any name pass through; an empty table gives an empty one.
    """
    out = pii.redact(pii.find_pii(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null texts have no words, a null source is a source of its own. Equal rows are taken one by one;
    where one more and one fewer are equally far from a budget, one more. Columns of any name pass
    through; an empty table gives an empty one.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens.

    Null and empty texts are one piece of the closing id. Repeated rows are packed each for itself;
    only texts of more than 4096 tokens are cut. Documents of one length take the places planned for
    it in any order. Other columns go; an empty table gives an empty one.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids_crc32=F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", jaccard),
    ("pii", redact_pii),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Centroids, trees, hashes and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
