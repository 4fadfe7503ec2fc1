"""Mixing sources to target weights by hash-threshold histograms (operator 8).

Words are summed by source and hash bucket. Where a source needs part of its words once more, the
largest hash threshold whose documents stay within that budget is found from the histogram: whole
buckets below the boundary bucket count as they are, and only the boundary bucket is split into
finer buckets, twice. Documents are then filtered by comparing their hash with the threshold: no
sort, and a larger budget takes a superset.

Nulls: a null text has size 0, a null source is a source of its own (last in order). Rows that
agree in doc_id and text have a hash each, by their number among equal ones, so that some of them
can be taken once more and others not. Where one document fewer and one more are equally far from a
budget, the larger choice counts. Empty tables give no rows. Documents of
size 0 are listed with taken 0; mixed() takes or repeats them as their hash says, like the others.
Very long texts only count more words. Columns other than doc_id, text and source pass through
mixed() whatever their names; mix() returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage

#: Bits of the hash that each refinement looks at; the last level compares whole hashes.
BITS = (12, 12)
#: A source gives at most so many times its words.
MOST = 3
#: Equal rows that one task numbers.
EQUAL = 4096


def words(text: Column) -> Column:
    """The number of words of a whole text."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "a"), f"[{SPACE}]+", "")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of the whole text, and the hash that orders the documents of a source."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))


def numbered(sized: DataFrame) -> DataFrame:
    """sized with a hash of their own for rows that are equal: they are counted, and their numbers, from 0, go into it; many equal ones are numbered in several tasks."""
    groups = sized.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("c"))
    parts = groups.where("c > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(EQUAL).cast("long"))).alias("lo")).repartition("h", "lo")
    each = parts.select("*", F.explode(F.sequence("lo", F.least(F.col("lo") + EQUAL, F.col("c")) - 1)).alias("i"))
    again = each.withColumn("h", F.when(F.col("i") == 0, F.col("h")).otherwise(F.xxhash64("h", "i")))
    return groups.where("c = 1").select(*sized.columns).unionByName(again.select(*sized.columns))


def own_hash(docs: DataFrame) -> DataFrame:
    """docs (with doc_id and text) with h, that of sizes; of rows that are equal in them each in a task has another."""
    first = docs.withColumns({"h": F.xxhash64("doc_id", "text"), "_p": F.spark_partition_id()})
    twice = stage(first.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "equal")
    if twice.limit(1).count() == 0:
        return first.drop("_p")
    many = first.join(twice, "h", "left_semi").withColumn("_i", F.row_number().over(Window.partitionBy("h", "_p").orderBy(F.xxhash64(*docs.columns))))
    told = many.withColumn("h", F.xxhash64("h", "_p", "_i"))
    names = [*docs.columns, "h"]
    return first.join(twice, "h", "left_anti").select(*names).unionByName(told.select(*names))


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with the sums over all rows before them in order, without bringing them into one task: a row for each partition is summed up, then each partition by itself."""
    placed = stage(rows.withColumns({f"_{n}": c for n, c in sums.items()}).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_p", F.shiftright("_at", 33))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_p").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    parts = parts.select("_p", *(F.coalesce(F.sum(f"_{n}").over(before(Window.orderBy("_p"))), F.lit(0)).alias(f"_p{n}") for n in sums))
    own = before(Window.partitionBy("_p").orderBy("_at"))
    return placed.join(parts, "_p").select(*rows.columns, *((F.col(f"_p{n}") + F.coalesce(F.sum(f"_{n}").over(own), F.lit(0))).alias(n) for n in sums))


def targets(per_source: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """per_source (source, source_size) with its target: weights in turn by order, the words that a source can't give shared among the others by weight.

    Sources stop in order of size over weight. Each has, from the sums over those before it, the rate
    that holds if exactly those have stopped; the first that doesn't stop at its own rate has the
    final one.
    """
    ranked = running(per_source, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    full = F.col("source_size").cast("double") * most
    summed = stage(running(ranked, [full / F.col("w"), F.col("rank")], stopped_size=full, stopped_w=F.col("w")), "ranked")
    all_ = summed.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    own = (F.lit(float(all_["size"] or 0)) - F.col("stopped_size")) / (F.lit(float(all_["w"] or 0)) - F.col("stopped_w"))
    rate = summed.select(own.alias("rate"), (full / F.col("w")).alias("limit"), "stopped_size", "stopped_w").where("limit >= rate").agg(F.min_by("rate", F.struct("limit", "stopped_w"))).first()[0]
    return summed.select("source", "source_size", full.alias("_full"), "w").select(
        "source", "source_size", (F.least("_full", F.col("w") * F.lit(rate)) if rate is not None else F.col("_full")).alias("target")
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, upto): documents whose hash, as unsigned, is at most upto hold budgets.extra words of their source as nearly as whole documents can; null takes none.

    budgets: (source, extra), extra below the source's size.
    """
    level = sized.select("source", "size", F.expr("h ^ -9223372036854775808").alias("u"))  # signed order of u is unsigned order of h
    open_ = budgets.select("source", F.col("extra").cast("double").alias("left"))
    best = None
    shift = 64
    for bits in (*BITS, None):
        shift = shift - bits if bits else 0
        bucket = F.shiftright("u", shift) if shift else F.col("u")
        sums = level.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.sum("n").over(upto)).join(open_, sums["source"].eqNullSafe(open_["source"])).drop(open_["source"])
        if bits:
            edge = run.where("upto > left").groupBy("source").agg(F.min_by(F.struct("b", (F.col("left") - F.col("upto") + F.col("n")).alias("left")), "b").alias("e"))
            edge = stage(edge.select("source", F.col("e.b").alias("b"), F.col("e.left").alias("left")), "edge")
            level = stage(
                level.join(edge.select(F.col("source").alias("_s"), F.col("b").alias("_b")), F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_b")), "left_semi"),
                "boundary",
            )
            open_ = edge.select("source", "left")
            floor = F.shiftleft("b", shift) - 1  # all below the boundary bucket is taken; of the last bucket nothing yet
            low = edge.select("source", F.when(F.col("b") > F.lit(-(1 << (63 - shift))), floor).alias("low"))
            best = low
        else:
            last = run.where("upto - left <= left - (upto - n)").groupBy("source").agg(F.max("b").alias("b"))
            best = best.join(last.select(F.col("source").alias("_s"), "b"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", F.coalesce("b", "low").alias("upto")
            )
    return best


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """(source, source_size, target, whole, upto): every document of a source is taken `whole` times, those with a hash up to `upto` once more."""
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = stage(plan.select("*", F.least(F.floor(share + 1e-12), F.lit(most)).cast("long").alias("whole")), "plan")
    budgets = plan.select("source", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)).alias("extra"))
    cut = thresholds(sized, budgets).select(F.col("source").alias("_s"), "upto")
    return stage(plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mixplan")


def apply_mix(rows: DataFrame, plan: DataFrame, most: int = MOST) -> DataFrame:
    """rows (with source and h) with the plan of their source and copies: how often the mix takes each."""
    copies = F.least(F.col("whole") + F.when(F.expr("h ^ -9223372036854775808") <= F.col("upto"), 1).otherwise(0), F.lit(most))
    return rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("copies", copies)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document, and its words times that."""
    sized = stage(numbered(sizes(docs)), "sizes")
    return apply_mix(sized, plan_mix(sized, weights, most), most).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "h"
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """docs as often as the mix takes them, in docs' columns."""
    named = own_hash(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", "source"))
    sized = stage(named.select("source", words(F.col("text")).alias("size"), "h"), "sizes")
    plan = plan_mix(sized, weights, most)
    return apply_mix(named.drop("doc_id", "text"), plan, most).select(F.explode(F.array_repeat("_doc", F.col("copies").cast("int"))).alias("_doc")).select("_doc.*")
