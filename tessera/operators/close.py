"""Words spelt much like others, for many words at once: an index of letter pairs proposes them, the ratio of shared characters decides."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(w: Column) -> Column:
    """The letter pairs of a word with their number among equal ones."""
    n = F.length(w)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    return F.transform(grams, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(grams, F.lit(1), i), lambda o: o == g)).alias("k")))


def shared_at_least(a: Column, b: Column, cutoff: float) -> Column:
    """So many letter pairs are shared by words of lengths a and b whose ratio reaches the cutoff: what is left unmatched breaks two pairs each at most."""
    unmatched = F.floor((1 - cutoff) * (a + b) + 1e-9)
    # an even number where the lengths' sum is even, an odd one where it is odd
    unmatched = unmatched - F.pmod(unmatched + a + b, F.lit(2))
    return F.greatest(a, b) - 1 - 2 * unmatched


def close_pairs(terms: DataFrame, words: DataFrame, cutoff: float = 0.82) -> DataFrame:
    """(term, w, ratio) of all terms (term) and words (w) that share a ratio of at least `cutoff` of their characters, as difflib counts them; both upper-cased before.

    Only words of a fitting length can do so, and only those that share one of the term's rarest
    letter pairs: as many as it has beyond the number that must be shared, and one. So frequent pairs
    of letters join nothing. Cutoffs must be beyond 0.8: below, short words need share no pair.
    """
    if cutoff <= 0.8:
        raise ValueError("cutoff must be beyond 0.8")
    low, high = cutoff / (2 - cutoff), (2 - cutoff) / cutoff
    own = words.select("w").where("w <> ''").distinct()
    asked = terms.select(F.col("term").alias("w")).where("w <> ''").distinct()
    often = own.select(F.explode(_pairs(F.col("w"))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df: DataFrame) -> DataFrame:
        n = F.length("w")
        # the fewest pairs that any fitting partner must share
        least = F.array_min(F.transform(F.sequence(F.ceil(n * low).cast("int"), F.floor(n * high).cast("int")), lambda m: shared_at_least(n, m, cutoff)))
        each = df.select("w", F.explode(_pairs(F.col("w"))).alias("p"), F.greatest(least, F.lit(1)).alias("least"), F.greatest(n - 1, F.lit(1)).alias("all"))
        order = Window.partitionBy("w").orderBy(F.coalesce("n", F.lit(0)), "p")
        ranked = each.join(often, "p", "left").withColumn("rn", F.row_number().over(order))
        return ranked.where(F.col("rn") <= F.col("all") - F.col("least") + 1).select("w", "p")

    x, y = rarest(asked).select(F.col("w").alias("term"), "p"), rarest(own)
    fits = F.length("w").between(F.ceil(F.length("term") * low - 1e-9), F.floor(F.length("term") * high + 1e-9))
    met = x.join(y, "p").where(fits).select("term", "w").distinct()

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for term, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                matcher = SequenceMatcher(None, w, term)
                if matcher.quick_ratio() >= cutoff and (r := matcher.ratio()) >= cutoff:
                    found.append((term, w, r))
            t, w, r = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(w, pa.string()), pa.array(r, pa.float64())], ["term", "w", "ratio"])

    return met.mapInArrow(ratio, "term string, w string, ratio double")


def closest(pairs: DataFrame, most: int = 4) -> DataFrame:
    """The most alike words of each term, of equal ones the last by name, with rank."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("ratio"), F.desc("w")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)
