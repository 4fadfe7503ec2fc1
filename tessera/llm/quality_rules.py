"""Quality rules whose thresholds follow each language and source (operator 10), in DataFrame functions only.

Every text is measured once. Per language and source a mergeable quantile sketch of each measure is
kept: counts of logarithmic buckets (relative error GAMMA - 1), which add up in any order, so that
reruns agree. Fences above the upper quartile (for the mean word length also below the lower one)
replace fixed cutoffs; groups of fewer than `min_group` documents use their language's sketch, and
small languages the sketch of all documents, both merged from the same counts. Measures are then
joined with the fences.

Nulls: a null text counts as empty; null lang or source are groups of their own. Empty texts have
no words and fail. Repeated rows are measured each for itself. Ties with a fence are kept. Very long
texts are measured whole; windows of words are compared by a 64-bit hash. An empty table has no fences
and gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage

#: Bucket b of the sketch holds values in (GAMMA ** (b - 1), GAMMA ** b] * SMALLEST.
GAMMA, SMALLEST = 1.05, 1e-4
#: Measure: (margin under which a spread counts as so large, whether low values fail too).
MEASURES = {"symbol_ratio": (0.03, False), "dup_line_ratio": (0.10, False), "repeat_ratio": (0.12, False), "mean_word": (1.0, True)}


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of the whole text."""
    i = F.col
    text = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    split = text.select(
        "*",
        F.array_remove(F.split("_t", f"[{SPACE}]+", -1), "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("_l"),
    )
    windows = split.select(
        "*",
        F.when(
            F.size("_w") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda k: F.xxhash64(F.get("_w", k), F.get("_w", k + 1), F.get("_w", k + 2)),
            ),
        ).alias("_h"),
    )
    # positions are sorted by window only where some window occurs twice
    ordered = windows.select(
        "*",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, k: F.struct(h.alias("h"), k.alias("k")))),
        ).alias("_s"),
    )
    twice = ordered.select(
        "*",
        F.when(
            i("_s").isNotNull(),
            F.filter(
                F.transform(
                    "_s",
                    lambda x, k: F.when(
                        (F.get("_s", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("_s", k + 1)["h"].eqNullSafe(x["h"])), x["k"]
                    ),
                ),
                lambda k: k.isNotNull(),
            ),
        ).alias("_p"),
    )
    return twice.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.length(F.regexp_replace("_t", f"[^{SPACE}]+", ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(
            F.size(F.array_distinct(F.flatten(F.transform("_p", lambda k: F.array(k, k + 1, k + 2))))), F.lit(0)
        ).cast("long").alias("n_repeat_words"),
    )


def _ratios(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.select(
        "*",
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("word_chars") / words).alias("mean_word"),
    )


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketch of each group, of documents that pass the base rules."""
    value = F.col("value")
    return (
        _ratios(stats)
        .where(~F.col("base_failed"))
        .select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))).alias("e"))
        .select("lang", "source", "e.*")
        .select(
            "lang", "source", "measure",
            F.when(value <= SMALLEST, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.log(value / SMALLEST) / F.log(F.lit(GAMMA))))).cast("int").alias("bucket"),
        )
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(counts: DataFrame, min_group: int, spread: float) -> DataFrame:
    """(level, lang, source, n, <measure>_lo, <measure>_hi) of the groups at level 2 (lang and source), 1 (lang) and 0 (all)."""
    null = F.lit(None).cast("string")
    levels = counts.select(F.lit(2).alias("level"), "lang", "source", "measure", "bucket", "n")
    for level, keep in ((1, ["lang"]), (0, [])):
        keys = [F.col(c) if c in keep else null.alias(c) for c in ("lang", "source")]
        levels = levels.unionByName(
            counts.select(F.lit(level).alias("level"), *keys, "measure", "bucket", "n")
            .groupBy("level", "lang", "source", "measure", "bucket")
            .agg(F.sum("n").alias("n"))
        )
    group = ["level", "lang", "source", "measure"]
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(SMALLEST * F.pow(F.lit(GAMMA), F.col("bucket")))
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    found = (
        levels.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
        .groupBy(*group)
        .agg(F.first("total").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    )
    out = []
    for m, (margin, low) in MEASURES.items():
        width = spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(margin))
        mine = F.col("measure") == m
        out += [
            F.max(F.when(mine, F.col("q3") + width)).alias(f"{m}_hi"),
            F.max(F.when(mine, F.col("q1") - width if low else F.lit(-1.0))).alias(f"{m}_lo"),
        ]
    return found.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *out).where((F.col("level") == 0) | (F.col("n") >= min_group))


#: The query op10 over the table documents, for DuckDB; the ranges of characters are those of SPACE.
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, lang, source, t, list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM d),
m AS (SELECT r, doc_id, lang, source, w, len(w) AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines FROM s),
tok AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM m WHERE n_words > 2),
tri AS (SELECT r, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS g FROM tok WINDOW p AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri WHERE g IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY r),
b AS (SELECT m.* EXCLUDE (w), coalesce(n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed,
  n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, coalesce(n, 0) / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word
  FROM m LEFT JOIN rep ON rep.r = m.r),
v AS (UNPIVOT (SELECT lang, source, {", ".join(MEASURES)} FROM b WHERE NOT base_failed) ON {", ".join(MEASURES)} INTO NAME measure VALUE x),
c AS (SELECT lang, source, measure, CASE WHEN x <= {SMALLEST}::DOUBLE THEN 0 ELSE greatest(1, ceil(ln(x / {SMALLEST}::DOUBLE) / ln({GAMMA}::DOUBLE))) END AS bucket, count(*) AS n FROM v GROUP BY ALL),
e AS (SELECT 2 AS level, lang, source, measure, bucket, n FROM c UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM c GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, measure, bucket, sum(n) FROM c GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
  CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE {SMALLEST}::DOUBLE * pow({GAMMA}::DOUBLE, bucket) END AS x FROM e),
q AS (SELECT level, lang, source, measure, max(total) AS n, min(x) FILTER (WHERE upto >= 0.25 * total) AS q1, min(x) FILTER (WHERE upto >= 0.75 * total) AS q3,
  CASE measure {" ".join(f"WHEN '{m}' THEN {margin}::DOUBLE" for m, (margin, _) in MEASURES.items())} END AS margin FROM u GROUP BY ALL HAVING level = 0 OR max(total) >= 200),
f AS (SELECT *, q3 + 3.0::DOUBLE * greatest(q3 - q1, margin) AS hi, CASE WHEN measure IN ({", ".join(f"'{m}'" for m, (_, low) in MEASURES.items() if low)}) THEN q1 - 3.0::DOUBLE * greatest(q3 - q1, margin) ELSE -1.0::DOUBLE END AS lo FROM q),
x AS (UNPIVOT (SELECT r, lang, source, {", ".join(MEASURES)} FROM b) ON {", ".join(MEASURES)} INTO NAME measure VALUE x),
y AS (SELECT x.r, bool_and(coalesce(x.x <= coalesce(f2.hi, f1.hi, f0.hi) AND x.x >= coalesce(f2.lo, f1.lo, f0.lo), true)) AS inside FROM x
  LEFT JOIN f f2 ON f2.level = 2 AND f2.measure = x.measure AND f2.lang IS NOT DISTINCT FROM x.lang AND f2.source IS NOT DISTINCT FROM x.source
  LEFT JOIN f f1 ON f1.level = 1 AND f1.measure = x.measure AND f1.lang IS NOT DISTINCT FROM x.lang LEFT JOIN f f0 ON f0.level = 0 AND f0.measure = x.measure GROUP BY x.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM b JOIN y ON y.r = b.r"""


def quality_verdicts(docs: DataFrame, min_group: int = 200, spread: float = 3.0) -> DataFrame:
    """docs' columns but text, the measures, base_failed and kept. Clashing names in docs are replaced."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in own]
    stats = measure(docs.select(*keep)).drop("text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = stage(stats, "quality")
    limits = stage(fences(sketches(stats), min_group, spread), "fences")
    named = lambda level: limits.where(F.col("level") == level).select(
        *(F.col(c).alias(f"_{level}_{c}") for c in limits.columns if c != "level"), F.lit(True).alias(f"_{level}")
    )
    joined = (
        _ratios(stats)
        .join(named(2), F.col("lang").eqNullSafe(F.col("_2_lang")) & F.col("source").eqNullSafe(F.col("_2_source")), "left")
        .join(named(1), F.col("lang").eqNullSafe(F.col("_1_lang")), "left")
        .join(F.broadcast(named(0)), F.lit(True), "left")  # one row
    )
    inside = F.lit(True)
    for m in MEASURES:
        pick = lambda end: F.coalesce(F.when(F.col("_2"), F.col(f"_2_{m}_{end}")), F.when(F.col("_1"), F.col(f"_1_{m}_{end}")), F.col(f"_0_{m}_{end}"))  # noqa: B023, E731
        inside = inside & F.coalesce((F.col(m) <= pick("hi")) & (F.col(m) >= pick("lo")), F.lit(True))
    return joined.select(*stats.columns, (~F.col("base_failed") & inside).alias("kept"))
