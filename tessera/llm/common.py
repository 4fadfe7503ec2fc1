"""What the operators of this subpackage share: staged tables, split keys and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one where the session names none, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _forget() -> None:
    for spark, path in _staged:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended first
            return


atexit.register(_forget)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, its columns can be pruned, and a lost executor takes nothing with it. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_training(doc_id: Column) -> Column:
    """The fixed fold of the labelled rows that may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), keys of any ordered type.

    Returns (node, root), root being the smallest node that can be reached, for every node of an
    edge. Large-star and small-star steps in turn until nothing changes: each is one grouping by
    node, a star of any size stays a star, and the number of rounds grows as the logarithm of the
    longest path. Each round is written to the shared folder. Rows with a null end are ignored.
    """
    now = stage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    count = -1
    for _ in range(max_rounds):
        # large star: every larger neighbour points at the smallest neighbour (or the node itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: smaller neighbours and the node itself point at the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = stage(small, "edges")
        changed, n = _differ(now, after)
        drop_staged(now)
        now = after
        if not changed:
            break
        count = n
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds ({count} edges)")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _differ(x: DataFrame, y: DataFrame) -> tuple[bool, int]:
    sums = [
        d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h"), F.bit_xor(F.xxhash64("b", "a")).alias("x")).first()
        for d in (x, y)
    ]
    return sums[0] != sums[1], sums[1]["n"]
