"""Reading and writing the catalog's tables: partitions replaced whole, rows updated by key, suppliers erased."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import commits


def read_json(spark: SparkSession, path: str, schema: StructType | str, strict: bool, lines: bool = False) -> DataFrame:
    """JSON documents, or a record in each line; strict fails on corrupt input, else corrupt records are null."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def with_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """df in the schema's columns; those it lacks are null."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def schema_mismatch(a: StructType, b: StructType) -> tuple[set[str], set[str]]:
    """(missing in b, only in b)."""
    x, y = {f.name for f in a}, {f.name for f in b}
    return x - y, y - x


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old and new by key; new values win where they aren't null."""
    x, y = old.alias("x"), new.alias("y")
    cell = lambda c: F.coalesce(F.col(f"y.{c}"), F.col(f"x.{c}")) if c in new.columns else F.col(f"x.{c}")
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full").select(*(cell(c).alias(c) for c in old.columns))


def first_of_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key without nulls, the first by order; rows with a null in the key all stay."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    ranked = rows.withColumn("_rn", F.when(whole, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).otherwise(1))
    return ranked.where("_rn = 1").drop("_rn")


def replace_suppliers(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the partitions of all suppliers in new replaced."""
    return old.join(new.select("supplier_id").distinct(), "supplier_id", "left_anti").unionByName(first_of_key(new, ["supplier_id", "item_id", "idone"], ["id"]))


def purge(tables: dict[str, DataFrame], denied: DataFrame) -> dict[str, DataFrame]:
    """Tables without the suppliers whose host is denied or lies under a denied domain; vectors of photos that nobody else shows go too."""
    dots = F.size(F.split("host", r"\."))
    under = tables["suppliers"].select("id", F.explode(F.transform(F.sequence(F.lit(1), dots), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, dots), "."))).alias("domain"))
    gone = under.join(denied.select(F.lower("domain").alias("domain")), "domain", "left_semi").select(F.col("id").alias("supplier_id")).distinct()
    out = {name: df.join(gone, "supplier_id", "left_anti") for name, df in tables.items() if "supplier_id" in df.columns}
    out["suppliers"] = tables["suppliers"].join(gone, F.col("id") == F.col("supplier_id"), "left_anti")
    if "vectors" in tables and "image_url" in tables["vectors"].columns:
        out["vectors"] = tables["vectors"].join(out["materials"].select("image_url").distinct(), "image_url", "left_semi")
    return out


def newer_partitions(ours: DataFrame, theirs: DataFrame, mark: str) -> DataFrame:
    """(host) of which their newest mark is strictly newer than ours, or that only they have."""
    x = ours.groupBy("host").agg(F.max(mark).alias("_x"))
    y = theirs.groupBy("host").agg(F.max(mark).alias("_y"))
    return y.join(x, "host", "left").where(F.col("_x").isNull() | (F.col("_y") > F.col("_x"))).select("host")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df's partitions over those at path; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_partitions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of the keys that new has replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def scrubbed(suppliers: DataFrame, gone: DataFrame, contacts: tuple[str, ...] = ("email", "phone")) -> DataFrame:
    """suppliers without the contacts of those that are gone (host), where users' notes keep their rows."""
    marked = suppliers.join(gone.select("host", F.lit(True).alias("_gone")), "host", "left")
    return marked.withColumns({c: F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)) for c in contacts if c in suppliers.columns}).select(*suppliers.columns)


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Tables as the next version of the store at path: readers see all of them or, until then, the version before; other tables of the store stay. Returns the path."""
    spark = next(iter(tables.values())).sparkSession
    commits.transact(spark, path, lambda _: tables)
    return path


def opened(spark: SparkSession, path: str, schemas: dict[str, StructType], version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a store's version in their present schemas: tables that aren't there yet are empty, columns that came later are null."""
    there = commits.read(spark, path, version)
    return {name: with_columns(there[name], schema) if name in there else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def schema_gate(ours: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> str:
    """Why their tables can't be merged into ours: a table or columns that they lack, or have and we don't; '' if they can."""
    for name, df in ours.items():
        if name not in theirs:
            return f"no table {name}"
        missing, extra = schema_mismatch(df.schema, theirs[name].schema)
        if missing or extra:
            return f"{name}: missing {', '.join(sorted(missing)) or 'nothing'}; not known here: {', '.join(sorted(extra)) or 'nothing'}"
    return ""


def write_csv(df: DataFrame, path: str, order: list, most: int | None = None) -> None:
    """An export in order, of at most so many rows if told so, as CSV with a header and a mark that says it is UTF-8; several files where it is large, each in order, named in order."""
    ordered = df.orderBy(*order)
    ordered = ordered.limit(most) if most is not None else ordered
    first = f"\ufeff{df.columns[0]}"
    ordered.withColumnRenamed(df.columns[0], first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def to_api(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
