"""Two catalogs become one: hosts that the other has read more recently move over, all of them or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entity, rollup
from ..sources import commits, store
from ..sources.staging import staged


def plan(ours: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> DataFrame:
    """(host, newest, moves) of every host with materials in theirs: it moves where its newest stamp is later than ours, or where we have none. A host without materials never moves."""

    def newest(tables: dict[str, DataFrame], name: str) -> DataFrame:
        at = tables["materials"].join(tables["suppliers"].select(F.col("id").alias("supplier_id"), "host"), "supplier_id")
        return at.groupBy("host").agg(F.max("crawled_at").alias(name))

    both = newest(theirs, "newest").join(newest(ours, "_ours"), "host", "left")
    return both.select("host", "newest", (F.col("_ours").isNull() | (F.col("newest") > F.col("_ours"))).alias("moves"))


def _refused(ours: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> str:
    return store.schema_gate({k: ours[k] for k in ("suppliers", "materials", "history")}, theirs)


def _moving(ours: dict[str, DataFrame], theirs: dict[str, DataFrame], done: DataFrame | None) -> DataFrame:
    moving = plan(ours, theirs).where("moves").select("host", "newest")
    return moving if done is None else moving.join(done.select("host", "newest"), ["host", "newest"], "left_anti")


def merged(ours: dict[str, DataFrame], theirs: dict[str, DataFrame], aliases: DataFrame | None = None, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """ours (suppliers, materials, history) with the hosts that move, under our numbers, their products folded by our aliases, and the rollup made anew.

    Refuses tables of another schema. done: the ledger (host, newest) of earlier merges; what it has
    isn't moved again. A host that we don't know gets a number beyond ours, in the order of theirs.
    The ledger of this merge comes with the tables.
    """
    if reason := _refused(ours, theirs):
        raise ValueError(reason)
    # a row for each host, written once: what is joined with it, listings above all, stays where it is
    moving = staged(_moving(ours, theirs, done), "moving")
    s = theirs["suppliers"].join(moving.select("host"), "host", "left_semi")
    known = s.join(ours["suppliers"].select("host", F.col("id").alias("_id")), "host", "left")
    top = ours["suppliers"].agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))  # one row
    numbered = staged(known.join(F.broadcast(top), F.lit(True), "left").withColumn("_new", F.coalesce("_id", F.col("_top") + 1 + F.col("id"))), "numbered")
    ids = numbered.select(F.col("id").alias("supplier_id"), F.col("_new").alias("_to"))

    def moved(name: str) -> DataFrame:
        df = theirs[name]
        return df.join(ids, "supplier_id").withColumn("supplier_id", F.col("_to")).select(*df.columns)

    # only hosts with materials move, so that these are the suppliers whose materials are replaced
    taken = numbered.select(F.col("_new").alias("supplier_id"))
    materials = ours["materials"].join(taken, "supplier_id", "left_anti").unionByName(moved("materials"), allowMissingColumns=True)
    if aliases is not None:
        materials = entity.apply_aliases(materials, entity.resolve_aliases(aliases))
    fresh = moved("history")
    dates = staged(fresh.select("supplier_id", "snapshot_date").distinct(), "dates")
    past = ours["history"].join(dates, ["supplier_id", "snapshot_date"], "left_anti").unionByName(fresh)
    suppliers = store.upsert(ours["suppliers"], numbered.withColumn("id", F.col("_new")).select(*theirs["suppliers"].columns), "id")
    return {"suppliers": suppliers, "materials": materials, "history": past, "rollup": rollup.product_rollup(materials, suppliers), "ledger": moving if done is None else done.select("host", "newest").unionByName(moving)}


def merge_into(spark: SparkSession, path: str, theirs: dict[str, DataFrame], aliases: DataFrame | None = None) -> int:
    """merged with the store at path (suppliers, materials, history, and a ledger where there has been a merge), as one new version: all hosts move or none does. A merge after which nothing moves any more, and that folds no aliases, names the tables that are there. Made anew where another writer was first. Returns the version."""
    tables = ("suppliers", "materials", "history")

    def change(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        ours, done = {t: now[t] for t in tables}, now.get("ledger")
        if aliases is None and done is not None and "rollup" in now and not _refused(ours, theirs) and _moving(ours, theirs, done).isEmpty():
            return {}
        return merged(ours, theirs, aliases, done)

    return commits.transact(spark, path, change)
