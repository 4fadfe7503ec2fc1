"""Alerts from a stream of crawled listings: what changed between each supplier's last two complete crawls.

A crawl of a supplier on a day may come in any number of batches, and counts from when its end is
told, not from when a batch ends. The listings of a supplier are dealt over several shares by their
name, so that one that has a third of all listings isn't one task's; an end goes to all of them.
Shares fall into a fixed number of buckets, which are the keys of the state: what a batch brings to a
bucket is weighed for all of its shares at once, so that work goes with listings, not with suppliers.
State holds the last two complete crawls of each share and those that are still open.

Listings that come twice (by id) count once; those that come late, for one of the two crawls, make
its alerts anew; those for earlier crawls are left out. Every change of a share writes all that holds
for it now under a higher number, so that readers take the highest, and a batch that is run again
replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import history
from ..operators.rollup import slabs
from .state import rocksdb

#: Shares that a supplier's listings are dealt over.
SALTS = 8
#: Keys of the state, among which all shares are dealt; a stream keeps the number with which it began.
BUCKETS = 512
PAIRS = "supplier_id long, salt int, seq long, latest_date timestamp, name_norm string, thickness string, latest long, previous long, crossed boolean, now_names long, prev_names long"


def crawled(materials: DataFrame, day: F.Column) -> DataFrame:
    """(supplier_id, day, name_norm, thickness, id, slabs, ends, rebased) of listings."""
    return materials.select("supplier_id", day.alias("day"), F.col("base").alias("name_norm"), F.coalesce("thickness", F.lit("")).alias("thickness"), "id", slabs().alias("slabs"), F.lit(False).alias("ends"), F.lit(0).alias("rebased"))


def ended(crawls: DataFrame) -> DataFrame:
    """The same columns of ends of crawls (supplier_id, day, rebased)."""
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    return crawls.select("supplier_id", "day", text.alias("name_norm"), text.alias("thickness"), none.alias("id"), none.alias("slabs"), F.lit(True).alias("ends"), F.col("rebased").cast("int").alias("rebased"))


def dealt(rows: DataFrame, salts: int, buckets: int = BUCKETS) -> DataFrame:
    """Listings with the share that their name falls to, ends with every share, and the bucket of each; rows of no supplier, of which no alert tells, are left out."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    # a column with nulls would come as floats, in which long ids aren't told apart
    whole = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("id", "slabs")}
    salted = rows.where("supplier_id is not null").withColumns(whole).withColumn("salt", F.explode(F.when(F.col("ends"), every).otherwise(F.array(F.pmod(F.xxhash64("name_norm"), F.lit(salts)).cast("int")))))
    return salted.withColumn("bucket", F.pmod(F.xxhash64("supplier_id", "salt"), F.lit(buckets)).cast("int"))


#: A share, and what is kept of ends and, by day, of listings.
SHARE = ["supplier_id", "salt"]
ENDS = pa.schema([("supplier_id", pa.int64()), ("salt", pa.int32()), ("day", pa.int64()), ("rebased", pa.int32())])
LISTINGS = pa.schema([("supplier_id", pa.int64()), ("salt", pa.int32()), ("id", pa.int64()), ("name_norm", pa.string()), ("thickness", pa.string()), ("slabs", pa.int64())])


class _Crawls(StatefulProcessor):
    """State of one bucket: each day's listings (by share and id), and which crawls have ended. All shares are weighed together, in a few steps over columns; what no longer counts isn't kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.crawls = handle.getMapState("crawls", "day long", "listings binary")
        self.ends = handle.getValueState("ends", "seq long, ends binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        came = came[came["day"].notna()]
        came = came.assign(day=came["day"].astype("datetime64[ns]").astype("int64"))
        seq, packed = self.ends.get() if self.ends.exists() else (0, None)
        told = came[came["ends"]].groupby([*SHARE, "day"], as_index=False)["rebased"].max()
        ends = pd.concat([_unpacked(packed, ENDS), told]).drop_duplicates([*SHARE, "day"], keep="last").sort_values([*SHARE, "day"])
        # of each share the last two ends count; what lies before them doesn't
        ends["back"] = ends.groupby(SHARE).cumcount(ascending=False)
        ends = ends[ends["back"] < 2]
        first = ends[ends["back"] == 1].set_index(SHARE)["day"].rename("first").astype("Int64")  # shares without one are not to make it floats
        new = _late(came, first)
        kept = [self._kept(day, value, part, first) for day, value, part in self._days(new[~new["ends"]])]
        seq += 1
        self.ends.update((seq, _packed(ends, ENDS)))
        two = first.to_frame().join(ends[ends["back"] == 0].set_index(SHARE)["day"].rename("last"))
        touched = new[[*SHARE, "day"]].drop_duplicates().join(two, on=SHARE, how="inner")
        touched = touched.loc[(touched["day"] == touched["first"]) | (touched["day"] == touched["last"]), SHARE].drop_duplicates()
        if len(touched):
            yield self._compared(seq, touched.join(two, on=SHARE), ends, pd.concat([_unpacked(None, LISTINGS).assign(day=0), *kept]))

    def _days(self, new: pd.DataFrame) -> Iterator[tuple]:
        """(day, what is kept of it, what came for it) of every day that has either."""
        had = {day: value for (day,), (value,) in self.crawls.iterator()}
        parts = dict(iter(new.groupby("day")))
        for day in sorted(had.keys() | parts.keys()):
            yield day, had.get(day), parts.get(day)

    def _kept(self, day: int, packed: bytes | None, part: pd.DataFrame | None, first: pd.Series) -> pd.DataFrame:
        """A day's listings that still count, which are what state then holds of it."""
        had = _unpacked(packed, LISTINGS).assign(day=day)
        now = _late(had, first)
        if part is not None:
            now = pd.concat([now, part[now.columns]]).drop_duplicates([*SHARE, "id"], keep="last")
        if part is not None or len(now) < len(had):
            self.crawls.updateValue((day,), (_packed(now, LISTINGS),)) if len(now) else self.crawls.removeKey((day,))
        return now

    def _compared(self, seq: int, touched: pd.DataFrame, ends: pd.DataFrame, listings: pd.DataFrame) -> pd.DataFrame:
        """All that holds now for some shares (with first and last, the days to compare)."""
        rows = listings.merge(touched, on=SHARE)
        sides = {"latest": rows[rows["day"] == rows["last"]], "previous": rows[rows["day"] == rows["first"]]}
        sums = {side: part.groupby([*SHARE, "name_norm", "thickness"])["slabs"].sum().astype("Int64") for side, part in sides.items()}
        pairs = pd.concat(sums, axis=1).reset_index() if any(map(len, sums.values())) else pd.DataFrame(columns=[*SHARE, "name_norm", "thickness", *sums])
        names = {out: sides[side].groupby(SHARE)["name_norm"].nunique().rename(out) for side, out in (("latest", "now_names"), ("previous", "prev_names"))}
        rebased = {out: ends[ends["back"] == back].set_index(SHARE)["rebased"].rename(out) for back, out in ((0, "_now"), (1, "_before"))}
        fixed = touched
        for one in (*names.values(), *rebased.values()):
            fixed = fixed.join(one, on=SHARE)
        fixed = fixed.fillna({c: 0 for c in names}).astype({c: "int64" for c in names})
        fixed = fixed.assign(seq=seq, latest_date=pd.to_datetime(fixed["last"]), crossed=(fixed["_now"] != 0) & (fixed["_before"] == 0))
        # a row without a name tells of a share that has no listings, too
        every = pd.concat([pairs, fixed[SHARE]], ignore_index=True).merge(fixed, on=SHARE)
        every = every.astype({"name_norm": object, "thickness": object, "latest": "Int64", "previous": "Int64"})
        every[["name_norm", "thickness"]] = every[["name_norm", "thickness"]].where(every["name_norm"].notna(), None)
        return every[[c.split()[0] for c in PAIRS.split(", ")]]

    def close(self) -> None:
        pass


def _late(rows: pd.DataFrame, first: pd.Series) -> pd.DataFrame:
    """Rows (with their shares and days) but those before the day that is the first to count for their share."""
    since = rows[SHARE].join(first, on=SHARE)["first"]
    return rows[(rows["day"] >= since).fillna(True).to_numpy(bool)]


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    table, sink = pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    """The rows that were packed, or none."""
    return (schema.empty_table() if packed is None else pa.ipc.open_stream(bytes(packed)).read_all()).to_pandas()


def follow(spark: SparkSession, listings: DataFrame, path: str, checkpoint: str, salts: int = SALTS) -> StreamingQuery:
    """Follows a stream of crawled and ended rows; writes what holds for each share that has changed to path, a folder for each batch. Ends when the stream has been read."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    keyed = dealt(listings, salts).groupBy("bucket")
    pairs = keyed.transformWithStateInPandas(_Crawls(), outputStructType=PAIRS, outputMode="Update", timeMode="None")
    with rocksdb(spark):
        return pairs.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(supplier_id, name_norm, thickness, kind, latest, previous, sig) of what follow has written: the alerts that hold now, as history.digest has them."""
    rows = spark.read.option("recursiveFileLookup", True).schema(PAIRS).parquet(path)
    last = rows.groupBy("supplier_id", "salt").agg(F.max("seq").alias("seq"))
    now = rows.join(last, ["supplier_id", "salt", "seq"])
    scale = now.where("name_norm is null").groupBy("supplier_id").agg(F.sum("now_names").alias("_now"), F.sum("prev_names").alias("_prev"))
    here = F.max(F.col("latest").isNotNull().cast("int")).over(Window.partitionBy("supplier_id", "name_norm"))
    listed = now.where("name_norm is not null").withColumn("_here", here).join(scale, "supplier_id")
    fell = (F.col("_prev") > 0) & (F.col("_now") < (1 - history.COLLAPSE) * F.col("_prev"))
    gone = F.col("latest").isNull() & (F.col("previous") > 0) & (F.col("_here") == 0) & ~fell
    kinds = listed.withColumn("kind", F.when(F.col("latest").isNotNull(), history.alert_kind(F.col("latest"), F.col("previous"), F.col("crossed"))).when(gone, "delisted"))
    sig = F.concat_ws("|", "kind", F.col("supplier_id").cast("string"), "name_norm", "thickness", F.date_format("latest_date", "yyyy-MM-dd"))
    return kinds.where("kind is not null").select("supplier_id", "name_norm", "thickness", "kind", "latest", "previous", sig.alias("sig"))
