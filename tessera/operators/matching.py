"""Vector matches and what they agree on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

MARGIN = 0.02
#: Pivots at most; vectors of a cell, and queries, that one group has; scores made at once.
PIVOTS, CHUNK, AT_ONCE = 1024, 1 << 16, 1 << 22
#: Scores are compared to so many digits.
DIGITS = 6


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1)
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


class Cells:
    """Cells of vectors around their nearest pivots: number of vectors, least and greatest angle to the pivot; and the range of all lengths."""

    def __init__(self, pivots: np.ndarray, stats: list) -> None:
        self.pivots = pivots
        self.n, self.near, self.far = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in stats:
            self.n[r["cell"]], self.near[r["cell"]], self.far[r["cell"]] = r["n"], r["near"], r["far"]
        self.least = min((r["least"] for r in stats), default=1.0)
        self.most = max((r["most"] for r in stats), default=1.0)

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """Of each query the cells that hold k vectors, the nearest pivots first."""
        angle = np.where(self.n > 0, _angles(q, self.pivots), np.inf)
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(angle.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (self.n > 0)

    def reached(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Of each query the cells that may hold a vector that scores as much as its kth: by the triangle inequality the others can't."""
        score = kth - 2 * 10.0**-DIGITS
        norms = np.linalg.norm(q, axis=1) * np.where(score > 0, self.most, self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.arccos(np.clip(np.nan_to_num(score / norms, nan=-1.0, posinf=1.0, neginf=-1.0), -1, 1)) + 1e-7
        angle = _angles(q, self.pivots)
        apart = np.maximum(np.maximum(angle - self.far, self.near - angle), 0)
        return (apart <= reach[:, None]) & (self.n > 0)


def _visits(queries: DataFrame, cells: Cells, size: int, k: int, found: bool) -> DataFrame:
    """(query_id, query, own, cell, salt): the cells that queries look into: first for k vectors, then, where kth is known, all others that they reach."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)
    names = ["query_id", "query", "own"] + (["kth"] if found else [])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(1), size)
                mark = cells.first(q, k)
                if found:
                    mark = cells.reached(q, batch.column(3).to_numpy()) & ~mark
                row, cell = np.nonzero(mark)
                salts = -(-cells.n[cell] // CHUNK)
                row, cell, salt = np.repeat(row, salts), np.repeat(cell, salts), np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32))], ["query_id", "query", "own", "cell", "salt"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.select(*names).mapInArrow(visit, f"query_id {kinds['query_id']}, query array<double>, own {kinds['own']}, cell int, salt int")


def _best(vectors: DataFrame, visits: DataFrame, size: int, k: int, schema: str) -> DataFrame:
    """The k best vectors of each query in each part of a cell that it looks into."""

    def score(x: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and q.num_rows:
            v, asked, ids = _matrix(x["embedding"], size), _matrix(q["query"], size), x["vec_id"].to_numpy()
            theirs, own = np.array(x["supplier_id"].to_pylist(), object), q["own"].to_pylist()
            step = max(1, AT_ONCE // len(v))
            for lo in range(0, len(asked), step):
                near = np.round(asked[lo : lo + step] @ v.T, DIGITS)
                for i, row in enumerate(near, lo):
                    may = np.flatnonzero(theirs != own[i]) if own[i] is not None else np.arange(len(v))
                    if len(may) > k:
                        least = -np.partition(-row[may], k - 1)[k - 1]
                        may = may[row[may] >= least]
                    may = may[np.lexsort((ids[may], -row[may]))][:k]
                    out.append((np.full(len(may), i), may, row[may]))
        who, which, scores = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(3))
        made = x.select(["vec_id", "material_key", "supplier_id"]).take(pa.array(which, pa.int64()))
        return made.add_column(0, "query_id", q["query_id"].take(pa.array(who, pa.int64()))).append_column("score", pa.array(scores, pa.float64()))

    return vectors.groupBy("cell", "salt", "block").cogroup(visits.groupBy("cell", "salt", "block")).applyInArrow(score, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, material_key, supplier_id, score): the k vectors nearest to each query (query_id, query, and own: a supplier whose vectors don't count), by the dot product, which of unit vectors is the cosine; of equal scores the smaller vec_id first.

    Vectors lie in cells around pivots. A query looks into the nearest cells that hold k vectors,
    which gives it a radius, and then into those that reach into it: exact, whatever the data, and
    few cells where vectors lie in clusters. Cells are shared out in parts of bounded size. Vectors
    and queries that are null, hold null or NaN components, or aren't of the first vector's length
    are left out.
    """
    sound = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")))
    kept = vectors.where(sound("embedding")).select("vec_id", "material_key", "supplier_id", F.col("embedding").cast("array<double>").alias("embedding"))
    first = kept.orderBy("vec_id").select(F.size("embedding").alias("n")).first()
    size = first["n"] if first else 0
    kept = kept.where(F.size("embedding") == size)
    if "own" not in queries.columns:
        queries = queries.withColumn("own", F.lit(None).cast(vectors.schema["supplier_id"].dataType))
    asked = queries.where(sound("query")).where(F.size("query") == size).select("query_id", F.col("query").cast("array<double>").alias("query"), "own")
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {kind['vec_id']}, material_key string, supplier_id {kind['supplier_id']}, score double"
    n = kept.count()
    wanted = max(1, min(PIVOTS, int(n**0.5)))
    drawn = kept.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(wanted).collect()  # at most PIVOTS vectors
    pivots = np.array([r["embedding"] for r in drawn], np.float64).reshape(len(drawn), size)
    norms = np.linalg.norm(pivots, axis=1)
    pivots = pivots / np.where(norms > 0, norms, 1)[:, None]
    sent = kept.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(3), size)
                angle = _angles(x, sent.value)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]), pa.array(np.linalg.norm(x, axis=1))], [*batch.schema.names, "cell", "angle", "norm"])

    placed = staged(kept.mapInArrow(place, f"vec_id {kind['vec_id']}, material_key string, supplier_id {kind['supplier_id']}, embedding array<double>, cell int, angle double, norm double"), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.min("norm").alias("least"), F.max("norm").alias("most")).collect()
    cells = Cells(pivots, stats)
    parts = F.coalesce(*(F.when(F.col("cell") == c, F.lit(int(-(-m // CHUNK)))) for c, m in enumerate(cells.n.tolist()) if m > CHUNK), F.lit(1))
    # queries in blocks of bounded size, too: each block meets each part of the cells that it looks into
    blocks = max(1, -(-asked.count() // CHUNK))
    shared = placed.select("vec_id", "material_key", "supplier_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    looks = lambda q, found: _visits(q, cells, size, k, found).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    near = staged(top(_best(shared, looks(asked, False), size, k, schema)), "near")
    kth = near.where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("kth"))
    further = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-float("inf"))))
    more = _best(shared, looks(further, True), size, k, schema)
    return top(near.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "material_key", "supplier_id", "score")


def best_products(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best products of each query, each by its best vector, among its max(6 k, 200) nearest vectors."""
    return best_of_key(nearest(vectors, queries, max(6 * k, 200)), k)


def best_of_key(matches: DataFrame, k: int) -> DataFrame:
    """The k best products of each query among its matches, each by its best vector."""
    one = matches.groupBy("query_id", "material_key").agg(F.max("score").alias("score"), F.min_by("vec_id", F.struct((-F.col("score")).alias("s"), "vec_id")).alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "material_key")
    return one.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def consensus(matches: DataFrame, window: int = 40) -> DataFrame:
    """Per query and product among the first matches: best score, images, suppliers, and the rank score that weighs agreement."""
    top = matches.where(F.col("rank") < window)
    keys = top.groupBy("query_id", "material_key").agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("images"), F.count_distinct("supplier_id").alias("suppliers"))
    share = F.col("images") / F.sum("images").over(Window.partitionBy("query_id"))
    rank = F.col("best_score") * (0.55 + 0.45 * share) * (0.7 + 0.3 * F.sqrt(F.col("suppliers") / F.col("images")))
    return keys.select("*", F.round(share, 6).alias("share"), F.round(rank, 6).alias("rank_score"))


def identify(candidates: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, material_key, confidence): the product named for each query among its `most` best-scored ones, or none where the first two score alike."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best_score"), "material_key"))
    candidates = candidates.withColumn("_nth", first).where(F.col("_nth") <= most).drop("_nth")
    order = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "material_key")
    c = candidates.select("*", F.row_number().over(order).alias("_rn"), F.lead("best_score").over(order).alias("_s"), F.lead("rank_score").over(order).alias("_r"))
    margin = F.round(F.coalesce(F.col("best_score") - F.col("_s"), F.lit(1.0)), 6)
    lead = F.round(F.col("rank_score") - F.coalesce("_r", F.lit(0.0)), 6)
    verdict = (
        F.when(margin < MARGIN, "none")
        .when((F.col("best_score") >= 0.95) & (lead >= 0.02), "strong")
        .when((F.col("share") >= 0.25) & (F.col("best_score") >= 0.80) & (lead >= 0.03), "strong")
        .when((F.col("share") >= 0.12) | (F.col("best_score") >= 0.75), "likely")
        .otherwise("uncertain")
    )
    return c.where("_rn = 1").select("query_id", "material_key", "best_score", "share", verdict.alias("confidence"))
