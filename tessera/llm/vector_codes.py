"""Vector code compression over distinct integer parts (operator 13).

Components become integers, vectors are cut into equal consecutive parts, and the parts of each
position that are equal become one row with its number. A few rounds of weighted Lloyd run over
those distinct rows alone: in each, tasks hold the codebooks (parts x entries x components,
bounded), assign their rows and hand back one sum for each entry. Codes and errors of distinct parts
are joined back to the vectors by the part itself.

Vectors that are null, empty, or hold null or non-finite components are dropped; so are those whose
components reach 2^17, beyond which distances aren't exact in 64 bits, and those whose length isn't
that of the kept vector with the smallest id. Where the number of parts doesn't divide the length,
the last part is filled up with zeros. The first entries are the vectors of the smallest ids, null
ids last, equal ids by their integers; fewer vectors than entries give fewer entries. Equal rows
keep a row each. Ties of distance go to the lower entry. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Integers a unit, positions of parts, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components must stay below this.
LIMIT = float(1 << 17)
#: Numbers compared at once.
AT_ONCE = 1 << 21


def integers(column: Column, scale: int) -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def fit_to_keep(column: Column) -> Column:
    """Whether a vector has components, all of them finite and within the limit."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda x: F.coalesce((F.abs(x.cast("double")) < LIMIT) & ~F.isnan(x), F.lit(False))), F.lit(False))


def assign(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row, exact; ties to the lower entry."""
    code, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    size = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    by_product = size * size * max(book.shape[1], 1) < 1 << 50  # sums of products are whole numbers that a double holds
    step = max(1, AT_ONCE // max(book.size if not by_product else len(book), 1))
    squares = (book * book).sum(axis=1)
    for lo in range(0, len(rows), step):
        x = rows[lo : lo + step]
        if by_product:
            d = (x * x).sum(axis=1)[:, None] + squares - 2 * (x.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)
        else:
            d = ((x[:, None, :] - book) ** 2).sum(axis=2)
        code[lo : lo + step] = d.argmin(axis=1)
        error[lo : lo + step] = np.take_along_axis(d, code[lo : lo + step, None], axis=1)[:, 0]
    return code, error


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries at the floor of their rows' mean, unused ones where they were."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            at, rows, weight = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            for p in np.unique(at).tolist():
                own = at == p
                code, _ = assign(rows[own], books[p])
                np.add.at(total[p], code, rows[own] * weight[own][:, None])
                np.add.at(count[p], code, weight[own])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p * books.shape[1] + e), pa.array(total[p, e].tolist(), pa.list_(pa.int64())), pa.array(count[p, e])], ["entry", "total", "n"])

    # some sums for each task meet at their entry: parts x entries rows come back
    made = distinct.mapInArrow(sums, "entry long, total array<long>, n long")
    by_entry = made.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"c{i}") for i in range(books.shape[2])])
    out = books.copy().reshape(-1, books.shape[2])
    for r in by_entry.collect():
        out[r[0]] = [x // r[1] for x in r[2:]]
    return out.reshape(books.shape)


def codes(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(at, part, code, error) of the distinct parts."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            code, error = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for p in np.unique(at).tolist():
                code[at == p], error[at == p] = assign(rows[at == p], sent.value[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], ["at", "part", "code", "error"])

    return distinct.select("at", "part").mapInArrow(coded, "at int, part array<int>, code int, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every kept vector, and the codebooks by part, entry and component."""
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("v")).where(fit_to_keep(F.col("v")))
    kept = kept.select("vec_id", "label", integers(F.col("v"), scale).alias("v"))
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("v"), "v").select(F.size("v").alias("n")).first()
    size = least["n"] if least else 0
    width = -(-size // parts)
    padded = F.concat("v", F.array_repeat(F.lit(0), width * parts - size)) if width * parts > size else F.col("v")
    cut = F.array(*[F.slice(padded, p * width + 1, width) for p in range(parts)])
    kept = stage(kept.where(F.size("v") == size).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", cut.alias("parts")), "vectors")
    each = kept.select("row", F.posexplode("parts").alias("at", "part"))
    distinct = stage(each.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    books = np.array([r.parts for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = moved(distinct, books)
    met = each.join(codes(distinct, books), ["at", "part"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("codes"), F.sum("error").alias("error"))
    hexed = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.code), 2, "0"))))
    out = stage(kept.drop("parts").join(met.select("row", hexed.alias("code"), "error"), "row").drop("row"), "codes")
    by_label = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def _sql() -> str:
    """The same in DuckDB, a few common tables for each round."""
    steps = [
        """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)
), b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < 256
)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS (
  SELECT vec_id, p, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + e) AS m FROM x JOIN b{k} USING (p) GROUP BY vec_id, p
)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(s ORDER BY j) AS c FROM (
    SELECT p, m % 256 AS e, j, floor(sum(x[j]) / count(*)) AS s FROM a{k}, range(1, (SELECT max(len(x)) FROM x) + 1) t(j) GROUP BY ALL) GROUP BY p, e
), b{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e
)""")
    return f"""
WITH {", ".join(steps)}, digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda z: z::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS}
), coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex((m % 256)::BIGINT)), 2, '0'), '' ORDER BY p) AS code, sum(floor(m / 256))::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


SQL = _sql()
