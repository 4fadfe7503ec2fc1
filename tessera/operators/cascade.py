"""Removals that follow from declared keys: what a supplier's purge or a storefront's re-scope takes with it, in which order, and what stays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """Rows of `child` refer by `columns` to those of `parent` by `parent_columns`.

    then: goes (with a removed parent row), orphan (goes where no parent row is left, among those
    that share the first column with a removed one) or stays (users' own rows).
    """

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    then: str = "goes"


#: What a supplier's purge removes. Vectors hang on photos, so they are found before the listings go; saved items are users' own.
PURGE = (
    Key("materials", ("supplier_id",), "suppliers", ("id",)),
    Key("slabs", ("supplier_id",), "suppliers", ("id",)),
    Key("history", ("supplier_id",), "suppliers", ("id",)),
    Key("vectors", ("image_url",), "materials", ("image_url",)),
    Key("list_items", ("supplier_id",), "suppliers", ("id",), "stays"),
)
#: What a storefront's re-scope removes: slabs of items of which no listing is left.
RESCOPE = (Key("slabs", ("supplier_id", "item_id"), "materials", ("supplier_id", "item_id"), "orphan"),)
#: Columns of a purged supplier's row that are emptied; the row stays, as saved items refer to it.
SCRUBBED = ("token", "company", "products", "phone", "email", "image_base", "locations")
REMOVED = "removed at the supplier's request (denylisted)"


def order(keys: tuple[Key, ...], root: str) -> list[str]:
    """The tables that a removal from root reaches, each after all that it depends on; keys that form a cycle are an error."""
    reached, todo = {root}, [root]
    while todo:
        parent = todo.pop()
        for k in keys:
            if k.parent == parent and k.then != "stays" and k.child not in reached:
                reached.add(k.child)
                todo.append(k.child)
    out: list[str] = []
    while len(out) < len(reached):
        free = sorted(t for t in reached - set(out) if all(k.parent in out or k.parent not in reached for k in keys if k.child == t and k.then != "stays"))
        if not free:
            raise ValueError(f"keys of {sorted(reached - set(out))} form a cycle")
        out += free
    return out


def _values(rows: DataFrame, key: Key) -> DataFrame:
    """The distinct keys of parent rows, under the child's names; empty ones refer to nothing."""
    named = rows.select(*(F.col(p).alias(c) for p, c in zip(key.parent_columns, key.columns, strict=True)))
    said = (F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in key.columns)
    return named.where(reduce(lambda a, b: a & b, said)).distinct()


def removal(tables: dict[str, DataFrame], keys: tuple[Key, ...], root: str, gone: DataFrame, on: tuple[str, ...], touched: DataFrame | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept, removed) of every table that removing root's rows of `gone` (by the columns `on`) reaches, as semi- and anti-joins in order; tables that aren't there are passed over. touched: the values of an orphan's first column to look at, instead of those that removed parents have."""
    done = {root: (tables[root].join(gone, list(on), "left_anti"), tables[root].join(gone, list(on), "left_semi"))}
    for name in order(keys, root):
        if name == root or name not in tables:
            continue
        kept, removed = tables[name], None
        for key in (k for k in keys if k.child == name and k.parent in done and k.then != "stays"):
            left, lost = done[key.parent]
            columns = list(key.columns)
            if key.then == "goes":
                hit = _values(lost, key)
                part, kept = kept.join(hit, columns, "left_semi"), kept.join(hit, columns, "left_anti")
            else:
                near = (lost.select(F.col(key.parent_columns[0]).alias(columns[0])) if touched is None else touched.select(columns[0])).distinct()
                has = _values(left, key)
                looked = kept.join(near, columns[:1], "left_semi")
                part = looked.join(has, columns, "left_anti")
                kept = kept.join(near, columns[:1], "left_anti").select(*tables[name].columns).unionByName(looked.join(has, columns, "left_semi").select(*tables[name].columns))
            part = part.select(*tables[name].columns)
            removed = part if removed is None else removed.unionByName(part)
            kept = kept.select(*tables[name].columns)
        if removed is not None:
            done[name] = (kept, removed)
    return {n: (k.select(*tables[n].columns), r.select(*tables[n].columns)) for n, (k, r) in done.items()}


def purged(tables: dict[str, DataFrame], hosts: DataFrame, keys: tuple[Key, ...] = PURGE) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after suppliers (hosts: host) were erased, and (table, supplier_id, removed) of what went. Their rows in suppliers stay, emptied; users' own rows stay as they are."""
    suppliers = tables["suppliers"]
    gone = suppliers.join(hosts.select(F.lower("host").alias("_h")).distinct(), F.lower("host") == F.col("_h"), "left_semi").select("id")
    done = removal(tables, keys, "suppliers", gone, ("id",))
    out = dict(tables) | {n: kept for n, (kept, _) in done.items()}
    marked = suppliers.join(gone.withColumn("_gone", F.lit(True)), "id", "left")
    cell = {c: F.lit(None) for c in SCRUBBED} | {"item_count": F.lit(0), "slab_count": F.lit(0), "last_error": F.lit(REMOVED)}
    out["suppliers"] = marked.select(*(F.when(F.col("_gone"), cell[c].cast(suppliers.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in cell else F.col(c) for c in suppliers.columns))
    counted = [r.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(n).alias("table"), "supplier_id", "removed") for n, (_, r) in done.items() if n != "suppliers" and "supplier_id" in r.columns]
    return out, reduce(DataFrame.unionByName, counted)


def rescoped(tables: dict[str, DataFrame], scopes: DataFrame, keys: tuple[Key, ...] = RESCOPE) -> dict[str, DataFrame]:
    """The tables (suppliers, materials, slabs) with each confirmed storefront (scopes: host, material_type) cut to its type, its slabs following and its counts made anew. A scope that would leave no item is skipped."""
    suppliers, materials = tables["suppliers"], tables["materials"]
    asked = suppliers.select(F.col("id").alias("supplier_id"), "host").join(scopes.select("host", F.col("material_type").alias("_scope")), "host").select("supplier_id", "_scope")
    held = materials.where(F.coalesce("item_id", F.lit("")) != "").select("supplier_id", F.col("material_type").alias("_scope")).distinct()
    scoped = asked.join(held, ["supplier_id", "_scope"], "left_semi")
    gone = materials.join(scoped, "supplier_id").where(~F.col("material_type").eqNullSafe(F.col("_scope"))).select("supplier_id", "material_type").distinct()
    # a null type is no scope either: it goes with the others of its storefront
    typed = materials.withColumn("_type", F.coalesce("material_type", F.lit("")))
    done = removal({**tables, "materials": typed}, keys, "materials", gone.select("supplier_id", F.coalesce("material_type", F.lit("")).alias("_type")).distinct(), ("supplier_id", "_type"), scoped.select("supplier_id"))
    out = dict(tables) | {n: kept.select(*tables[n].columns) for n, (kept, _) in done.items()}
    return out | {"suppliers": recounted(suppliers, scoped.select("supplier_id"), {c: out[t] for c, t in (("item_count", "materials"), ("slab_count", "slabs")) if c in suppliers.columns and t in out})}


def recounted(suppliers: DataFrame, which: DataFrame, of: dict[str, DataFrame]) -> DataFrame:
    """suppliers with the counts of some (which: supplier_id) made anew: of: the table that a column counts."""
    out = suppliers.join(which.select(F.col("supplier_id").alias("id"), F.lit(True).alias("_again")).distinct(), "id", "left")
    for column, table in of.items():
        n = table.groupBy(F.col("supplier_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
        kind = suppliers.schema[column].dataType
        out = out.join(n, "id", "left").withColumn(column, F.when(F.col("_again"), F.coalesce("_n", F.lit(0)).cast(kind)).otherwise(F.col(column))).drop("_n")
    return out.select(*suppliers.columns)
