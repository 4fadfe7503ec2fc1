"""The same product under several names: clusters, votes, aliases and mirrored storefronts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


#: Types that say that nobody knows.
WEAK = ("other", "natural stone", "")


def key_aggregates(materials: DataFrame) -> DataFrame:
    """(material_key, base, type, suppliers, slabs, listings, sample_id) of each key."""
    return materials.where(F.coalesce("material_key", F.lit("")) != "").groupBy("material_key").agg(
        F.count_distinct("supplier_id").alias("suppliers"), F.sum(F.coalesce("available_slabs", F.lit(0))).alias("slabs"), F.count(F.lit(1)).alias("listings"), F.min("id").alias("sample_id")
    ).withColumns({"base": F.regexp_extract("material_key", r"^(.*)\|", 1), "type": F.split_part("material_key", F.lit("|"), F.lit(-1))})


def conflict_clusters(materials: DataFrame, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """Keys whose base stands under two types or more, with the key to fold them into: the widest reach among strong types."""
    keys = key_aggregates(materials)
    base = Window.partitionBy("base")
    best = base.orderBy(F.col("type").isin(*weak).cast("int"), F.desc("suppliers"), F.desc("slabs"), "material_key")
    return keys.select("*", F.size(F.collect_set("type").over(base)).alias("types"), F.first("material_key").over(best).alias("canonical"), F.sum("suppliers").over(base).alias("reach")).where("types >= 2")


def landslides(clusters: DataFrame, times: float = 4) -> DataFrame:
    """Clusters whose canonical key has at least so many times the suppliers of all other keys together."""
    c = clusters.groupBy("base", "canonical").agg(
        F.sum(F.when(F.col("material_key") == F.col("canonical"), F.col("suppliers")).otherwise(0)).alias("winner"), F.sum(F.when(F.col("material_key") != F.col("canonical"), F.col("suppliers")).otherwise(0)).alias("rest")
    )
    return c.where((F.col("rest") > 0) & (F.col("winner") >= times * F.col("rest")))


def majority(rows: DataFrame, key: str, value: str, unknown: tuple[str, ...] = ("Other", "")) -> DataFrame:
    """(key, value, votes) of the strictly most frequent known value of each key; ties give none."""
    votes = rows.where(~F.coalesce(value, F.lit("")).isin(*unknown)).groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"))
    top = votes.withColumn("_top", F.max("votes").over(Window.partitionBy(key))).where("votes = _top")
    return top.withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_ties = 1").select(key, value, "votes")


def only_leader(rows: DataFrame, group: str, who: str, value: str) -> DataFrame:
    """(group, who, value) of each group's only best one; groups whose best value several share have none."""
    at = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"), F.min(who).alias(who))
    best = at.groupBy(group).agg(F.max(F.struct(value, "_c", who)).alias("_b"))
    return best.where("_b._c = 1").select(group, F.col(f"_b.{who}").alias(who), F.col(f"_b.{value}").alias(value))


def _followed(edges: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(alias_key, canonical_key, _last) with every chain followed to its end, by doubling; and what is left, which leads into cycles. _last: the greatest `order` on the way."""
    now = staged(edges.select("alias_key", "canonical_key", (order if order is not None else F.lit(0)).alias("_last")), "aliases")
    done, count = None, -1
    for round_ in range(64):
        step = now.select(F.col("alias_key").alias("_a"), F.col("canonical_key").alias("_c"), F.col("_last").alias("_l"))
        if done is not None:
            step = step.unionByName(done.select(F.col("alias_key").alias("_a"), F.col("canonical_key").alias("_c"), F.col("_last").alias("_l")))
        met = now.join(step, now["canonical_key"] == step["_a"], "left")
        met = staged(met.select("alias_key", F.coalesce("_c", "canonical_key").alias("canonical_key"), F.greatest("_last", "_l").alias("_last"), F.col("_c").isNull().alias("_ends")), "aliases")
        ended = met.where("_ends").drop("_ends")
        done = ended if done is None else done.unionByName(ended)
        now = met.where("not _ends").drop("_ends")
        left = now.count()
        # a chain that is longer still would have ended for one of its members; on cycles go on until all have been passed
        if not left or (left == count and (1 << round_) > left):
            break
        count = left
    return done, now


def resolve_aliases(edges: DataFrame) -> DataFrame:
    """(alias_key, canonical_key) with every chain followed to its end, however long; what leads into a cycle is dropped. Of several targets of one alias the smallest counts."""
    one = edges.where("alias_key <> canonical_key").groupBy("alias_key").agg(F.min("canonical_key").alias("canonical_key"))
    return _followed(one)[0].select("alias_key", "canonical_key")


def cycle_closers(edges: DataFrame, order: str) -> DataFrame:
    """(alias_key): on each cycle of edges (alias_key, canonical_key, one target each) the one with the greatest order."""
    left = _followed(edges, F.struct(F.col(order).alias("at"), F.col("alias_key").alias("key")))[1]
    on = left.select(F.col("canonical_key").alias("alias_key")).distinct()  # far enough along, everything is on a cycle
    return left.join(on, "alias_key", "left_semi").select(F.col("_last.key").alias("alias_key")).distinct()


def apply_aliases(materials: DataFrame, resolved: DataFrame) -> DataFrame:
    """materials under their canonical keys; resolved may have canonical_type, which, where there is one, takes the place of the type."""
    out = materials.join(resolved, F.col("material_key") == F.col("alias_key"), "left").withColumn("material_key", F.coalesce("canonical_key", "material_key"))
    if "canonical_type" in resolved.columns:
        out = out.withColumn("material_type", F.coalesce(F.nullif("canonical_type", F.lit("")), "material_type"))
    return out.select(*materials.columns)


def item_overlap(materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(a, b, token, shared, jaccard) of storefronts of one token, by the items that both list."""
    items = materials.select("supplier_id", "item_id").distinct()
    sizes = items.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"))
    tokened = items.join(suppliers.select(F.col("id").alias("supplier_id"), "token"), "supplier_id")
    x, y = tokened.alias("x"), tokened.alias("y")
    shared = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.item_id") == F.col("y.item_id")) & (F.col("x.supplier_id") < F.col("y.supplier_id"))).groupBy(F.col("x.supplier_id").alias("a"), F.col("y.supplier_id").alias("b"), F.col("x.token").alias("token")).agg(F.count(F.lit(1)).alias("shared"))
    return (
        shared.join(sizes.select(F.col("supplier_id").alias("a"), F.col("n").alias("_x")), "a")
        .join(sizes.select(F.col("supplier_id").alias("b"), F.col("n").alias("_y")), "b")
        .select("a", "b", "token", "shared", (F.col("shared") / (F.col("_x") + F.col("_y") - F.col("shared"))).alias("jaccard"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (a, b): root is the smallest node that can be reached. Labels are handed to neighbours and then followed, so rounds grow as the logarithm of the longest way."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both.unionByName(both.select("a", F.col("a").alias("b"))).distinct(), "edges")
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "roots")
    for _ in range(60):
        near = both.join(now, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
        up = now.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        met = near.join(up, F.col("root") == F.col("_n"), "left").select("node", F.least("root", F.coalesce("_up", "root")).alias("root"))
        after = staged(met.join(now.withColumnRenamed("root", "_was"), "node").select("node", "root", (F.col("root") != F.col("_was")).alias("moved")), "roots")
        now = after.drop("moved")
        if after.where("moved").limit(1).count() == 0:
            return now
    raise RuntimeError("components did not settle")


def mirror_pairs(materials: DataFrame, suppliers: DataFrame, overlap: float) -> DataFrame:
    """(a, b): storefronts of one token whose items' Jaccard similarity is at least `overlap`, as far as is needed to connect them.

    Storefronts with equal items are compared once. Of the others two can only be as similar if they
    share one of their rarest n - ceil(overlap * n) + 1 items, so that only those are joined, and whole
    lists of the few pairs that meet.
    """
    return _pairs(_listed(materials), suppliers, overlap)


def _listed(materials: DataFrame) -> DataFrame:
    """(supplier_id, item_id), distinct, written once: what lies before it may be a long plan, and it is read several times."""
    return staged(materials.where(F.coalesce("item_id", F.lit("")) != "").select("supplier_id", "item_id").distinct(), "listed")


def _pairs(listed: DataFrame, suppliers: DataFrame, overlap: float) -> DataFrame:
    token = suppliers.where(F.trim(F.coalesce(F.col("token").cast("string"), F.lit(""))) != "").select(F.col("id").alias("supplier_id"), F.lower(F.trim(F.col("token").cast("string"))).alias("token"))
    items = listed.join(token, "supplier_id")
    sets = items.groupBy("token", "supplier_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("item_id") % (1 << 40)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "item_id")).alias("h2"))
    same = staged(sets.withColumn("rep", F.min("supplier_id").over(Window.partitionBy("token", "n", "h1", "h2"))), "sets")
    equal = same.where("rep <> supplier_id").select(F.col("rep").alias("a"), F.col("supplier_id").alias("b"))
    own = staged(items.join(same.where("rep = supplier_id").select("supplier_id", "n"), "supplier_id"), "items")
    often = own.groupBy("token", "item_id").agg(F.count(F.lit(1)).alias("c"))
    rare = Window.partitionBy("supplier_id").orderBy("c", "item_id")  # items that nobody else has come first, and meet nobody
    ranked = own.join(often, ["token", "item_id"]).withColumn("_rn", F.row_number().over(rare))
    first = staged(ranked.where((F.col("_rn") <= F.col("n") - F.ceil(overlap * F.col("n") - 1e-9) + 1) & (F.col("c") > 1)).select("token", "item_id", "supplier_id", "n"), "first")
    x, y = (first.select("token", "item_id", F.col("supplier_id").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    met = x.join(y, ["token", "item_id"]).where("a < b").where((F.col("n_a") >= overlap * F.col("n_b")) & (F.col("n_b") >= overlap * F.col("n_a"))).select("a", "b", "n_a", "n_b").distinct()
    mine, theirs = (own.select(F.col("supplier_id").alias(c), F.col("item_id").alias("i")) for c in ("a", "b"))
    shared = met.join(mine, "a").join(theirs, ["b", "i"]).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("s"))
    return shared.where(F.col("s") / (F.col("n_a") + F.col("n_b") - F.col("s")) >= overlap).select("a", "b").unionByName(equal)


def canonical_hosts(members: DataFrame) -> DataFrame:
    """(cluster, canonical): of hosts (cluster, host, token, items) the one with most items, then the one whose first label is the token, then the first by name."""
    label = F.lower(F.split_part("host", F.lit("."), F.lit(1)))
    order = F.struct((-F.col("items")).alias("n"), (label != F.lower(F.col("token").cast("string"))).alias("other"), F.col("host").alias("host"))
    return members.groupBy("cluster").agg(F.min(order)["host"].alias("canonical"))


def mirrors(materials: DataFrame, suppliers: DataFrame, overrides: DataFrame | None = None, overlap: float = 0.98) -> DataFrame:
    """(host, mirror_of, source): storefronts that show another's catalog, computed or curated. overrides (host, canonical): curated answers, null for a storefront that is its own."""
    listed = _listed(materials)
    roots = components(_pairs(listed, suppliers, overlap))
    items = listed.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("items"))
    members = roots.join(suppliers.select(F.col("id").alias("node"), "host", "token"), "node").join(items, F.col("node") == F.col("supplier_id")).select(F.col("root").alias("cluster"), "host", "token", "items")
    found = members.join(canonical_hosts(members), "cluster").where("host <> canonical").select("host", F.col("canonical").alias("mirror_of"), F.lit("computed").alias("source"))
    if overrides is None:
        return found
    curated = overrides.where("canonical is not null").select("host", F.col("canonical").alias("mirror_of"), F.lit("curated").alias("source"))
    return found.join(overrides.select("host"), "host", "left_anti").unionByName(curated)


def mirror_report(found: DataFrame, materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    """found (host, mirror_of, source) with both names, both numbers of items and their overlap."""
    who = suppliers.select("id", "host", F.coalesce(F.nullif("company", F.lit("")), "host").alias("name"))
    pair = found.join(who.select(F.col("id").alias("a"), "host", F.col("name").alias("mirror_name")), "host", "left").join(
        who.select(F.col("id").alias("b"), F.col("host").alias("mirror_of"), F.col("name").alias("canonical_name")), "mirror_of", "left"
    )
    items = materials.where(F.coalesce("item_id", F.lit("")) != "").select("supplier_id", "item_id").distinct()
    size = items.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"))
    n = lambda side, name: size.select(F.col("supplier_id").alias(side), F.col("n").alias(name))
    both = pair.select("a", "b").join(items.select(F.col("supplier_id").alias("a"), "item_id"), "a").join(items.select(F.col("supplier_id").alias("b"), "item_id"), ["b", "item_id"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
    out = pair.join(n("a", "mirror_items"), "a", "left").join(n("b", "canonical_items"), "b", "left").join(both, ["a", "b"], "left")
    x, y, s = F.coalesce("mirror_items", F.lit(0)), F.coalesce("canonical_items", F.lit(0)), F.coalesce("s", F.lit(0))
    return out.select(
        F.col("host").alias("mirror_host"), "mirror_name", F.col("mirror_of").alias("canonical_host"), F.coalesce("canonical_name", "mirror_of").alias("canonical_name"), "source",
        F.when(x + y - s > 0, s / (x + y - s)).otherwise(0.0).alias("overlap"), x.alias("mirror_items"), y.alias("canonical_items"),
    )
