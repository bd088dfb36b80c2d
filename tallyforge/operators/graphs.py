"""Components and summaries of endpoint graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.plans.checkpoints import cut


#: Edges of a node from which its least neighbour is broadcast. There are at most 2 * edges / HUB such nodes.
HUB = 100_000


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least v of their u: a grouped minimum, joined back; to the edges of hubs by broadcast, so that none of them is gathered in one task.

    ``few`` says that there are at most HUB edges, so that no node can be a hub: then it is a window, in one shuffle and no job of its own.
    The joins are merge joins by hint: Spark takes what an explode made of a narrow table for as small as that table, and would broadcast all minima.
    """
    if few:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hubs = least.where(F.col("n") > HUB).select("u", "m")
    if hubs.isEmpty():
        return edges.join(least.select("u", "m").hint("merge"), "u")
    hubs = F.broadcast(hubs)
    others = edges.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m").hint("merge"), "u")
    return others.unionByName(edges.join(hubs, "u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long): root is the least node of its component.

    Each step replaces every edge by one from its far end to the least neighbour of its near end; the result of a step is checkpointed, so a graph without hubs takes two executions a step.
    Neither the grouped minima nor the joins gather a hub in one task.
    Loops, repeated edges and nulls are allowed: a loop gives (node, node), an edge with a null is ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = 2 * mark[0] <= HUB
        large = _with_least(both, few).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large if few else cut(large.distinct()), few)
        moved = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = cut(moved.where("u <> v").distinct())
        now = _mark(links)
        if now == mark:
            break
        mark = now
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("root").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Size and an order-free checksum of the links; equal marks of two steps mean that nothing moved."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(id, component): the least id that is reachable over ``edges`` (a, b); nodes without edges are their own."""
    roots = connected_components(edges).withColumnsRenamed({"node": node, "root": "component"})
    return nodes.select(node).distinct().join(roots, node, "left").select(node, F.coalesce("component", node).alias("component"))


def path_summary(parts: DataFrame, component: str = "component") -> DataFrame:
    """Per component its length, box, members, whether any part is approximate, and the worst tolerance."""
    return parts.groupBy(component).agg(
        F.sum("length").alias("length"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"), F.bool_or("approximate").alias("approximate"), F.max("tolerance").alias("tolerance"),
    )


def coherent_chains(first: DataFrame, second: DataFrame, scope: str) -> DataFrame:
    """Per scope its two-step chains source -> target -> end that are whole, and the chain itself if there is exactly one.

    ``first`` has scope, edge_id and target; ``second`` has edge2_id, source and end. Several chains give REVIEW, none BLOCK.
    """
    pairs = first.join(second, first["target"] == second["source"])
    counted = pairs.groupBy(scope).agg(F.count("*").alias("chains"), F.min(F.struct("edge_id", "edge2_id")).alias("c"))
    out = first.select(scope).distinct().join(counted, scope, "left").withColumn("chains", F.coalesce("chains", F.lit(0)))
    one = F.col("chains") == 1
    return out.select(scope, "chains", F.when(one, F.col("c.edge_id")).alias("edge_id"), F.when(one, F.col("c.edge2_id")).alias("edge2_id"), F.when(one, "PASS").when(F.col("chains") > 1, "REVIEW").otherwise("BLOCK").alias("status"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other hasn't as often, with the side; none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each id of either side and where it is: both, left or right."""
    joined = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full_outer")
    return joined.select(key, F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both").alias("side"))


def merge_shards(shards: list[DataFrame], key: str, content: str) -> DataFrame:
    """The union of shards: one row a key, how many shards' rows it has, and whether their contents conflict."""
    rows = shards[0].select(key, content)
    for s in shards[1:]:
        rows = rows.unionByName(s.select(key, content))
    merged = rows.groupBy(key).agg(F.count("*").alias("copies"), F.count_distinct(content).alias("contents"), F.min(content).alias(content))
    return merged.select(key, "copies", F.when(F.col("contents") <= 1, F.col(content)).alias(content), (F.col("contents") > 1).alias("conflict"))
