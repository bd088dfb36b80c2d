"""Queries of component assembly: orders of three statuses as plans, elevations and other occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import assembly
from tallyforge.plans.registry import query, table

SQL = """WITH plans AS (SELECT o_orderkey AS plan, o_custkey AS mt, o_orderkey % 25 AS sheet, substring(o_orderpriority, 1, 1) AS room, CASE WHEN o_totalprice > 200000 THEN 'big' END AS name FROM orders WHERE o_orderstatus = 'F'),
el AS (SELECT o_orderkey AS id, o_custkey * 3 + o_orderkey % 2 AS semantic, o_custkey AS mt, o_orderkey % 20 AS e_sheet, substring(o_orderpriority, 1, 1) AS e_room, CASE WHEN o_totalprice > 150000 THEN 'big' END AS e_name, o_totalprice > 300000 AS leader_backed FROM orders WHERE o_orderstatus = 'O'),
a AS (SELECT n_nationkey AS sheet, n_nationkey * 7 % 20 AS e_sheet FROM nation UNION SELECT n_nationkey, n_nationkey * 3 % 20 FROM nation), d AS (SELECT n_nationkey AS e_sheet, n_regionkey AS detail FROM nation),
met AS (SELECT plan, semantic FROM plans JOIN a USING (sheet) JOIN el USING (e_sheet, mt)), c AS (SELECT plan, count(DISTINCT semantic) AS groups, min(semantic) AS one FROM met GROUP BY plan),
led AS (SELECT plans.*, coalesce(groups, 0) AS groups, CASE WHEN groups = 1 THEN one END AS semantic FROM plans LEFT JOIN c USING (plan)),
free AS (SELECT DISTINCT semantic, mt FROM el WHERE leader_backed AND semantic NOT IN (SELECT semantic FROM led WHERE semantic IS NOT NULL)),
leads AS (SELECT 'p' || plan AS lead, mt, semantic, groups, room, name FROM led UNION ALL SELECT 'e' || semantic, mt, semantic, 1, NULL, NULL FROM free),
members AS (SELECT lead, l.mt, l.semantic, groups, id, e_sheet, e_room, e_name FROM leads l LEFT JOIN el ON el.semantic = l.semantic AND el.mt = l.mt),
traits AS (SELECT lead, mt, semantic, groups, id, e_room AS room, e_name AS name FROM members UNION ALL SELECT lead, mt, semantic, groups, NULL, room, name FROM leads),
base AS (SELECT lead, mt, semantic, groups, count(id) AS elevations, min(id) AS first_id, CASE WHEN count(DISTINCT room) = 1 THEN max(room) END AS room, CASE WHEN count(DISTINCT name) = 1 THEN max(name) END AS name FROM traits GROUP BY lead, mt, semantic, groups),
s AS (SELECT lead, string_agg(DISTINCT CAST(detail AS VARCHAR), ',' ORDER BY CAST(detail AS VARCHAR)) AS details FROM members JOIN d USING (e_sheet) GROUP BY lead)
SELECT 'component:' || substring(sha256('{"group":' || coalesce('"' || semantic || '"', 'null') || ',"lead":"' || lead || '","mt":"' || mt || '"}'), 1, 24) AS component, lead, mt, semantic, groups, elevations, first_id, room, name, coalesce(details, '') AS details FROM base LEFT JOIN s USING (lead)"""


@query(SQL)
def component_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G26."""
    o, nation, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation"), F.col("o_orderkey")
    room = F.substring("o_orderpriority", 1, 1).alias("room")
    plans = o.where("o_orderstatus = 'F'").select(k.alias("plan"), F.col("o_custkey").alias("mt"), (k % 25).alias("sheet"), room, F.when(F.col("o_totalprice") > 200_000, "big").alias("name"))
    elevations = o.where("o_orderstatus = 'O'").select(k.alias("id"), (F.col("o_custkey") * 3 + k % 2).alias("semantic"), F.col("o_custkey").alias("mt"), (k % 20).alias("sheet"), room, F.when(F.col("o_totalprice") > 150_000, "big").alias("name"), (F.col("o_totalprice") > 300_000).alias("leader_backed"))
    n = F.col("n_nationkey").cast("long")
    edges = [nation.select(F.lit(r).alias("relation"), n.alias("source"), t.cast("long").alias("target")) for r, t in (("plan_elevation", n * 7 % 20), ("plan_elevation", n * 3 % 20), ("elevation_detail", F.col("n_regionkey")))]
    return assembly.component_instances(plans, elevations, edges[0].unionByName(edges[1]).unionByName(edges[2]))
