"""Queries of evidence, receipts and profiles on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import evidence
from tallyforge.plans.checkpoints import spread
from tallyforge.plans.registry import query, table


@query("""SELECT user_id, event_type, count(*) AS facts, array_to_string(list_sort(list_distinct(list(CAST(floor(value) AS BIGINT)))), ',') AS "values" FROM events GROUP BY ALL""")
def measurement_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    facts = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").cast("double").alias("v"))
    out = evidence.measurement_profile(facts, ["user_id", "event_type"], "v")
    return out.select("user_id", "event_type", "facts", F.array_join(F.transform("distinct_values", lambda x: x.cast("long").cast("string")), ",").alias("values"))


@query("""WITH o AS (SELECT o_custkey % 100 AS batch, o_orderstatus AS kind, count(*) AS observed FROM orders GROUP BY ALL), e AS (SELECT o_custkey % 100 AS batch, o_orderstatus AS kind, count(*) AS expected FROM orders WHERE o_totalprice < 490000 GROUP BY ALL),
j AS (SELECT coalesce(o.batch, e.batch) AS batch, coalesce(o.kind, e.kind) AS kind, coalesce(observed, 0) AS observed, coalesce(expected, 0) AS expected FROM o FULL JOIN e ON o.batch = e.batch AND o.kind = e.kind)
SELECT *, bool_or(observed <> expected) OVER (PARTITION BY batch) AS blocking FROM j""")
def receipt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("batch"), F.col("o_orderstatus").alias("kind"), "o_totalprice")
    return evidence.receipt_check(rows, rows.where("o_totalprice < 490000"), "batch", "kind")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'plain' ELSE json_extract_string(props, '$.k') END AS k, CAST(NULL AS VARCHAR) AS z FROM events""")
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, C1."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, " plain ").otherwise(F.col("props")).alias("raw"))
    return evidence.normalised_records(rows, "raw", {"k": ["key", "name"], "z": []})


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'UNIQUE' ELSE 'NONE' END AS state, CASE WHEN p_partkey % 3 > 0 THEN 1.0::DOUBLE END AS thickness, CASE WHEN p_partkey % 3 > 0 THEN round(2.0::DOUBLE * (p_size + 10) + 4, 6) END AS centre_length FROM part""")
def strip_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: angle profiles of part sizes."""
    w = (F.col("p_size") + 10).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, one = F.lit(0.0), F.lit(1.0)
    angle = F.array(point(zero, zero), point(w, zero), point(w, one), point(one, one), point(one, w + 5), point(zero, w + 5))
    plate = F.array(point(zero, zero), point(w, zero), point(w, w), point(zero, w))
    s = evidence.strip_profile(F.when(F.col("p_partkey") % 3 > 0, angle).otherwise(plate))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", s.alias("s")).select("p_partkey", "s.state", F.round("s.thickness", 6).alias("thickness"), F.round("s.centre_length", 6).alias("centre_length"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber AS profile_id, l_suppkey % 50 AS g, l_returnflag = 'A' AS supported, CASE WHEN l_tax > 0.07 THEN 'tax' END AS issue, l_suppkey % 50 = 7 AND l_linenumber = 7 AS truncated FROM lineitem),
t AS (SELECT g, bool_or(truncated) AS cut FROM c GROUP BY g), p AS (SELECT l_orderkey, count(*) FILTER (WHERE supported) AS n, min(profile_id) FILTER (WHERE supported) AS p, count(issue) AS issues, bool_or(cut) AS cut FROM c JOIN t USING (g) GROUP BY l_orderkey),
s AS (SELECT *, CASE WHEN cut THEN 'truncated' WHEN issues > 0 THEN 'issue' WHEN n = 1 THEN 'selected' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS state FROM p)
SELECT l_orderkey, state, CASE WHEN state = 'selected' THEN p END AS profile_id FROM s""")
def selected_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2."""
    g = F.col("l_suppkey") % 50
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("profile_id"), g.alias("group"), (F.col("l_returnflag") == "A").alias("supported"), F.when(F.col("l_tax") > 0.07, "tax").alias("issue"), ((g == 7) & (F.col("l_linenumber") == 7)).alias("truncated"))
    return evidence.selected_profiles(rows, "l_orderkey")


@query("""WITH p AS (SELECT c_custkey AS point_id, c_nationkey AS scope, c_acctbal AS x, CAST(c_custkey % 90 AS DOUBLE) AS y FROM customer), v AS (SELECT s_suppkey AS view_id, s_nationkey AS scope, s_acctbal - 1500 AS x0, s_acctbal + 1500 AS x1, 0 AS y0, s_suppkey % 90 AS y1 FROM supplier),
h AS (SELECT point_id, count(*) AS n, min(view_id) AS v, string_agg(CAST(view_id AS VARCHAR), ',' ORDER BY CAST(view_id AS VARCHAR)) AS views FROM p JOIN v USING (scope) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY point_id)
SELECT scope, point_id, CASE WHEN n = 1 THEN v END AS owner, coalesce(views, '') AS views, CASE WHEN n IS NULL THEN 'outside' WHEN n > 1 THEN 'several' END AS issue FROM p LEFT JOIN h USING (point_id)""")
def owned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7."""
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("scope"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 90).cast("double").alias("y"))
    views = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view_id"), F.col("s_nationkey").alias("scope"), (F.col("s_acctbal") - 1500).alias("x0"), (F.col("s_acctbal") + 1500).alias("x1"), F.lit(0.0).alias("y0"), (F.col("s_suppkey") % 90).cast("double").alias("y1"))
    return evidence.owned_points(points, views, ["scope"])


@query("""WITH a AS (SELECT page_id, md5(html) AS d FROM pages ), b AS (SELECT page_id, CASE WHEN length(html) > 1500 THEN md5(url) ELSE md5(html) END AS d FROM pages UNION ALL SELECT page_id + 1000000000, md5(url) FROM pages WHERE contains(url, '7'))
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.d IS NULL THEN 'new' WHEN b.d IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.d IS DISTINCT FROM b.d""")
def artefact_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9, X9, S4."""
    pages = table(spark, sf_dir, "pages")
    now = pages.select("page_id", F.when(F.length("html") > 1500, F.md5("url")).otherwise(F.md5("html")).alias("d"))
    fresh = pages.where(F.col("url").contains("7")).select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.md5("url").alias("d"))
    return evidence.drift(pages.select("page_id", F.md5("html").alias("d")), now.unionByName(fresh), "page_id", "d")


@query("""SELECT s.s_suppkey, s.s_name, coalesce(f.bal, s.s_acctbal) AS s_acctbal FROM supplier s LEFT JOIN (SELECT s_suppkey, abs(s_acctbal) AS bal FROM supplier WHERE s_acctbal < 0) f USING (s_suppkey)""")
def frame_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10."""
    index = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return evidence.refreshed(index, index.where("s_acctbal < 0").withColumn("s_acctbal", F.abs("s_acctbal")), "s_suppkey", ["s_acctbal"])


@query("""WITH p AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS pn, min(o_orderpriority) AS pv FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), e AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS en, min(o_orderpriority) AS ev FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey),
j AS (SELECT o_custkey, pn, en, pv, ev FROM p FULL JOIN e USING (o_custkey)),
b AS (SELECT o_custkey, pv, concat_ws(',', CASE WHEN coalesce(pn, 0) = 0 THEN 'plan_missing' END, CASE WHEN coalesce(en, 0) = 0 THEN 'elevation_missing' END, CASE WHEN pn > 1 THEN 'plan_conflict' END, CASE WHEN en > 1 THEN 'elevation_conflict' END, CASE WHEN pn = 1 AND en = 1 AND pv <> ev THEN 'disagree' END) AS blockers FROM j)
SELECT o_custkey, blockers, CASE WHEN blockers = '' THEN pv END AS variant FROM b""")
def variant_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("variant"), "o_orderstatus")
    return evidence.variant_binding(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"), "o_custkey")


@query("""WITH d AS (SELECT l_orderkey AS c, 'plan' AS stage, l_suppkey AS sheet FROM lineitem WHERE l_linenumber % 2 = 1), k AS (SELECT l_orderkey AS c, 'detail' AS stage, l_partkey % 50 AS sheet FROM lineitem WHERE l_linenumber % 2 = 0),
e AS (SELECT s_suppkey AS source, (s_suppkey * 3) % 50 AS target, 'detail' AS stage FROM supplier WHERE s_acctbal > 0),
u AS (SELECT c, stage, sheet, 0 AS o FROM d UNION ALL SELECT c, e.stage, target, 1 FROM d JOIN e ON source = sheet UNION ALL SELECT c, stage, sheet, 2 FROM k), b AS (SELECT c, stage, sheet, min(o) AS o FROM u GROUP BY ALL)
SELECT c, stage, sheet, ['explicit', 'relation', 'material_code'][o + 1] AS origin, CAST(row_number() OVER (PARTITION BY c, stage ORDER BY o, sheet) AS INT) AS rank FROM b""")
def stage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2."""
    lines = table(spark, sf_dir, "lineitem")
    direct = lines.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("c"), F.lit("plan").alias("stage"), F.col("l_suppkey").alias("sheet"))
    code = lines.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("c"), F.lit("detail").alias("stage"), (F.col("l_partkey") % 50).alias("sheet"))
    edges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") * 3 % 50).alias("target"), F.lit("detail").alias("stage"), F.when(F.col("s_acctbal") > 0, "PASS").otherwise("REVIEW").alias("status"))
    return evidence.stage_candidates(direct, code, edges, "c")


@query("""WITH a AS (SELECT o_orderkey AS k, ['screen', 'panel', 'other'][o_orderkey % 3 + 1] AS kind FROM orders), m AS (SELECT l_orderkey AS k, l_returnflag AS role, count(*) AS n, bool_and(l_linestatus = 'F') AS ok FROM lineitem GROUP BY ALL),
r AS (SELECT k, kind, unnest(CASE kind WHEN 'screen' THEN ['A', 'R'] WHEN 'panel' THEN ['N'] ELSE [NULL] END) AS role FROM a),
j AS (SELECT r.k, min(CASE WHEN r.role IS NULL THEN '0:unknown_kind' WHEN n IS NULL THEN '1:missing:' || r.role WHEN n > 1 THEN '2:several:' || r.role WHEN NOT ok THEN '3:not_pass:' || r.role END) AS w FROM r LEFT JOIN m ON m.k = r.k AND m.role = r.role GROUP BY r.k)
SELECT k, substring(w, 3) AS reason FROM j""")
def composite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3."""
    kinds = F.array(*map(F.lit, ("screen", "panel", "other")))
    assemblies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.get(kinds, (F.col("o_orderkey") % 3).cast("int")).alias("kind"))
    materials = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("role"), F.when(F.col("l_linestatus") == "F", "PASS").otherwise("REVIEW").alias("status"))
    return evidence.composite_check(assemblies, materials, "k", {"screen": ["A", "R"], "panel": ["N"]}, "kind")
