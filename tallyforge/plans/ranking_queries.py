"""Queries of ranking, intervals, spatial joins, components and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.numeric import binary_round
from tallyforge.operators import graphs, ranking, spatial
from tallyforge.plans.registry import query, table


@query("""
WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_discount > 0.01 THEN l_quantity END AS distance, l_tax,
  row_number() OVER (PARTITION BY l_partkey ORDER BY (CASE WHEN l_discount > 0.01 THEN l_quantity END) IS NULL, CASE WHEN l_discount > 0.01 THEN l_quantity END, l_tax DESC, l_orderkey, l_linenumber) AS rank,
  count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, distance, CAST(rank AS INT) AS rank, CASE WHEN n > 24 THEN 'candidate_pool_truncated:' || n || '->24' END AS note FROM r WHERE rank <= 24""")
def topk_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W9."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_tax", F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("distance"))
    order = [F.asc_nulls_last("distance"), F.desc("l_tax"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return ranking.top_candidates(lines, ["l_partkey"], order).drop("l_tax")


@query("""
WITH r AS (SELECT user_id, event_type, value, round(value / 100, 2) AS score, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY round(value / 100, 2) DESC, event_id) AS r FROM events),
t AS (SELECT user_id, event_type, max(CASE WHEN r = 1 THEN value END) AS v1, max(CASE WHEN r = 2 THEN value END) AS v2, max(CASE WHEN r = 1 THEN score END) AS s1, max(CASE WHEN r = 2 THEN score END) AS s2 FROM r WHERE r <= 2 GROUP BY ALL),
a AS (SELECT *, coalesce(v2 IS NOT NULL AND abs(v1 - v2) > 1e-9 * greatest(abs(v1), abs(v2)) AND s1 - s2 < 0.12, false) AS ambiguous FROM t)
SELECT user_id, event_type, CASE WHEN NOT ambiguous THEN v1 END AS chosen, ambiguous FROM a""")
def ambiguous_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", binary_round(F.col("value") / 100, 2).alias("score"))
    return ranking.clear_best(events, ["user_id", "event_type"], "value", "score", "event_id")


@query("""
WITH b AS (SELECT l_suppkey, l_returnflag AS v, max(l_tax * 10) AS s FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, v) AS r FROM b),
t AS (SELECT l_suppkey, max(CASE WHEN r = 1 THEN v END) AS v, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2 FROM r GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN s1 >= 0.72 AND (s2 IS NULL OR s1 - s2 >= 0.05) THEN v END AS picked, s1 AS best_score FROM t""")
def automatic_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_tax") * 10).alias("score"))
    return ranking.automatic_pick(lines, ["l_suppkey"], "l_returnflag", "score")


_SPANS = "spans AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events)"
_ISLANDS = f"""{_SPANS},
m AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS n FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
islands AS (SELECT user_id, CAST(island AS BIGINT) AS island, min(a) AS a, max(b) AS b, count(*) AS parts FROM i GROUP BY ALL)"""


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("user_id", start.alias("a"), (start + 3_600_000_000).alias("b"))
    return ranking.merged_intervals(spans, ["user_id"], "a", "b")


@query(f"WITH {_ISLANDS} SELECT * FROM islands")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    return _islands(spark, sf_dir)


@query(f"WITH {_ISLANDS}, g AS (SELECT user_id, b AS gap_start, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS gap_end FROM islands) SELECT * FROM g WHERE gap_end IS NOT NULL")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    return ranking.interval_gaps(_islands(spark, sf_dir), ["user_id"], "a", "b")


@query("""
WITH s AS (SELECT o_custkey, CAST(epoch_us(o_orderdate) // 86400000000 AS DOUBLE) AS a, CAST(epoch_us(o_orderdate) // 86400000000 + 30 + o_orderkey % 60 AS DOUBLE) AS b FROM orders),
c AS (SELECT *, a - lag(b) OVER (PARTITION BY o_custkey ORDER BY a, b) AS step FROM s),
g AS (SELECT o_custkey, count(*) AS parts, CASE WHEN bool_or(step < -100.0) THEN 'overlap' WHEN bool_or(step > 100.0) THEN 'gap' END AS reason, sum(b - a) AS t FROM c GROUP BY o_custkey)
SELECT o_custkey, parts, reason, CASE WHEN reason IS NULL THEN t END AS total FROM g""")
def chain_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    day = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 86400000000")
    spans = table(spark, sf_dir, "orders").select("o_custkey", day.cast("double").alias("a"), (day + 30 + F.col("o_orderkey") % 60).cast("double").alias("b"))
    return ranking.chain_lengths(spans, ["o_custkey"], "a", "b", tolerance=100.0)


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("scope"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97 * 50).cast("double").alias("y"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("scope"), F.col("s_acctbal").alias("sx"), (F.col("s_suppkey") % 97 * 50).cast("double").alias("sy"))
    return customers, suppliers


_POINTS = """c AS (SELECT c_custkey, c_nationkey AS scope, c_acctbal AS x, CAST(c_custkey % 97 * 50 AS DOUBLE) AS y FROM customer),
s AS (SELECT s_suppkey, s_nationkey AS scope, s_acctbal AS sx, CAST(s_suppkey % 97 * 50 AS DOUBLE) AS sy FROM supplier)"""


@query(f"WITH {_POINTS} SELECT c_custkey, s_suppkey, round(sqrt((x - sx) ** 2 + (y - sy) ** 2), 6) AS distance FROM c JOIN s USING (scope) WHERE sqrt((x - sx) ** 2 + (y - sy) ** 2) <= 900")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    c, s = _points(spark, sf_dir)
    return spatial.within_radius(c, s, ["scope"], 900.0, right_xy=("sx", "sy")).select("c_custkey", "s_suppkey", binary_round("distance", 6).alias("distance"))


@query(f"""WITH {_POINTS}, p AS (SELECT c_custkey, s_suppkey, sqrt((x - sx) ** 2 + (y - sy) ** 2) AS d FROM c JOIN s USING (scope) WHERE sqrt((x - sx) ** 2 + (y - sy) ** 2) <= 900),
b AS (SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, min(d) AS d, count(*) AS within FROM p GROUP BY c_custkey)
SELECT c_custkey, s_suppkey, round(d, 6) AS distance, coalesce(within, 0) AS within FROM c LEFT JOIN b USING (c_custkey)""")
def nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, J19."""
    c, s = _points(spark, sf_dir)
    out = spatial.nearest(c, s, ["scope"], 900.0, "c_custkey", "s_suppkey", right_xy=("sx", "sy"))
    return out.select("c_custkey", "s_suppkey", binary_round("distance", 6).alias("distance"), "within")


_BOXES = "boxes AS (SELECT s_suppkey, scope, sx - 400 - s_suppkey % 7 * 100 AS x0, sx + 600 AS x1, sy - 500 AS y0, sy + 700 + s_suppkey % 3 * 100 AS y1 FROM s)"


def _boxes(s: DataFrame) -> DataFrame:
    return s.select("s_suppkey", "scope", F.expr("sx - 400 - s_suppkey % 7 * 100").alias("x0"), F.expr("sx + 600").alias("x1"), F.expr("sy - 500").alias("y0"), F.expr("sy + 700 + s_suppkey % 3 * 100").alias("y1"))


@query(f"""WITH {_POINTS}, {_BOXES}, b AS (SELECT c_custkey, arg_min(s_suppkey, ((x1 - x0) * (y1 - y0), s_suppkey)) AS s_suppkey, min((x1 - x0) * (y1 - y0)) AS area FROM c JOIN boxes USING (scope) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY c_custkey)
SELECT c_custkey, s_suppkey, round(area, 3) AS area FROM c LEFT JOIN b USING (c_custkey)""")
def smallest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    c, s = _points(spark, sf_dir)
    return spatial.smallest_box(c, _boxes(s), ["scope"], 1000.0, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", binary_round("area", 3).alias("area"))


@query(f"""WITH {_POINTS}, {_BOXES}, b AS (SELECT c_custkey, count(*) FILTER (WHERE x0 < x AND x < x1 AND y0 < y AND y < y1) AS owners, count(*) FILTER (WHERE NOT (x0 < x AND x < x1 AND y0 < y AND y < y1)) AS contacts,
  min(s_suppkey) FILTER (WHERE x0 < x AND x < x1 AND y0 < y AND y < y1) AS s_suppkey FROM c JOIN boxes USING (scope) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY c_custkey),
t AS (SELECT c_custkey, CASE WHEN owners IS NULL THEN 'none' WHEN contacts > 0 THEN 'contact' WHEN owners > 1 THEN 'ambiguous' ELSE 'owned' END AS state, s_suppkey FROM c LEFT JOIN b USING (c_custkey))
SELECT c_custkey, state, CASE WHEN state = 'owned' THEN s_suppkey END AS s_suppkey FROM t""")
def unique_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, F2."""
    c, s = _points(spark, sf_dir)
    return spatial.unique_owner(c, _boxes(s), ["scope"], 1000.0, "c_custkey", "s_suppkey").select("c_custkey", "state", "s_suppkey")


@query("""WITH o AS (SELECT c_custkey AS id, c_nationkey AS scope, c_acctbal AS x, CAST(c_custkey % 50 * 1000 AS DOUBLE) AS y, CAST(c_custkey % 9 * 400 AS DOUBLE) AS h FROM customer),
f AS (SELECT s_suppkey AS frame_id, s_nationkey AS scope, s_name AS code, s_acctbal AS fx, CAST(s_suppkey % 50 * 1000 AS DOUBLE) AS fy FROM supplier),
b AS (SELECT id, arg_min(code, (abs(y - fy), abs(x - fx), frame_id)) AS code, arg_min(frame_id, (abs(y - fy), abs(x - fx), frame_id)) AS frame_id FROM o JOIN f USING (scope) WHERE abs(y - fy) <= greatest(5000.0, 2 * h) GROUP BY id)
SELECT id, code, frame_id FROM o LEFT JOIN b USING (id)""")
def inherited_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    orphans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("scope"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 50 * 1000).cast("double").alias("y"), (F.col("c_custkey") % 9 * 400).cast("double").alias("h"))
    frames = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.col("s_nationkey").alias("scope"), F.col("s_name").alias("code"), F.col("s_acctbal").alias("fx"), (F.col("s_suppkey") % 50 * 1000).cast("double").alias("fy"))
    return spatial.inherited_code(orphans, frames, ["scope"]).select("id", "code", "frame_id")


@query("""WITH h AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS component FROM documents) SELECT doc_id AS id, component FROM h""")
def text_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text, linked to the first of them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.max("id").alias("b"))
    return graphs.components(docs, docs.join(first, "h").select(F.col("id").alias("a"), "b"))


@query("""WITH g AS (SELECT o_custkey AS component, sum(o_orderkey % 100) AS length, min(o_orderkey % 17) AS x0, min(o_orderkey % 19) AS y0, max(o_orderkey % 17) AS x1, max(o_orderkey % 19) AS y1,
  array_to_string(list_sort(list(o_orderkey)), ',') AS members, bool_or(o_orderstatus = 'P') AS approximate, max(o_orderkey % 5) AS tolerance FROM orders GROUP BY o_custkey) SELECT * REPLACE (CAST(length AS BIGINT) AS length) FROM g""")
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    k = F.col("o_orderkey")
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("component"), k.alias("id"), (k % 100).alias("length"), (k % 17).alias("x0"), (k % 19).alias("y0"), (k % 17).alias("x1"), (k % 19).alias("y1"), (F.col("o_orderstatus") == "P").alias("approximate"), (k % 5).alias("tolerance"))
    return graphs.path_summary(parts)


@query("""WITH a AS (SELECT o_custkey AS scope, o_orderkey AS edge_id, o_orderkey AS target FROM orders), b AS (SELECT l_partkey * 1000 + l_suppkey AS edge2_id, l_orderkey AS source FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0.1),
c AS (SELECT scope, count(*) AS chains, min((edge_id, edge2_id)) AS m FROM a JOIN b ON target = source GROUP BY scope)
SELECT scope, coalesce(chains, 0) AS chains, CASE WHEN chains = 1 THEN m[1] END AS edge_id, CASE WHEN chains = 1 THEN m[2] END AS edge2_id, CASE WHEN chains = 1 THEN 'PASS' WHEN chains > 1 THEN 'REVIEW' ELSE 'BLOCK' END AS status FROM (SELECT DISTINCT scope FROM a) LEFT JOIN c USING (scope)""")
def chain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23."""
    first = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("edge_id"), F.col("o_orderkey").alias("target"))
    second = table(spark, sf_dir, "lineitem").where("l_tax = 0.08 and l_discount = 0.1").select(F.expr("l_partkey * 1000 + l_suppkey").alias("edge2_id"), F.col("l_orderkey").alias("source"))
    return graphs.coherent_chains(first, second, "scope")


@query("""WITH a AS (SELECT doc_id, quality AS v FROM labels), b AS (SELECT doc_id, toxic AS v FROM labels)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3."""
    labels = table(spark, sf_dir, "labels")
    return graphs.multiset_difference(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1."""
    return graphs.id_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH r AS (SELECT url, md5(html) AS content FROM pages UNION ALL SELECT url, CASE WHEN length(html) > 1500 THEN 'changed' ELSE md5(html) END FROM pages WHERE contains(url, '3'))
SELECT url, count(*) AS copies, CASE WHEN count(DISTINCT content) <= 1 THEN min(content) END AS content, count(DISTINCT content) > 1 AS conflict FROM r GROUP BY url""")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G23."""
    pages = table(spark, sf_dir, "pages")
    second = pages.where(F.col("url").contains("3")).select("url", F.when(F.length("html") > 1500, "changed").otherwise(F.md5("html")).alias("content"))
    return graphs.merge_shards([pages.select("url", F.md5("html").alias("content")), second], "url", "content")


@query("""WITH e AS (SELECT label, CAST(label * 40 AS DOUBLE) AS expected FROM (SELECT DISTINCT label FROM embeddings)), v AS (SELECT label, CAST(vec_id % 500 AS DOUBLE) AS value FROM embeddings),
m AS (SELECT label, expected, count(value) AS candidates, min((abs(value - expected), value)) AS m FROM e LEFT JOIN v USING (label) GROUP BY ALL)
SELECT label, expected, candidates, m[2] AS closest, coalesce(m[1] <= greatest(1.0, abs(expected) * 0.05), false) AS hit FROM m""")
def recall_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16."""
    vectors = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 500).cast("double").alias("value"))
    expected = vectors.select("label").distinct().withColumn("expected", (F.col("label") * 40).cast("double"))
    return ranking.recall_probe(expected, vectors, ["label"])
