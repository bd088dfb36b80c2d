"""Queries of order-dependent grouping, geometry and assembled takeoffs on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import boxes
from tallyforge.functions.numeric import binary_round, display_value
from tallyforge.functions.text import excel_safe
from tallyforge.operators import geometry, pricing, rules, sequential
from tallyforge.plans.pricing_queries import CALC_SQL, items, prices
from tallyforge.plans.registry import query, table
from tallyforge.sources import sinks


@query("""WITH RECURSIVE v AS (SELECT user_id, event_type, round(value, 2) AS x, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY x) AS k FROM v),
c AS (SELECT user_id, event_type, k, 0 AS cluster, x * n AS total, n AS size, low, high FROM r WHERE k = 1
  UNION ALL SELECT r.user_id, r.event_type, r.k, CASE WHEN j THEN cluster ELSE cluster + 1 END, CASE WHEN j THEN total + r.x * r.n ELSE r.x * r.n END, CASE WHEN j THEN size + r.n ELSE r.n END, CASE WHEN j THEN least(c.low, r.low) ELSE r.low END, CASE WHEN j THEN greatest(c.high, r.high) ELSE r.high END
  FROM (SELECT *, k + 1 AS nxt, total / size AS mean FROM c) c JOIN r ON r.user_id = c.user_id AND r.event_type = c.event_type AND r.k = nxt, LATERAL (SELECT abs(r.x - mean) <= greatest(2.0, 0.005 * abs(mean)) AS j))
SELECT user_id, event_type, CAST(cluster AS INT) AS cluster, arg_max(total / size, k) AS center, CAST(max(size) AS BIGINT) AS size, arg_max(low <> high, k) AS corroborated FROM c GROUP BY user_id, event_type, cluster""")
def value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", binary_round("value", 2).alias("value"), "event_id")
    return sequential.cluster_values(events, ["user_id", "event_type"], "value", "event_id")


@query("""WITH RECURSIVE e AS (SELECT event_type, user_id AS sheet, event_id AS id, list_sort([CAST(event_id % 3 AS VARCHAR), CAST(event_id % 5 AS VARCHAR)]) AS ev, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 8 AS VARCHAR) END AS leader, floor(value) AS x, CAST(event_id % 7 AS DOUBLE) AS y, floor(value) / 100 AS conf FROM events),
r AS (SELECT * REPLACE (list_sort(list_distinct(ev)) AS ev), row_number() OVER (PARTITION BY event_type, sheet ORDER BY id) AS k FROM e),
c AS (SELECT event_type, sheet, k, [{'id': id, 'conf': conf, 'ev': ev, 'leader': leader, 'x': x, 'y': y, 'merged': 1}] AS kept FROM r WHERE k = 1
  UNION ALL SELECT r.event_type, r.sheet, r.k, CASE WHEN p IS NULL OR p = 0 THEN list_append(kept, {'id': r.id, 'conf': r.conf, 'ev': r.ev, 'leader': r.leader, 'x': r.x, 'y': r.y, 'merged': 1})
    ELSE list_transform(kept, lambda q, i: CASE WHEN i = p THEN {'id': CASE WHEN r.conf > q.conf OR (r.conf = q.conf AND r.id < q.id) THEN r.id ELSE q.id END, 'conf': greatest(q.conf, r.conf), 'ev': list_sort(list_distinct(list_concat(q.ev, r.ev))), 'leader': q.leader, 'x': q.x, 'y': q.y, 'merged': q.merged + 1} ELSE q END) END
  FROM (SELECT *, k + 1 AS nxt FROM c) c JOIN r ON r.event_type = c.event_type AND r.sheet = c.sheet AND r.k = nxt,
    LATERAL (SELECT list_position(list_transform(kept, lambda q: q.ev = r.ev OR coalesce(q.leader = r.leader, false) OR (abs(q.x - r.x) <= 1e-6 AND abs(q.y - r.y) <= 1e-6)), true) AS p)),
l AS (SELECT event_type, sheet, arg_max(kept, k) AS kept FROM c GROUP BY ALL), u AS (SELECT event_type, sheet, unnest(kept) AS q FROM l)
SELECT event_type, sheet, q.id AS id, q.conf AS confidence, CAST(q.merged AS BIGINT) AS merged, array_to_string(q.ev, ',') AS evidence FROM u""")
def merged_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("sheet"), k.alias("id"), F.array((k % 3).cast("string"), (k % 5).cast("string")).alias("evidence"), F.when(k % 4 == 0, (k % 8).cast("string")).alias("leader"), F.floor(F.col("value")).cast("double").alias("x"), (k % 7).cast("double").alias("y"), (F.floor("value") / 100).alias("confidence"))
    out = sequential.merge_occurrences(rows, ["event_type", "sheet"])
    return out.withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS mt, o_orderkey AS id, o_orderkey % 6 AS sheet, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS room, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 5 AS VARCHAR) END AS name, o_orderpriority AS title, o_orderkey % 2 AS source, o_orderkey % 11 AS drawing FROM orders),
b AS (SELECT mt, id, sheet, 1 AS pass, 0 AS s, 0 AS d, title AS v, '' AS w FROM o UNION ALL SELECT mt, id, sheet, 2, source, 0, room, name FROM o WHERE room IS NOT NULL AND name IS NOT NULL UNION ALL SELECT mt, id, sheet, 3, source, drawing, name, '' FROM o WHERE name IS NOT NULL),
g AS (SELECT mt, pass, s, d, v, w FROM b GROUP BY ALL HAVING count(DISTINCT sheet) > 1),
p AS (SELECT b.*, lag(id) OVER (PARTITION BY mt, pass, s, d, v, w ORDER BY id) AS before FROM b JOIN g USING (mt, pass, s, d, v, w)),
q AS (SELECT *, row_number() OVER (PARTITION BY mt ORDER BY pass, s, d, v, w, id) AS k FROM p WHERE before IS NOT NULL),
n AS (SELECT mt, list({'id': id, 'root': id, 'rooms': CASE WHEN room IS NULL THEN [] ELSE [room] END, 'names': CASE WHEN name IS NULL THEN [] ELSE [name] END}) AS nodes FROM o GROUP BY mt),
c AS (SELECT mt, CAST(0 AS BIGINT) AS k, nodes FROM n
  UNION ALL SELECT c.mt, q.k, CASE WHEN x.root = y.root OR (len(x.rooms) > 0 AND len(y.rooms) > 0 AND NOT list_has_any(x.rooms, y.rooms)) OR (len(x.names) > 0 AND len(y.names) > 0 AND NOT list_has_any(x.names, y.names)) THEN nodes
    ELSE list_transform(nodes, lambda z: CASE WHEN z.root IN (x.root, y.root) THEN {'id': z.id, 'root': least(x.root, y.root), 'rooms': list_distinct(list_concat(x.rooms, y.rooms)), 'names': list_distinct(list_concat(x.names, y.names))} ELSE z END) END
  FROM (SELECT *, k + 1 AS nxt FROM c) c JOIN q ON q.mt = c.mt AND q.k = nxt, LATERAL (SELECT list_filter(nodes, lambda z: z.id = q.before)[1] AS x, list_filter(nodes, lambda z: z.id = q.id)[1] AS y)),
l AS (SELECT mt, arg_max(nodes, k) AS nodes FROM c GROUP BY mt), u AS (SELECT mt, unnest(nodes) AS z FROM l)
SELECT mt, z.id AS id, z.root AS component FROM u""")
def semantic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mt"), k.alias("id"), (k % 6).alias("sheet"), F.when(k % 3 > 0, (k % 9).cast("string")).alias("room"), F.when(k % 4 > 0, (k % 5).cast("string")).alias("name"), F.col("o_orderpriority").alias("title"), (k % 2).alias("source"), (k % 11).alias("drawing"))
    return sequential.guarded_components(rows, "mt", [["title"], ["source", "room", "name"], ["source", "drawing", "name"]])


@query("""WITH RECURSIVE c AS (SELECT c_custkey // 150 AS scope, c_custkey, c_nationkey, c_acctbal FROM customer), s AS (SELECT s_suppkey // 10 AS scope, s_suppkey, s_acctbal FROM supplier),
p AS (SELECT scope, c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 2) AS cost FROM c JOIN s USING (scope) WHERE abs(c_acctbal - s_acctbal) < 500),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cost, c_custkey, s_suppkey) AS k FROM p),
w AS (SELECT scope, k, true AS t, [c_custkey] AS a, [s_suppkey] AS b FROM r WHERE k = 1
  UNION ALL SELECT r.scope, r.k, j, CASE WHEN j THEN list_append(a, c_custkey) ELSE a END, CASE WHEN j THEN list_append(b, s_suppkey) ELSE b END FROM (SELECT *, k + 1 AS nxt FROM w) w JOIN r ON r.scope = w.scope AND r.k = nxt, LATERAL (SELECT NOT list_contains(a, c_custkey) AND NOT list_contains(b, s_suppkey) AS j))
SELECT r.scope, c_custkey, s_suppkey, cost FROM r JOIN w ON w.scope = r.scope AND w.k = r.k WHERE t""")
def detached_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On sheets of 150 customers and 10 suppliers."""
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 150").alias("scope"), "c_custkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 10").alias("scope"), "s_suppkey", "s_acctbal")
    cost = F.abs(F.col("c_acctbal") - F.col("s_acctbal"))
    return sequential.greedy_pairs(c.join(s, "scope").where(cost < 500).select("scope", "c_custkey", "s_suppkey", binary_round(cost, 2).alias("cost")), "scope", "c_custkey", "s_suppkey", "cost")


@query("""WITH RECURSIVE g AS (SELECT l_suppkey AS s, l_returnflag AS pool, l_partkey AS item, -max(l_quantity) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY s, pool ORDER BY q, item) AS r FROM g), i AS (SELECT s, pool, list(item ORDER BY r) AS items FROM r WHERE r <= 24 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pool) - 1 AS n, count(*) OVER (PARTITION BY s) AS pools FROM i),
w AS (SELECT s, pools, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS item, CAST(NULL AS VARCHAR) AS pool FROM (SELECT DISTINCT s, pools FROM p)
  UNION ALL SELECT w.s, w.pools, w.k + 1, CASE WHEN nxt IS NULL THEN seen ELSE list_append(seen, nxt) END, nxt, p.pool FROM w JOIN p ON p.s = w.s AND p.n = w.k % w.pools, LATERAL (SELECT list_filter(items, lambda x: NOT list_contains(seen, x))[1] AS nxt) WHERE len(seen) < 12 AND w.k < 36)
SELECT s AS l_suppkey, item AS l_partkey, pool AS l_returnflag, CAST(len(seen) AS INT) AS turn FROM w WHERE item IS NOT NULL""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a bounded sample of each supplier's parts, by turns of their return flags."""
    pools = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_partkey").agg((-F.max("l_quantity")).alias("q"))
    return sequential.round_robin(pools, "l_suppkey", "l_returnflag", "l_partkey", "q", 12)


@query("""WITH RECURSIVE e AS (SELECT c_custkey // 60 AS scope, c_custkey AS id, c_acctbal AS x FROM customer),
p AS (SELECT l.scope, l.id AS a, r.id AS b FROM e l JOIN e r ON l.scope = r.scope AND l.id % 2 = 0 AND r.id % 2 = 1 AND abs(l.x - r.x) < 110),
t AS (SELECT a, a AS root FROM p UNION SELECT q.a, t.root FROM t JOIN p o ON o.a = t.a JOIN p q ON q.b = o.b),
m AS (SELECT a, min(root) AS component FROM t GROUP BY a), f AS (SELECT scope, component, a, b FROM p JOIN m USING (a)),
n AS (SELECT scope, component, list(DISTINCT a ORDER BY a) AS ls, count(DISTINCT b) AS rs FROM f GROUP BY ALL), i AS (SELECT component, a, list(b ORDER BY b) AS bs FROM f GROUP BY ALL),
w AS (SELECT component, ls, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used FROM n WHERE len(ls) = rs
  UNION ALL SELECT w.component, ls, w.k + 1, list_append(used, z.b) FROM w JOIN i ON i.component = w.component AND i.a = ls[w.k + 1], LATERAL (SELECT unnest(bs) AS b) z WHERE NOT list_contains(used, z.b)),
d AS (SELECT component, count(*) AS found, any_value(used) AS used FROM w WHERE k = len(ls) GROUP BY component),
v AS (SELECT scope, n.component, ls, used, CASE WHEN len(ls) <> rs THEN 'unequal' WHEN found IS NULL THEN 'none' WHEN found > 1 THEN 'ambiguous' ELSE 'unique' END AS state FROM n LEFT JOIN d USING (component))
SELECT scope, component, state, ls[k] AS a, used[k] AS b FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM v WHERE state = 'unique') UNION ALL SELECT scope, component, state, NULL, NULL FROM v WHERE state <> 'unique'""")
def viewport_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On sheets of sixty, those of even numbers with those of odd ones nearby."""
    e = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 60").alias("scope"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    left, right = e.where("id % 2 = 0").select("scope", F.col("id").alias("a"), "x"), e.where("id % 2 = 1").select("scope", F.col("id").alias("b"), F.col("x").alias("y"))
    return sequential.unique_assignment(left.hint("merge").join(right, "scope").where("abs(x - y) < 110"), "scope", "a", "b")


@query("""WITH s AS (SELECT p_brand, list_sort([p_size % 9 + 1, 3, p_size % 9 + 1, 3]) AS sides, round(p_retailprice, 2) AS d FROM part),
g AS (SELECT p_brand, substring(sha256(array_to_string(sides, ',')), 1, 24) AS signature, count(*) AS occurrences, min(d) AS nearest FROM s GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY nearest, signature) AS INT) AS rank FROM g) SELECT * FROM r WHERE rank <= 6""")
def repeated_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    k, w = F.col("p_partkey").cast("double"), (F.col("p_size") % 9 + 1).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    shapes = table(spark, sf_dir, "part").select("p_brand", F.array(point(k, k), point(k + w, k), point(k + w, k + 3), point(k, k + 3)).alias("points"), F.lit(1).alias("multiplicity"), F.round(F.col("p_retailprice"), 2).alias("distance"))
    return sequential.repeated_shapes(shapes, "p_brand", "distance")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CODE' WHEN 'P' THEN 'VIEW' ELSE 'OTHER' END AS tag, substring(o_orderpriority, 1, 1) AS v FROM orders),
g AS (SELECT o_custkey, list_distinct(list(v) FILTER (WHERE tag = 'CODE')) AS c, list_distinct(list(v) FILTER (WHERE tag = 'VIEW')) AS w FROM a GROUP BY o_custkey),
r AS (SELECT *, CASE WHEN coalesce(len(c), 0) = 0 THEN 'no_code' WHEN len(c) > 1 THEN 'several_codes' WHEN coalesce(len(w), 0) = 0 THEN 'no_view' WHEN len(w) > 1 THEN 'several_views' END AS reason FROM g)
SELECT o_custkey, reason, CASE WHEN reason IS NULL THEN c[1] END AS code, CASE WHEN reason IS NULL THEN w[1] END AS "view" FROM r""")
def sibling_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, T6."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "CODE").when(F.col("o_orderstatus") == "P", "View").otherwise("OTHER").alias("tag"), F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" ")).alias("v"))
    return geometry.sibling_codes(rows, [], "o_custkey", "tag", "v", "CODE", "VIEW")


@query("""WITH t AS (SELECT s_suppkey AS group_id, s_nationkey AS sheet, s_suppkey % 6 AS code FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3))
SELECT sheet, code, min(group_id) AS group_id FROM t GROUP BY ALL HAVING count(*) = 1""")
def trusted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("group_id"), F.col("s_nationkey").alias("sheet"), (F.col("s_suppkey") % 6).alias("code"), (F.col("s_acctbal") > 0).alias("leader_backed"))
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"), (F.col("n_regionkey") < 3).alias("explicit"))
    return geometry.trusted_groups(groups, edges, "sheet", "code")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on a grid, on sheets of 252: horizontal or vertical by turns."""
    k, even = F.col("c_custkey"), F.floor(F.col("c_custkey") / 42) % 2 == 0
    x, y, n = k % 7 * 10.0, F.floor(k / 7) % 6 * 10.0, (F.floor(k / 84) % 3 + 1) * 10.0
    return table(spark, sf_dir, "customer").select(F.expr("c_custkey div 252").alias("scope"), F.col("c_acctbal").alias("bal"), k.alias("id"), x.alias("x0"), y.cast("double").alias("y0"), F.when(even, x + n).otherwise(x).alias("x1"), F.when(even, y).otherwise(y + n).cast("double").alias("y1"))


@query("""WITH l AS (SELECT c_custkey // 252 AS scope, c_custkey AS id, c_custkey % 7 * 10.0 AS x0, (c_custkey // 7) % 6 * 10.0 AS y0, CASE WHEN (c_custkey // 42) % 2 = 0 THEN c_custkey % 7 * 10.0 + ((c_custkey // 84) % 3 + 1) * 10.0 ELSE c_custkey % 7 * 10.0 END AS x1,
  CASE WHEN (c_custkey // 42) % 2 = 0 THEN (c_custkey // 7) % 6 * 10.0 ELSE (c_custkey // 7) % 6 * 10.0 + ((c_custkey // 84) % 3 + 1) * 10.0 END AS y1 FROM customer),
h AS (SELECT scope, x0, x1, y0, min(id) AS id FROM l WHERE y0 = y1 GROUP BY ALL), v AS (SELECT scope, y0, y1, x0, min(id) AS id FROM l WHERE x0 = x1 GROUP BY ALL)
SELECT b.scope, b.x0::DOUBLE AS x0, b.y0::DOUBLE AS y0, b.x1::DOUBLE AS x1, t.y0::DOUBLE AS y1, b.id AS bottom, t.id AS top, e.id AS "left", f.id AS "right" FROM h b JOIN h t ON t.scope = b.scope AND t.x0 = b.x0 AND t.x1 = b.x1 AND t.y0 > b.y0
JOIN v e ON e.scope = b.scope AND e.x0 = b.x0 AND e.y0 = b.y0 AND e.y1 = t.y0 JOIN v f ON f.scope = b.scope AND f.x0 = b.x1 AND f.y0 = b.y0 AND f.y1 = t.y0""")
def paper_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return geometry.rectangles(_lines(spark, sf_dir), ["scope"])


@query("""WITH b AS (SELECT s_nationkey AS scope, s_suppkey AS border_id, s_suppkey % 5 * 100 AS x0, s_suppkey % 4 * 100 AS y0, s_suppkey % 5 * 100 + 200 AS x1, s_suppkey % 4 * 100 + 100 AS y1 FROM supplier),
l AS (SELECT c_nationkey AS scope, c_custkey AS leader_id, c_custkey % 70 * 10 AS x, c_custkey % 50 * 10 AS y FROM customer),
h AS (SELECT scope, leader_id, border_id, count(*) OVER (PARTITION BY scope, leader_id) AS borders FROM l JOIN b USING (scope) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND (x IN (x0, x1) OR y IN (y0, y1)))
SELECT *, CASE WHEN borders > 1 THEN 'ambiguous' ELSE 'branch' END AS state FROM h""")
def leader_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    borders = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scope"), k.alias("border_id"), (k % 5 * 100.0).alias("x0"), (k % 4 * 100.0).alias("y0"), (k % 5 * 100.0 + 200).alias("x1"), (k % 4 * 100.0 + 100).alias("y1"))
    leaders = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), c.alias("leader_id"), (c % 70 * 10.0).alias("x"), (c % 50 * 10.0).alias("y"))
    return geometry.border_leaders(leaders, borders, ["scope"])


@query("""WITH l AS (SELECT c_custkey // 252 AS scope, c_acctbal AS bal, c_custkey AS id, c_custkey % 7 * 10.0::DOUBLE AS x0, (c_custkey // 7) % 6 * 10.0::DOUBLE AS y0, CASE WHEN (c_custkey // 42) % 2 = 0 THEN ((c_custkey // 84) % 3 + 1) * 10.0::DOUBLE ELSE 0.0 END AS w, CASE WHEN (c_custkey // 42) % 2 = 0 THEN 0.0 ELSE ((c_custkey // 84) % 3 + 1) * 10.0::DOUBLE END AS h FROM customer),
d AS (SELECT scope, id AS dim_id, x0 AS ax, y0 + CASE WHEN id % 5 = 1 THEN 4 ELSE 0 END AS ay, x0 + w AS bx, y0 + h + CASE WHEN id % 5 = 1 THEN 4 ELSE 0 END AS b_y, (id % 3 + 1) * 10.0::DOUBLE AS value FROM l WHERE bal > 5000),
s AS (SELECT scope, id AS seg_id, x0 AS sx, y0 AS sy, x0 + w AS tx, y0 + h AS ty FROM l),
p AS (SELECT scope, dim_id, value, seg_id, greatest(tx - sx, ty - sy) AS len, CASE WHEN ax = sx AND ay = sy AND bx = tx AND b_y = ty THEN 1 WHEN (ax = sx AND bx = tx AND sy = ty) OR (ay = sy AND b_y = ty AND sx = tx) THEN 2 END AS rank FROM d JOIN s USING (scope)),
g AS (SELECT scope, dim_id, value, rank, count(*) AS n, min((seg_id, len)) AS m FROM p WHERE rank IS NOT NULL GROUP BY ALL), b AS (SELECT scope, dim_id, value, min((rank, n, m)) AS b FROM g GROUP BY ALL),
t AS (SELECT scope, dim_id, b[1] AS rank, b[3][1] AS seg, CASE WHEN b[2] > 1 THEN 'ambiguous' WHEN abs(b[3][2] - value) > 0.5 THEN 'conflict' ELSE 'bound' END AS state FROM b)
SELECT scope, dim_id, CAST(rank AS INT) AS rank, state, CASE WHEN state <> 'ambiguous' THEN seg END AS seg_id FROM t""")
def dimension_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    segments = _lines(spark, sf_dir).select("scope", "bal", F.col("id").alias("seg_id"), F.col("x0").alias("sx"), F.col("y0").alias("sy"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    k = F.col("seg_id")
    dims = segments.where("bal > 5000").select("scope", k.alias("dim_id"), F.col("sx").alias("ax"), (F.col("sy") + F.when(k % 5 == 1, 4.0).otherwise(0.0)).alias("ay"), F.col("tx").alias("bx"), (F.col("ty") + F.when(k % 5 == 1, 4.0).otherwise(0.0)).alias("by"), ((k % 3 + 1) * 10.0).alias("value"))
    return geometry.bind_dimensions(dims, segments.drop("bal"), ["scope"])


@query("""WITH v AS (SELECT s_nationkey AS scope, s_suppkey % 9 * 100 AS x0, s_suppkey % 9 * 100 + 150 AS x1, 0 AS y0, s_suppkey % 3 * 100 + 100 AS y1 FROM supplier), s AS (SELECT c_nationkey AS scope, c_custkey AS span_id, c_custkey % 250 AS y, c_custkey % 6 * 100 AS a, c_custkey % 6 * 100 + c_custkey % 400 AS b FROM customer),
m AS (SELECT s.*, x0, x1, max(x1) OVER (PARTITION BY scope, span_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s JOIN v USING (scope) WHERE y BETWEEN y0 AND y1 AND x1 >= a AND x0 <= b),
g AS (SELECT scope, span_id, bool_or(coalesce(x0 > reach, false)) AS gap, min(x0) AS low, max(x1) AS high FROM m GROUP BY ALL)
SELECT scope, span_id, CASE WHEN low IS NULL OR low > a OR high < b THEN 'outside' WHEN gap THEN 'gap' ELSE 'covered' END AS state FROM s LEFT JOIN g USING (scope, span_id)""")
def dimension_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    views = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scope"), (k % 9 * 100.0).alias("x0"), (k % 9 * 100.0 + 150).alias("x1"), F.lit(0.0).alias("y0"), (k % 3 * 100.0 + 100).alias("y1"))
    spans = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), c.alias("span_id"), (c % 250).cast("double").alias("y"), (c % 6 * 100.0).alias("a"), (c % 6 * 100.0 + c % 400).alias("b"))
    return geometry.covered_spans(spans, views, ["scope"])


@query("""WITH RECURSIVE l AS (SELECT c_custkey // 252 AS scope, c_acctbal AS bal, c_custkey AS id, c_custkey % 7 * 10 AS x0, (c_custkey // 7) % 6 * 10 AS y0, CASE WHEN (c_custkey // 42) % 2 = 0 THEN ((c_custkey // 84) % 3 + 1) * 10 ELSE 0 END AS w, CASE WHEN (c_custkey // 42) % 2 = 0 THEN 0 ELSE ((c_custkey // 84) % 3 + 1) * 10 END AS h FROM customer),
s AS (SELECT scope, id, x0 * 1000 + y0 AS p, (x0 + w) * 1000 + y0 + h AS q FROM l WHERE bal > 2000), b AS (SELECT scope, id AS start_id, x0 * 1000 + y0 AS p FROM l WHERE bal <= 2000),
e AS (SELECT scope, p, id, q FROM s UNION ALL SELECT scope, q, id, p FROM s), a AS (SELECT scope, p, list({'id': id, 'q': q}) AS ends FROM e GROUP BY ALL),
t AS (SELECT b.scope, start_id, b.p AS here, CAST([] AS BIGINT[]) AS used, [b.p] AS seen, CAST(NULL AS VARCHAR) AS reason FROM b
  UNION ALL SELECT t.scope, start_id, CASE WHEN len(n) = 1 AND len(used) < 64 THEN n[1].q ELSE here END, CASE WHEN len(n) = 1 AND len(used) < 64 THEN list_append(used, n[1].id) ELSE used END, CASE WHEN len(n) = 1 AND len(used) < 64 THEN list_append(seen, n[1].q) ELSE seen END,
    CASE WHEN coalesce(len(n), 0) = 0 THEN 'end' WHEN len(n) > 1 THEN 'branch' WHEN len(used) >= 64 THEN 'too_long' WHEN list_contains(seen, n[1].q) THEN 'rejoin' END
  FROM t LEFT JOIN a ON a.scope = t.scope AND a.p = t.here, LATERAL (SELECT list_filter(ends, lambda z: NOT list_contains(used, z.id)) AS n) WHERE reason IS NULL)
SELECT scope, start_id, CAST(len(used) AS INT) AS length, CASE WHEN len(used) = 0 THEN 'no_stem' ELSE reason END AS reason, array_to_string(used, ',') AS path FROM t WHERE reason IS NOT NULL AND scope IN (SELECT scope FROM b)""")
def cut_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: on sheets of 252 lines."""
    lines = _lines(spark, sf_dir)
    segments = lines.where("bal > 2000").select("scope", F.col("id").alias("seg_id"), F.col("x0").alias("sx"), F.col("y0").alias("sy"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    starts = lines.where("bal <= 2000").select("scope", F.col("id").alias("start_id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return geometry.trace_paths(segments, starts, "scope")


@query("""WITH s AS (SELECT c_custkey, 10.0::DOUBLE * (c_custkey % 5) AS r, CAST(c_custkey % 40 AS DOUBLE) AS dx, CAST(c_custkey % 30 AS DOUBLE) AS dy FROM customer), d AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, greatest(r * 1e-5, 1e-7) AS t FROM s),
q AS (SELECT *, concat_ws(',', CASE WHEN r <= 0 THEN 'no_circle' END, CASE WHEN d < r - t THEN 'tip_inside' END, CASE WHEN d > 2 * r + t THEN 'tip_far' END) AS reasons FROM d)
SELECT c_custkey, reasons, CASE WHEN reasons = '' THEN round(dx / d, 9) END AS ux, CASE WHEN reasons = '' THEN round(dy / d, 9) END AS uy FROM q""")
def index_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    c = F.col("c_custkey")
    symbols = table(spark, sf_dir, "customer").select("c_custkey", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), (10.0 * (c % 5)).alias("r"), (c % 40).cast("double").alias("tx"), (c % 30).cast("double").alias("ty"))
    return geometry.index_direction(symbols).select("c_custkey", "reasons", "ux", "uy")


@query("""WITH c AS (SELECT l_orderkey, l_partkey AS page_id, 'P' || l_partkey % 9 AS code, CAST(l_quantity * 10 AS DOUBLE) AS distance, 5000.0::DOUBLE AS diagonal, l_tax >= 0.08 AS framed FROM lineitem),
f AS (SELECT l_orderkey, count(DISTINCT code) AS codes, min(code) AS fc FROM c WHERE framed GROUP BY l_orderkey), n AS (SELECT l_orderkey, min((distance, code, page_id)) AS n FROM c GROUP BY l_orderkey),
k AS (SELECT l_orderkey, count(DISTINCT code) AS close FROM c JOIN n USING (l_orderkey) WHERE distance - n[1] <= 0.01 * diagonal GROUP BY l_orderkey),
s AS (SELECT n.*, fc, CASE WHEN codes > 1 THEN 'conflict' WHEN codes = 1 THEN 'frame' WHEN close > 1 THEN 'ambiguous' ELSE 'nearest' END AS state FROM n LEFT JOIN f USING (l_orderkey) JOIN k USING (l_orderkey))
SELECT l_orderkey, state, CASE WHEN state = 'frame' THEN fc WHEN state = 'nearest' THEN n[2] END AS code FROM s""")
def reference_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    candidates = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("page_id"), F.concat(F.lit("P"), F.col("l_partkey") % 9).alias("code"), (F.col("l_quantity") * 10).alias("distance"), F.lit(5000.0).alias("diagonal"), (F.col("l_tax") >= 0.08).alias("framed"))
    return geometry.reference_page(candidates, ["l_orderkey"])


@query("""WITH s AS (SELECT l_orderkey, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS view_id, CASE WHEN l_returnflag = 'A' THEN 4.0::DOUBLE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + least(CAST(l_linenumber AS DOUBLE), 3.0) + CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN l_partkey % 4 = 0 THEN 3.0::DOUBLE ELSE 0 END
  + CASE WHEN l_partkey % 9 = 0 THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN l_suppkey % 3 = 0 THEN 0.4::DOUBLE ELSE 0 END + least((l_partkey % 7) * 0.2::DOUBLE, 0.8) AS score FROM (SELECT DISTINCT * FROM lineitem)),
r AS (SELECT l_orderkey, view_id, round(score, 6) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, view_id) AS rank FROM (SELECT l_orderkey, view_id, round(score, 6) AS score FROM s))
SELECT l_orderkey, view_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def subview_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    views = table(spark, sf_dir, "lineitem").distinct().select(
        "l_orderkey", (p * 1_000_000 + s * 10 + F.col("l_linenumber")).alias("view_id"), (F.col("l_returnflag") == "A").alias("code_exact"), (F.col("l_returnflag") == "R").alias("code_partial"), F.col("l_linenumber").alias("names"),
        (F.col("l_linestatus") == "O").alias("material"), (p % 4 == 0).alias("view_reference"), (p % 9 == 0).alias("reference_entity"), (s % 2 == 0).alias("leader"), (s % 3 == 0).alias("frame"), (p % 7).alias("dimensions"),
    )
    return geometry.rank_subviews(views, ["l_orderkey"])


@query("""WITH b AS (SELECT s_nationkey, min(s_acctbal) AS x0, max(s_acctbal) AS x1, min(s_suppkey)::DOUBLE AS y0, max(s_suppkey)::DOUBLE AS y1 FROM supplier GROUP BY s_nationkey),
c AS (SELECT s_nationkey, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, greatest((x1 - x0) * 1.24::DOUBLE, 12000.0::DOUBLE * 0.12::DOUBLE) AS w, greatest((y1 - y0) * 1.24::DOUBLE, 120.0::DOUBLE * 0.18::DOUBLE) AS h FROM b)
SELECT s_nationkey, round(greatest(x - w / 2, -1000.0), 6) AS x0, round(greatest(y - h / 2, 0.0), 6) AS y0, round(least(x + w / 2, 11000.0), 6) AS x1, round(least(y + h / 2, 120.0), 6) AS y1 FROM c""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, P11, W7."""
    own = table(spark, sf_dir, "supplier").select("s_nationkey", boxes.box(F.col("s_acctbal"), F.col("s_suppkey").cast("double"), F.col("s_acctbal"), F.col("s_suppkey").cast("double")).alias("b"))
    sheet = boxes.box(F.lit(-1000.0), F.lit(0.0), F.lit(11000.0), F.lit(120.0))
    focus = own.groupBy("s_nationkey").agg(boxes.union_of("b").alias("f")).select("s_nationkey", boxes.crop(F.col("f"), sheet, 0.12, 0.12, 0.18).alias("c"))
    return focus.select("s_nationkey", *[F.round(f"c.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN round(1000.0 + (c_custkey % 100 - 0.0) * 50.0, 6) END::DOUBLE AS x, CASE WHEN c_nationkey % 3 > 0 THEN round(-500.0 + (c_custkey % 80 - 0.0) * 50.0, 6) END::DOUBLE AS y FROM customer""")
def panel_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewport with unequal scales gives null."""
    c = F.col("c_custkey")
    paper = boxes.box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(80.0))
    model = boxes.box(F.lit(1000.0), F.lit(-500.0), F.lit(6000.0), F.when(F.col("c_nationkey") % 3 > 0, 3500.0).otherwise(9000.0))
    p = boxes.projected((c % 100).cast("double"), (c % 80).cast("double"), paper, model)
    return table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.col("l_quantity").cast("int"), F.lit(" mm"))).when(F.col("l_linenumber") % 5 == 0, "see note").when(F.col("l_linenumber") % 2 == 0, "<>")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("shown"), F.round(F.col("l_extendedprice"), 2).alias("measured"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) WHEN l_linenumber % 5 = 0 THEN NULL ELSE round(l_extendedprice, 2) END AS value FROM lineitem""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, M10."""
    return _measurements(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", display_value(F.col("shown"), F.col("measured"), F.lit("mm")).alias("value"))


@query("""WITH k AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE p_name END AS v, CASE WHEN p_partkey % 4 = 0 THEN 'WALL-TEXT' ELSE p_brand END AS layer, '=' || p_name AS f FROM part)
SELECT p_partkey, coalesce(NOT regexp_matches(lower(trim(v)), '^(|n/?a|none|null|nil|-+|tbd|unknown)$'), false) AS real_view, layer <> 'WALL-TEXT' AS object_layer, p_partkey % 3 > 0 AS shown, '''' || f AS safe FROM k""")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, F6, P14."""
    k = F.col("p_partkey")
    v = F.when(k % 6 == 0, "N/A").when(k % 6 == 1, " - ").when(k % 6 == 2, "").when(k % 6 > 3, F.col("p_name"))
    layer = F.when(k % 4 == 0, "WALL-TEXT").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.real_view(v).alias("real_view"), rules.object_layer(layer, ["text", "dim", "note"]).alias("object_layer"), rules.visible(k % 3 == 0, F.lit(None).cast("boolean"), F.lit(False)).alias("shown"), excel_safe(F.concat(F.lit("="), "p_name")).alias("safe"))


@query(f"""WITH {CALC_SQL},
book AS (SELECT p_brand, p_type, min(p_partkey) AS k, round(max(p_retailprice), 2) AS price FROM part GROUP BY ALL),
prices AS (SELECT CAST(k AS VARCHAR) || '-' || v AS price_id, p_brand, p_type, price, f, CASE WHEN k % 11 <> 0 THEN t END AS t FROM book, (VALUES ('a', DATE '1992-01-01', DATE '1995-06-30'), ('b', DATE '1995-07-01', NULL)) AS x(v, f, t) WHERE k % 7 <> 0),
m AS (SELECT i.p_brand, i.p_type, d.day, count(price_id) AS candidates, min(price) AS price FROM (SELECT DISTINCT p_brand, p_type FROM items) i CROSS JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM items) d JOIN prices ON prices.p_brand = i.p_brand AND prices.p_type = i.p_type AND day >= f AND (t IS NULL OR day <= t) GROUP BY ALL),
own AS (SELECT DISTINCT l_orderkey, l_partkey * 100 + l_suppkey % 100 AS evidence FROM items), shared AS (SELECT evidence FROM own GROUP BY evidence HAVING count(*) > 1), blocked AS (SELECT DISTINCT l_orderkey FROM own JOIN shared USING (evidence)),
r AS (SELECT calc.*, CASE WHEN b.l_orderkey IS NOT NULL THEN 'shared_evidence' WHEN block_reason IS NOT NULL THEN block_reason WHEN candidates IS NULL THEN 'no_price' WHEN candidates > 1 THEN 'ambiguous' END AS reason, candidates, m.price AS price,
  CASE WHEN b.l_orderkey IS NOT NULL OR block_reason IS NOT NULL THEN 'BLOCK' WHEN candidates IS NULL OR candidates > 1 THEN 'REVIEW' ELSE 'PASS' END AS verdict
  FROM calc LEFT JOIN m ON m.p_brand = calc.p_brand AND m.p_type = calc.p_type AND m.day = CAST(l_shipdate AS DATE) LEFT JOIN blocked b ON b.l_orderkey = calc.l_orderkey)
SELECT p_brand, verdict, reason, count(*) AS items, CAST(sum(CASE WHEN verdict = 'PASS' THEN round(CAST(exact AS DECIMAL(20,9)) * CAST(price AS DECIMAL(10,2)), 2) END) AS DOUBLE) AS amount FROM r GROUP BY ALL""")
def takeoff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, unique prices and exclusive evidence of all items, and what each status amounts to."""
    rows = items(spark, sf_dir).drop("unit_price").withColumn("day", F.col("l_shipdate").cast("date"))
    priced = pricing.match_prices(rows, prices(spark, sf_dir), ["p_brand", "p_type"], "day").withColumnRenamed("reason", "price_reason")
    owners = pricing.exclusive_owners(rows.select("l_orderkey", F.expr("l_partkey * 100 + l_suppkey % 100").alias("evidence")), "l_orderkey", "evidence")
    blocked = owners.where("status = 'BLOCK'").select("l_orderkey", F.lit(True).alias("shared"))
    done = pricing.calculate_items(priced).join(blocked, "l_orderkey", "left")
    reason = F.when(F.col("shared"), "shared_evidence").otherwise(F.coalesce("block_reason", "price_reason"))
    verdict = F.when(F.col("shared") | F.col("block_reason").isNotNull(), "BLOCK").when(F.col("price_reason").isNotNull(), "REVIEW").otherwise("PASS")
    out = done.withColumns({"reason": reason, "verdict": verdict}).groupBy("p_brand", "verdict", "reason")
    return out.agg(F.count("*").alias("items"), F.sum(F.when(F.col("verdict") == "PASS", F.col("amount"))).cast("double").alias("amount"))


@query(f"""WITH {CALC_SQL} SELECT l_orderkey, l_linenumber AS sequence, p_type AS name, unit, CASE WHEN unit = 'm' THEN '=J' || (l_linenumber + 1) || '*K' || (l_linenumber + 1) || '/1000' WHEN unit = '㎡' THEN '=I' || (l_linenumber + 1) || '*J' || (l_linenumber + 1) || '*K' || (l_linenumber + 1) || '/1000000'
  WHEN unit IN ('件', '套') THEN '=K' || (l_linenumber + 1) END AS quantity_formula, CASE WHEN status = 'PASS' THEN CAST(amount AS DOUBLE) END AS amount, status FROM calc""")
def quote_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: the quote's rows with formulas, by order."""
    calculated = pricing.calculate_items(items(spark, sf_dir)).withColumns({"sequence": F.col("l_linenumber"), "name": F.col("p_type")})
    return sinks.quote_table(calculated).select("l_orderkey", "sequence", "name", "unit", "quantity_formula", F.col("amount").cast("double").alias("amount"), "status")
