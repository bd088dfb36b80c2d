"""Queries of takeoff rows, row matching, project evaluation and relation ranking."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import numeric
from tallyforge.operators import catalog, matching, takeoff
from tallyforge.plans.registry import query, table

_ROWS = """WITH m AS (SELECT DISTINCT l_orderkey AS component, CASE WHEN l_linenumber % 2 = 1 THEN 'plan' ELSE 'elevation' END AS role, l_suppkey % 20 AS sheet FROM lineitem),
d AS (SELECT DISTINCT l_orderkey AS component, l_partkey % 10 AS sheet FROM lineitem WHERE l_returnflag = 'A'),
e1 AS (SELECT 'p' || n_nationkey AS edge, n_nationkey % 20 AS a, n_nationkey * 7 % 20 AS b, n_nationkey % 3 > 0 AS ok FROM nation UNION ALL SELECT 'q' || n_nationkey, n_nationkey % 20, n_nationkey * 3 % 20, n_nationkey % 3 > 0 FROM nation),
e2 AS (SELECT 'd' || n_nationkey AS edge, n_nationkey % 20 AS a, n_nationkey % 10 AS b, n_nationkey % 4 > 0 AS ok FROM nation),
f AS (SELECT DISTINCT p.component, v.sheet AS mid, e1.edge AS edge1, e1.ok AS ok1 FROM m p JOIN e1 ON p.sheet = e1.a JOIN m v ON v.component = p.component AND v.sheet = e1.b WHERE p.role = 'plan' AND v.role = 'elevation'),
s AS (SELECT DISTINCT v.component, v.sheet AS mid, e2.edge AS edge2, e2.ok AS ok2 FROM m v JOIN e2 ON v.sheet = e2.a JOIN d ON d.component = v.component AND d.sheet = e2.b WHERE v.role = 'elevation'),
c AS (SELECT component, count(*) AS chains, count(*) FILTER (WHERE ok1 AND ok2) AS passed, min((edge1, edge2)) FILTER (WHERE ok1 AND ok2) AS good, min((edge1, edge2)) AS a FROM f JOIN s USING (component, mid) GROUP BY component),
n AS (SELECT *, coalesce(passed = 1, false) AS chain_pass, CASE WHEN coalesce(passed = 1, false) THEN good WHEN chains = 1 THEN a END AS chosen, component IN (SELECT component FROM f) AS has1, component IN (SELECT component FROM s) AS has2 FROM (SELECT DISTINCT component FROM m) LEFT JOIN c USING (component)),
t AS (SELECT o_orderkey AS component, ['m', '㎡', 'kg', NULL, '件'][o_orderkey % 5 + 1] AS cu, ['by_length', 'per area', NULL, 'set', ' '][o_orderkey // 5 % 5 + 1] AS cm, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 90 + 10)::DOUBLE END AS length_mm, (o_orderkey % 40 + 5)::DOUBLE AS width_mm, (o_orderkey % 7 + 1)::DOUBLE AS quantity, CASE WHEN o_orderkey % 13 > 0 THEN round(o_totalprice / 1000, 2) END AS price FROM orders),
u AS (SELECT *, nullif(trim(cm), '') AS method, CASE WHEN cm = 'by_length' THEN 'm' WHEN cm = 'per area' THEN '㎡' WHEN cm = 'set' THEN '套' END AS inferred, cu IN ('m', '㎡', '件', '套') IS TRUE AS valid FROM t),
w AS (SELECT *, valid AND inferred IS NOT NULL AND inferred <> cu AS conflict, CASE WHEN valid AND NOT (inferred IS NOT NULL AND inferred <> cu) THEN cu WHEN cu IS NULL THEN inferred END AS unit FROM u),
q AS (SELECT o_orderkey AS component, concat_ws(',', CASE WHEN o_orderkey % 12 = 0 THEN 'expression' END, CASE WHEN o_orderkey % 18 = 0 THEN 'basis' END, CASE WHEN o_orderkey % 24 = 6 THEN 'outside_chain:E1' END, CASE WHEN o_orderkey % 30 = 0 THEN 'unknown_entity:none' END) AS reasons FROM orders WHERE o_orderkey % 6 = 0),
r AS (SELECT w.component, unit, chosen[1] AS plan_edge, chosen[2] AS detail_edge, price,
  CASE unit WHEN 'm' THEN CAST(length_mm * quantity / 1000 AS DECIMAL(26,9)) WHEN '㎡' THEN CAST(width_mm * length_mm * quantity / 1000000 AS DECIMAL(26,9)) ELSE CAST(quantity AS DECIMAL(26,9)) END AS exact, unit IN ('m', '㎡') AND length_mm IS NULL AS no_length,
  nullif(concat_ws(',', CASE WHEN cu IS NOT NULL AND NOT valid THEN 'invalid_unit' END, CASE WHEN cm IS NOT NULL AND method IS NULL THEN 'empty_method' END, CASE WHEN method IS NULL THEN 'missing_method' END, CASE WHEN conflict THEN 'unit_conflict' END, CASE WHEN unit IS NULL AND NOT (cu IS NOT NULL AND NOT valid) THEN 'missing_unit' END,
    CASE WHEN n.component IS NOT NULL AND chains IS NULL AND NOT has1 THEN 'missing_plan_edge' END, CASE WHEN n.component IS NOT NULL AND chains IS NULL AND NOT has2 THEN 'missing_detail_edge' END, CASE WHEN chains IS NULL AND has1 AND has2 THEN 'incoherent' END, CASE WHEN n.component IS NULL THEN 'missing_chain' END,
    nullif(q.reasons, ''), CASE WHEN unit IN ('m', '㎡') AND length_mm IS NULL THEN 'missing_length' END), '') AS block,
  nullif(concat_ws(',', CASE WHEN NOT chain_pass AND chains > 1 THEN 'several_chains' WHEN NOT chain_pass AND chains = 1 THEN 'unconfirmed_edge' END, CASE WHEN price IS NULL THEN 'no_price' END), '') AS review
  FROM w LEFT JOIN n USING (component) LEFT JOIN q USING (component))"""


@query(f"""{_ROWS} SELECT component, unit, plan_edge, detail_edge, CASE WHEN block IS NOT NULL THEN 'BLOCK' WHEN review IS NOT NULL THEN 'REVIEW' ELSE 'PASS' END AS status, concat_ws(',', block, review) AS reasons,
  CASE WHEN unit IS NOT NULL AND NOT no_length THEN CAST(round(exact, 6) AS DOUBLE) END AS engineering_quantity, CASE WHEN block IS NULL AND review IS NULL THEN CAST(round(CAST(exact AS DECIMAL(20,9)) * CAST(price AS DECIMAL(10,2)), 2) AS DOUBLE) END AS amount FROM r""")
def takeoff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as components with chains over sheets, confirmed terms and quantities, and prices."""
    lines, nation, orders = (table(spark, sf_dir, n) for n in ("lineitem", "nation", "orders"))
    component = F.col("l_orderkey").alias("component")
    members = lines.select(component, F.when(F.col("l_linenumber") % 2 == 1, "plan").otherwise("elevation").alias("role"), (F.col("l_suppkey") % 20).alias("sheet"))
    details = lines.where("l_returnflag = 'A'").select(component, (F.col("l_partkey") % 10).alias("sheet"))
    n = F.col("n_nationkey").cast("long")
    edge = lambda p, relation, target, ok: nation.select(F.concat(F.lit(p), n).alias("edge"), F.lit(relation).alias("relation"), (n % 20).alias("source"), target.alias("target"), F.when(ok, "PASS").otherwise("REVIEW").alias("status"))
    edges = edge("p", "plan_to_elevation", n * 7 % 20, n % 3 > 0).unionByName(edge("q", "plan_to_elevation", n * 3 % 20, n % 3 > 0)).unionByName(edge("d", "elevation_to_detail", n % 10, n % 4 > 0))
    chains = takeoff.component_chains(members, details, edges)
    k = F.col("o_orderkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    items = orders.select(
        k.alias("component"), pick(["m", "㎡", "kg", None, "件"], k % 5).alias("confirmed_unit"), pick(["by_length", "per area", None, "set", " "], F.expr("o_orderkey div 5 % 5")).alias("confirmed_method"),
        F.when(k % 11 > 0, (k % 90 + 10).cast("double")).alias("length_mm"), (k % 40 + 5).cast("double").alias("width_mm"), F.lit(None).cast("string").alias("unfolded_spec"), (k % 7 + 1).cast("double").alias("quantity"), F.when(k % 13 > 0, F.round(F.col("o_totalprice") / 1000, 2)).alias("unit_price"),
    )
    evidence = F.array_compact(F.array(F.lit("E0"), F.when(k % 24 == 6, "E1"), F.when(k % 30 == 0, "none")))
    confirmed = orders.where(k % 6 == 0).select(k.alias("component"), F.when(k % 12 != 0, "length_mm*quantity/1000").alias("expression"), F.when(k % 18 != 0, "as reviewed").otherwise(" ").alias("basis"), evidence.alias("evidence"))
    entities = nation.where("n_nationkey < 2").select(F.concat(F.lit("E"), n).alias("entity"), n.alias("sheet"))
    sheets = orders.select(k.alias("component"), F.lit(0).cast("long").alias("sheet"))
    out = takeoff.takeoff_rows(items, chains, takeoff.confirmed_quantities(confirmed, entities, sheets))
    return out.withColumns({c: F.col(c).cast("double") for c in ("engineering_quantity", "amount")})


_ANCHORS = ["name", "plan", "elevation", "detail"]
_TWO = """a AS (SELECT p_partkey AS l, p_partkey // 200 AS project, CASE WHEN p_partkey % 8 = 0 THEN 'c' || p_partkey END AS cid, CASE WHEN p_partkey % 8 = 1 THEN 'r' || p_partkey END AS rid, p_brand AS mt, p_name AS name, CAST(p_size AS VARCHAR) AS plan, p_type AS elevation, CASE WHEN p_partkey % 7 > 0 THEN 'd' || p_partkey % 4 END AS detail, p_retailprice AS price FROM part),
b AS (SELECT -l AS r, project, CASE WHEN l % 400 = 8 THEN 'c16' ELSE cid END AS cid, rid, CASE WHEN l % 50 = 3 THEN NULL ELSE mt END AS mt, CASE WHEN l % 8 IN (3, 4) THEN name || ' x' ELSE name END AS name, CASE WHEN l % 8 = 5 THEN '0' ELSE plan END AS plan, CASE WHEN l % 16 = 3 THEN 'zz' ELSE elevation END AS elevation, detail, CASE WHEN l % 9 = 0 THEN price * 1.2 ELSE price END AS price FROM a WHERE l % 29 > 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as predicted rows, and a reviewed copy in which some fields differ."""
    k = F.col("p_partkey")
    a = table(spark, sf_dir, "part").select(
        k.alias("l"), F.expr("p_partkey div 200").alias("project"), F.when(k % 8 == 0, F.concat(F.lit("c"), k)).alias("cid"), F.when(k % 8 == 1, F.concat(F.lit("r"), k)).alias("rid"), F.col("p_brand").alias("mt"), F.col("p_name").alias("name"),
        F.col("p_size").cast("string").alias("plan"), F.col("p_type").alias("elevation"), F.when(k % 7 > 0, F.concat(F.lit("d"), k % 4)).alias("detail"), F.col("p_retailprice").alias("price"),
    )
    i = F.col("l")
    b = a.where("l % 29 > 0").select(
        (-i).alias("r"), "project", F.when(i % 400 == 8, "c16").otherwise(F.col("cid")).alias("cid"), "rid", F.when(i % 50 != 3, F.col("mt")).alias("mt"), F.when((i % 8).isin(3, 4), F.concat("name", F.lit(" x"))).otherwise(F.col("name")).alias("name"),
        F.when(i % 8 == 5, "0").otherwise(F.col("plan")).alias("plan"), F.when(i % 16 == 3, "zz").otherwise(F.col("elevation")).alias("elevation"), "detail", F.when(i % 9 == 0, F.col("price") * 1.2).otherwise(F.col("price")).alias("price"),
    )
    return a, b


def _stage(n: int, keys: str, some: str) -> str:
    before = "" if n == 1 else " AND {0} NOT IN (SELECT {0} FROM m%d)" % (n - 1)
    one = "SELECT {k}, min({i}) AS {i} FROM {t} WHERE {s}{b} GROUP BY {k} HAVING count(*) = 1"
    sides = [one.format(k=keys, i=i, t=t, s=some, b=before.format(i)) for i, t in (("l", "a"), ("r", "b"))]
    same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys.split(", "))
    found = f"SELECT l, r, '{['component_id', 'row_id', 'signature'][n - 1]}' AS method FROM ({sides[0]}) x JOIN ({sides[1]}) y ON {same}"
    return f"m{n} AS ({found if n == 1 else f'SELECT * FROM m{n - 1} UNION ALL {found}'})"


_AGREE = " + ".join(f"CASE WHEN x.{c} = y.{c} THEN 1 ELSE 0 END" for c in _ANCHORS)
_MATCHES = f"""WITH RECURSIVE {_TWO}, {_stage(1, 'cid', 'cid IS NOT NULL')}, {_stage(2, 'rid', 'rid IS NOT NULL')}, {_stage(3, 'mt, name, plan, elevation, detail', 'mt IS NOT NULL AND coalesce(name, plan, elevation, detail) IS NOT NULL')},
pairs AS (SELECT l, r, {_AGREE} AS score FROM a x JOIN b y ON x.mt = y.mt WHERE l NOT IN (SELECT l FROM m3) AND r NOT IN (SELECT r FROM m3) AND {_AGREE} >= 2),
o AS (SELECT 1 AS n, l, r, score FROM pairs
  UNION ALL SELECT n + 1, l, r, score FROM (SELECT *, bool_or(t) OVER (PARTITION BY l) AS dl, bool_or(t) OVER (PARTITION BY r) AS dr, bool_or(t) OVER () AS hit FROM
    (SELECT *, tl AND tr AND sum(CASE WHEN tl THEN 1 ELSE 0 END) OVER (PARTITION BY l) = 1 AND sum(CASE WHEN tr THEN 1 ELSE 0 END) OVER (PARTITION BY r) = 1 AS t FROM
      (SELECT *, score = max(score) OVER (PARTITION BY l) AS tl, score = max(score) OVER (PARTITION BY r) AS tr FROM o))) WHERE hit AND NOT dl AND NOT dr),
matches AS (SELECT * FROM m3 UNION ALL SELECT l, r, 'mutual_best' FROM (SELECT *, tl AND tr AND sum(CASE WHEN tl THEN 1 ELSE 0 END) OVER (PARTITION BY n, l) = 1 AND sum(CASE WHEN tr THEN 1 ELSE 0 END) OVER (PARTITION BY n, r) = 1 AS t FROM
  (SELECT *, score = max(score) OVER (PARTITION BY n, l) AS tl, score = max(score) OVER (PARTITION BY n, r) AS tr FROM o)) WHERE t)"""


@query(f"{_MATCHES} SELECT * FROM matches")
def row_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four stages."""
    a, b = _sides(spark, sf_dir)
    return matching.match_rows(a, b, "cid", "rid", "mt", _ANCHORS)


@query(f"""{_MATCHES},
g AS (SELECT b.project, b.r, m.l, b.mt IS NOT NULL AND b.name IS NOT NULL AS eligible, CASE WHEN m.l IS NULL THEN CASE WHEN b.mt IS NULL THEN 'UNRESOLVED' ELSE 'FAIL' END WHEN b.mt IS NULL THEN 'UNRESOLVED' WHEN lower(replace(b.mt, ' ', '')) = lower(replace(a.mt, ' ', '')) THEN 'PASS' ELSE 'FAIL' END AS v1,
  CASE WHEN m.l IS NULL THEN 'FAIL' WHEN lower(replace(b.name, ' ', '')) = lower(replace(a.name, ' ', '')) THEN 'PASS' ELSE 'FAIL' END AS v2, CASE WHEN m.l IS NULL THEN 'FAIL' WHEN abs(a.price - b.price) <= abs(b.price) * 0.05 THEN 'PASS' ELSE 'FAIL' END AS v3 FROM b LEFT JOIN matches m USING (r) LEFT JOIN a ON a.l = m.l),
s AS (SELECT project, count(*) AS gold_rows, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND l IS NOT NULL AND v1 = 'PASS' AND v2 = 'PASS' AND v3 = 'PASS') AS correct, bool_or('UNRESOLVED' IN (v1, v2, v3)) AS unresolved FROM g GROUP BY project),
p AS (SELECT project, count(*) AS predicted_rows FROM a GROUP BY project),
d AS (SELECT project, count(*) AS n FROM (SELECT project, cid FROM b WHERE cid IS NOT NULL GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT project, rid FROM b WHERE rid IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY project)
SELECT project, coalesce(gold_rows, 0) AS gold_rows, coalesce(predicted_rows, 0) AS predicted_rows, coalesce(eligible, 0) AS eligible, coalesce(correct, 0) AS correct, coalesce(n, 0) AS duplicate_identities, correct / nullif(eligible, 0) AS recall, coalesce(correct / nullif(predicted_rows, 0), 0) AS precision,
  CASE WHEN coalesce(gold_rows, 0) = 0 OR eligible < gold_rows OR coalesce(n, 0) > 0 THEN 'BLOCKED' WHEN unresolved OR eligible = 0 THEN 'INDETERMINATE' WHEN correct / eligible >= 0.6 AND correct / predicted_rows >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS gate FROM s FULL JOIN p USING (project) LEFT JOIN d USING (project)""")
def project_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched rows by project, with invalid and repeated reviewed rows."""
    a, b = _sides(spark, sf_dir)
    found = matching.match_rows(a, b, "cid", "rid", "mt", _ANCHORS)
    outcomes = {n: (numeric.compare_text(F.col(n), F.col(f"p_{n}")), F.col(n).isNotNull()) for n in ("mt", "name")}
    outcomes["price"] = (numeric.compare_number(F.col("price"), F.col("p_price"), 0.05), F.col("price").isNotNull())
    return matching.evaluate_projects(a, b, found, outcomes, ["cid", "rid"], target=0.6)


#: Titles and rooms of sheets, with the likeness of each two as the reference of the SQL.
_TITLES = ["HALLSTAIR", "HALL", "LIFTLOBBY", "LOBBY", "ROOFGARDEN", "GARDENWALL", "KITCHEN"]
_ROOMS = ["ROOM101", "ROOM102", "OFFICE", "OFFICES", "ATRIUM"]


def _likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    return min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else SequenceMatcher(None, x, y).ratio()


def _likeness_sql(words: list[str]) -> str:
    return ", ".join(f"('{x}', '{y}', {_likeness(x, y)!r}::DOUBLE)" for x in words for y in words)


@query(f"""WITH tl(x, y, s) AS (VALUES {_likeness_sql(_TITLES)}), rl(x, y, s) AS (VALUES {_likeness_sql(_ROOMS)}),
m AS (SELECT l_suppkey AS sheet, list_sort(list_distinct(list(l_partkey % 997))) AS m FROM lineitem WHERE l_linenumber = 7 GROUP BY l_suppkey),
s AS (SELECT s_suppkey AS sheet, s_suppkey // 40 AS project, {_TITLES!r}[s_suppkey * 3 % 7 + 1] AS title, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 3 END AS floor, CASE WHEN s_suppkey % 4 > 0 THEN [{_ROOMS!r}[s_suppkey * 11 // 4 % 5 + 1]] END AS rooms, coalesce(m, []) AS m FROM supplier LEFT JOIN m ON m.sheet = s_suppkey),
f AS (SELECT sheet, sheet // 40 * 40 + sheet * 7 % 40 AS other, sheet % 2 = 0 AS by_number FROM s WHERE sheet % 3 = 0), k AS (SELECT sheet, sheet // 40 * 40 + sheet * 11 % 40 AS other FROM s WHERE sheet % 13 = 0),
p AS (SELECT a.sheet, b.sheet AS other, f.sheet IS NOT NULL AS explicit, coalesce(by_number, false) AS by_number, k.sheet IS NOT NULL AS confirmed, tl.s AS ts, coalesce(list_has_any(a.rooms, b.rooms), false) AS same, rl.s AS rs, len(list_intersect(a.m, b.m)) AS n, len(list_distinct(list_concat(a.m, b.m))) AS u, a.floor AS f1, b.floor AS f2
  FROM s a JOIN s b ON a.project = b.project AND a.sheet % 2 = 0 AND b.sheet % 2 = 1 LEFT JOIN f ON f.sheet = a.sheet AND f.other = b.sheet LEFT JOIN k ON k.sheet = a.sheet AND k.other = b.sheet LEFT JOIN tl ON tl.x = a.title AND tl.y = b.title LEFT JOIN rl ON rl.x = a.rooms[1] AND rl.y = b.rooms[1]),
c AS (SELECT *, round(least(CASE WHEN confirmed THEN 1.0::DOUBLE WHEN explicit THEN 0.74::DOUBLE ELSE 0.02::DOUBLE END + CASE WHEN n > 0 THEN 0.10::DOUBLE + 0.08::DOUBLE * n / u ELSE 0.0::DOUBLE END + CASE WHEN same THEN 0.15::DOUBLE WHEN rs >= 0.65 THEN 0.08::DOUBLE * rs ELSE 0.0::DOUBLE END + CASE WHEN ts >= 0.25 THEN 0.10::DOUBLE * ts ELSE 0.0::DOUBLE END, 1.0), 6) AS score
  FROM p WHERE confirmed OR by_number OR f1 IS NULL OR f2 IS NULL OR f1 = f2),
j AS (SELECT *, confirmed OR (explicit AND count(*) FILTER (WHERE explicit) OVER (PARTITION BY sheet) = 1 AND NOT bool_or(confirmed) OVER (PARTITION BY sheet)) AS passed FROM c WHERE score >= 0.05),
r AS (SELECT *, passed OR by_number AS firm, row_number() OVER (PARTITION BY sheet, passed OR by_number ORDER BY score DESC, other) AS rank FROM j)
SELECT sheet, other, score, explicit, CASE WHEN passed THEN 'PASS' ELSE 'REVIEW' END AS status FROM r WHERE firm OR rank <= 5""")
def relation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd suppliers as sheets of two kinds, forty a project."""
    k = F.col("s_suppkey")
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    materials = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set(F.col("l_partkey") % 997).alias("materials"))
    sheets = table(spark, sf_dir, "supplier").join(materials, "s_suppkey", "left").select(
        k.alias("sheet"), F.expr("s_suppkey div 40").alias("project"), pick(_TITLES, k * 3 % 7).alias("title"), F.when(k % 5 > 0, k % 3).alias("floor"),
        F.when(k % 4 > 0, F.array(pick(_ROOMS, F.expr("s_suppkey * 11 div 4 % 5")))).alias("rooms"), F.coalesce("materials", F.array().cast("array<bigint>")).alias("materials"),
    )
    s = F.col("sheet")
    references = sheets.where(s % 3 == 0).select("sheet", F.expr("sheet div 40 * 40 + sheet * 7 % 40").alias("other"), (s % 2 == 0).alias("by_number"))
    confirmed = sheets.where(s % 13 == 0).select("sheet", F.expr("sheet div 40 * 40 + sheet * 11 % 40").alias("other"))
    return catalog.rank_relations(sheets.where(s % 2 == 0), sheets.where(s % 2 == 1), references, confirmed)
