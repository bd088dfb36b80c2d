"""Queries of quantities, prices and evidence on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import numeric
from tallyforge.operators import pricing
from tallyforge.plans.registry import query, table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as takeoff items: the unit by return flag and status, sizes from the part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")
    unit = F.when(F.col("l_returnflag") == "A", "m").when(F.col("l_returnflag") == "R", "㎡").when(F.col("l_linestatus") == "O", "件").when(F.col("l_linenumber") % 2 == 0, "套")
    spec = F.concat_ws("+", F.col("p_size"), F.col("p_size") * 2, F.lit(10))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "p_brand", "p_type", unit.alias("unit"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), F.when(F.col("p_size") > 2, (F.col("p_size") * 100).cast("double")).alias("length_mm"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")).alias("width_mm"), F.when(F.col("p_size") % 5 > 0, spec).alias("unfolded_spec"),
        F.when(F.col("l_linenumber") != 5, F.col("p_retailprice")).alias("unit_price"),
    )


ITEMS_SQL = """items AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, p_brand, p_type,
  CASE WHEN l_returnflag = 'A' THEN 'm' WHEN l_returnflag = 'R' THEN '㎡' WHEN l_linestatus = 'O' THEN '件' WHEN l_linenumber % 2 = 0 THEN '套' END AS unit,
  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity, CASE WHEN p_size > 2 THEN CAST(p_size * 100 AS DOUBLE) END AS length_mm,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS width_mm, CASE WHEN p_size % 5 > 0 THEN p_size + p_size * 2 + 10 END AS unfolded,
  CASE WHEN l_linenumber <> 5 THEN p_retailprice END AS unit_price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CALC_SQL = f"""{ITEMS_SQL},
typed AS (SELECT *, CAST(quantity AS DECIMAL(10,2)) AS q, CAST(length_mm AS DECIMAL(10,2)) AS len, coalesce(CAST(width_mm AS DECIMAL(10,2)), CAST(unfolded AS DECIMAL(10,2))) AS wid, CAST(unit_price AS DECIMAL(10,2)) AS p FROM items),
ex AS (SELECT *, CASE WHEN unit = 'm' THEN CAST(len * q * CAST(0.001 AS DECIMAL(3,3)) AS DECIMAL(26,9)) WHEN unit = '㎡' THEN CAST(wid * len * q * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(26,9)) ELSE CAST(q AS DECIMAL(26,9)) END AS exact,
  CASE WHEN unit IS NULL THEN 'unit' WHEN q IS NULL THEN 'quantity' WHEN unit IN ('m', '㎡') AND len IS NULL THEN 'length' WHEN unit = '㎡' AND wid IS NULL THEN 'width' END AS block_reason FROM typed),
calc AS (SELECT *, CASE WHEN block_reason IS NULL THEN round(exact, 6) END AS engineering_quantity, CASE WHEN block_reason IS NULL THEN round(CAST(exact AS DECIMAL(20,9)) * p, 2) END AS amount,
  CASE WHEN block_reason IS NOT NULL THEN 'BLOCK' WHEN p IS NULL THEN 'REVIEW' ELSE 'PASS' END AS status FROM ex)"""


@query(f"WITH {CALC_SQL} SELECT l_orderkey, l_linenumber, unit, CAST(engineering_quantity AS DOUBLE) AS engineering_quantity, CAST(amount AS DOUBLE) AS amount, status, block_reason FROM calc")
def item_calculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 to M5."""
    out = pricing.calculate_items(items(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "unit", F.col("engineering_quantity").cast("double"), F.col("amount").cast("double"), "status", "block_reason")


@query(f"WITH {CALC_SQL} SELECT p_brand, status, count(*) AS items, CAST(sum(amount) AS DOUBLE) AS amount FROM calc GROUP BY ALL")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    out = pricing.totals(pricing.calculate_items(items(spark, sf_dir)), "p_brand")
    return out.withColumn("amount", F.col("amount").cast("double"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price book from the parts: two validity periods; some entries not approved, some given twice."""
    parts = table(spark, sf_dir, "part")
    period = F.explode(F.array(F.struct(F.lit("a").alias("v"), F.lit("1992-01-01").alias("f"), F.lit("1995-06-30").alias("t")), F.struct(F.lit("b").alias("v"), F.lit("1995-07-01T00:00:00Z").alias("f"), F.lit(None).cast("string").alias("t"))))
    book = parts.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k"), F.max("p_size").alias("p_size"), F.round(F.max("p_retailprice"), 2).alias("price")).withColumn("p", period)
    return book.select(F.concat(F.col("k"), F.lit("-"), F.col("p.v")).alias("price_id"), F.upper("p_brand").alias("p_brand"), "p_type", F.col("price").alias("unit_price"), (F.col("k") % 7 != 0).alias("approved"), F.col("p.f").alias("valid_from"), F.when(F.col("k") % 11 != 0, F.col("p.t")).alias("valid_to"))


@query("""
WITH book AS (SELECT p_brand, p_type, min(p_partkey) AS k, round(max(p_retailprice), 2) AS price FROM part GROUP BY ALL),
prices AS (SELECT CAST(k AS VARCHAR) || '-' || v AS price_id, p_brand, p_type, price, f, CASE WHEN k % 11 <> 0 THEN t END AS t
  FROM book, (VALUES ('a', DATE '1992-01-01', DATE '1995-06-30'), ('b', DATE '1995-07-01', NULL)) AS x(v, f, t) WHERE k % 7 <> 0),
i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, p_type, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT w.p_brand, w.p_type, day, count(*) AS candidates, min(price_id) AS price_id, min(price) AS unit_price FROM (SELECT DISTINCT p_brand, p_type, day FROM i) w JOIN prices ON prices.p_brand = w.p_brand AND prices.p_type = w.p_type AND day >= f AND (t IS NULL OR day <= t) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN price_id END AS price_id, CASE WHEN candidates = 1 THEN unit_price END AS unit_price,
  CASE WHEN candidates IS NULL THEN 'no_price' WHEN candidates > 1 THEN 'ambiguous' END AS reason FROM i LEFT JOIN m USING (p_brand, p_type, day)""")
def price_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, M13."""
    rows = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_type", F.col("l_shipdate").cast("date").alias("day"))
    out = pricing.match_prices(rows, prices(spark, sf_dir), ["p_brand", "p_type"], "day")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "candidates", "price_id", "unit_price", "reason")


@query("""
WITH s AS (SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS variants, bool_or(l_tax > 0.07) AS conflicted, min(l_returnflag) AS f, min(l_linestatus) AS t FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, variants, conflicted, CASE WHEN variants = 1 AND NOT conflicted THEN f END AS l_returnflag, CASE WHEN variants = 1 AND NOT conflicted THEN t END AS l_linestatus FROM s""")
def unique_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    specs = table(spark, sf_dir, "lineitem")
    out = pricing.unique_specs(specs, "l_orderkey", ["l_returnflag", "l_linestatus"], F.col("l_tax") > 0.07, "l_partkey")
    return out.select("l_orderkey", "variants", "conflicted", "spec.l_returnflag", "spec.l_linestatus")


@query("""
WITH s AS (SELECT p_name, list_sort(list_distinct(list(p_brand))) AS b, list_sort(list_distinct(list(CAST(p_size AS VARCHAR)))) AS z FROM part GROUP BY p_name)
SELECT p_name, concat_ws(';', CASE WHEN len(b) > 1 THEN 'p_brand: ' || array_to_string(b, ' | ') END, CASE WHEN len(z) > 1 THEN 'p_size: ' || array_to_string(z, ' | ') END) AS conflicts FROM s WHERE len(b) > 1 OR len(z) > 1""")
def material_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    return pricing.conflicts(table(spark, sf_dir, "part"), "p_name", ["p_brand", "p_size"]).withColumn("conflicts", F.array_join("conflicts", ";"))


@query("""SELECT l_orderkey, count(DISTINCT l_returnflag) AS "values", string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS sources, 'BLOCK' AS status FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1 AND count(DISTINCT l_linestatus) > 1""")
def cross_source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return pricing.cross_source_conflicts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


@query("""SELECT user_id, event_type, CASE WHEN count(DISTINCT trim(json_extract_string(props, '$.k'))) = 1 THEN max(trim(json_extract_string(props, '$.k'))) END AS k, count(DISTINCT trim(json_extract_string(props, '$.k'))) AS "values" FROM events GROUP BY user_id, event_type""")
def consensus_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, C1."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return pricing.consensus(events, ["user_id", "event_type"], "k")


@query("""SELECT user_id, event_type, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY ALL""")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return pricing.first_issues(events, ["user_id", "event_type"], ["value", "event_id"])


@query("""
WITH c AS (SELECT DISTINCT l_orderkey, l_partkey * 100 + l_suppkey % 100 AS evidence FROM lineitem),
s AS (SELECT evidence FROM c GROUP BY evidence HAVING count(DISTINCT l_orderkey) > 1)
SELECT l_orderkey, count(*) AS evidence_count, count(s.evidence) AS shared_evidence, CASE WHEN count(s.evidence) > 0 THEN 'BLOCK' ELSE 'PASS' END AS status FROM c LEFT JOIN s USING (evidence) GROUP BY l_orderkey""")
def exclusive_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G25."""
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_partkey * 100 + l_suppkey % 100").alias("evidence"))
    return pricing.exclusive_owners(claims, "l_orderkey", "evidence")


@query("""
WITH h AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey),
m AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'REVIEW' END AS status, CAST(o_totalprice AS DECIMAL(14,2)) AS amount,
  concat_ws(',', CASE WHEN NOT coalesce(a, false) THEN 'A' END, CASE WHEN NOT coalesce(n, false) THEN 'N' END, CASE WHEN NOT coalesce(r, false) THEN 'R' END) AS missing FROM orders LEFT JOIN h ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN status = 'PASS' AND missing <> '' THEN 'REVIEW' ELSE status END AS status, CASE WHEN NOT (status = 'PASS' AND missing <> '') THEN CAST(amount AS DOUBLE) END AS amount, missing FROM m""")
def relation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("REVIEW").alias("status"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"))
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return pricing.stage_gate(orders, records, "o_orderkey", "l_returnflag", ["A", "N", "R"]).withColumn("amount", F.col("amount").cast("double"))


@query("""
WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_size * 100 AS DOUBLE) AS l, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS quantity, p_retailprice / 1000 AS reported FROM part),
b AS (SELECT *, CAST(CAST(CAST(w AS DECIMAL(10,2)) * CAST(l AS DECIMAL(10,2)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(20,6)) AS DOUBLE) AS base FROM r),
i AS (SELECT *, round(reported / base) AS whole FROM b),
j AS (SELECT *, CASE WHEN abs(reported - whole * base) <= greatest(0.01, abs(reported) * 0.0001) AND whole BETWEEN 1 AND 100000 THEN CAST(whole AS BIGINT) END AS implied FROM i)
SELECT p_partkey, implied, CASE WHEN implied IS NULL THEN 'unexplained' WHEN quantity IS NULL OR quantity = implied THEN 'match' ELSE 'mismatch' END AS finding FROM j""")
def quantity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("width_mm"), (F.col("p_size") * 100).cast("double").alias("length_mm"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("quantity"), (F.col("p_retailprice") / 1000).alias("reported"))
    return pricing.audit_quantity(rows).select("p_partkey", "implied", "finding")


@query("SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN least(0.45, floor(value) / 200) ELSE least(0.95, floor(value) / 200 + 0.25 * greatest(0.0, 1 - value / 100.0)) END, 6) AS confidence FROM events")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11."""
    events = table(spark, sf_dir, "events")
    distance = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return events.select("event_id", numeric.confidence(F.floor("value") / 200, distance, 100.0).alias("confidence"))
