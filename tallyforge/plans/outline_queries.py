"""Queries of broken views and closed outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import viewports
from tallyforge.plans.registry import query, table

_VIEWS = """v AS (SELECT o_custkey AS sheet, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0.2 ELSE 0.1 END AS scale, (o_orderkey % 4) * 104.0 + o_orderkey // 4 % 2 * 3000.0 AS x0, (o_orderkey // 8 % 3) * 83.0 AS y0,
  (o_orderkey % 4) * 104.0 + o_orderkey // 4 % 2 * 3000.0 + 100.0 AS x1, (o_orderkey // 8 % 3) * 83.0 + 80.0 AS y1, (o_orderkey % 4) * 1500.0 AS mx0, (o_orderkey // 8 % 3) * 900.0 AS my0, (o_orderkey % 4) * 1500.0 + 1000.0 AS mx1, (o_orderkey // 8 % 3) * 900.0 + 800.0 AS my1 FROM orders)"""


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each customer, on which each order is a view: parts of broken views in two grids."""
    k = F.col("o_orderkey")
    n = lambda c: F.expr(c).cast("double")
    x, y = n("o_orderkey % 4 * 104 + o_orderkey div 4 % 2 * 3000"), n("o_orderkey div 8 % 3 * 83")
    mx, my = n("o_orderkey % 4 * 1500"), n("o_orderkey div 8 % 3 * 900")
    scale = F.when(k % 3 == 0, 0.2).otherwise(0.1)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sheet"), k.alias("view_id"), scale.alias("scale"), x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 80).alias("y1"), mx.alias("mx0"), my.alias("my0"), (mx + 1000).alias("mx1"), (my + 800).alias("my1"))


@query(f"""WITH RECURSIVE {_VIEWS},
e AS (SELECT p.sheet, p.id AS a, q.id AS b FROM v p JOIN v q ON p.sheet = q.sheet AND p.scale = q.scale AND (
  p.y0 = q.y0 AND p.my0 = q.my0 AND q.x0 - p.x1 > 0 AND q.x0 - p.x1 <= 4.8 AND q.mx0 > p.mx1 OR p.x0 = q.x0 AND p.mx0 = q.mx0 AND q.y0 - p.y1 > 0 AND q.y0 - p.y1 <= 6 AND q.my0 > p.my1)),
r AS (SELECT sheet, id AS a, id AS b FROM v UNION SELECT r.sheet, r.a, n.b FROM r JOIN (SELECT sheet, a, b FROM e UNION ALL SELECT sheet, b, a FROM e) n ON n.sheet = r.sheet AND n.a = r.b),
c AS (SELECT r.sheet, r.a AS view_id, min(b) AS chain, count(*) AS parts, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r JOIN v ON v.id = r.b GROUP BY r.sheet, r.a)
SELECT sheet, view_id, chain, parts, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM c""")
def viewport_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of neighbouring parts of broken views."""
    return viewports.view_chains(_views(spark, sf_dir), "sheet")


@query("""WITH p AS (SELECT p_partkey AS sheet, p_size + 10 AS w, p_partkey % 7 + 5 AS h, p_size % 9 + 1 AS x, p_partkey % 2 = 0 AS wall, p_partkey % 3 = 0 AS nested FROM part)
SELECT sheet, (w * h)::DOUBLE AS area, (2 * (w + h))::DOUBLE AS perimeter, 6::BIGINT AS sides FROM p WHERE NOT wall
UNION ALL SELECT sheet, (x * h)::DOUBLE, (2 * (x + h))::DOUBLE, 4::BIGINT FROM p WHERE wall
UNION ALL SELECT sheet, ((w - x) * h)::DOUBLE, (2 * (w - x + h))::DOUBLE, 4::BIGINT FROM p WHERE wall
UNION ALL SELECT sheet, 0.25::DOUBLE, 2::DOUBLE, 4::BIGINT FROM p WHERE nested""")
def closed_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: a sheet for each part with a rectangle, in two of which a wall makes two that touch, and in three of which another is nested."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet"), (F.col("p_size") + 10).alias("w"), (F.col("p_partkey") % 7 + 5).alias("h"), (F.col("p_size") % 9 + 1).alias("x"))
    s = lambda n, a, b, c, d: F.struct(F.lit(n).alias("segment_id"), *[(F.expr(e) if isinstance(e, str) else F.lit(e)).cast("double").alias(k) for e, k in ((a, "x0"), (b, "y0"), (c, "x1"), (d, "y1"))])
    outer = [s(0, 0, 0, "x", 0), s(1, "x", 0, "w", 0), s(2, "w", 0, "w", "h"), s(3, "w", "h", "x", "h"), s(4, "x", "h", 0, "h"), s(5, 0, "h", 0, 0)]
    inner = [s(7, 0.25, 1, 0.75, 1), s(8, 0.75, 1, 0.75, 1.5), s(9, 0.75, 1.5, 0.25, 1.5), s(10, 0.25, 1.5, 0.25, 1)]
    none = F.filter(F.array(*outer), lambda _: F.lit(False))
    every = F.concat(F.array(*outer), F.when(F.col("sheet") % 2 == 0, F.array(s(6, "x", 0, "x", "h"))).otherwise(none), F.when(F.col("sheet") % 3 == 0, F.array(*inner)).otherwise(none))
    segments = p.select("sheet", F.inline(every))
    found = viewports.closed_outlines(viewports.outline_faces(segments, "sheet"), "sheet")
    return found.select("sheet", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"), "sides")
