"""Queries of readers' relational parts, audits and sinks. Tables that are written lie in the job's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.checkpoints import checkpoint_root
from tallyforge.plans.registry import query, table
from tallyforge.sources import drawings, files, sinks, workbooks


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/written-{uuid.uuid4().hex}"


@query("""WITH m AS (SELECT l_orderkey AS path, CASE l_partkey % 9 WHEN 0 THEN '../' || l_linenumber WHEN 1 THEN '/etc/' || l_linenumber WHEN 2 THEN 'a\\b' WHEN 3 THEN 'x/nul.txt' WHEN 4 THEN 'A/Same' ELSE 'dir/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS member, CAST(l_quantity AS BIGINT) * 1000 AS bytes,
  CASE WHEN l_suppkey % 10 = 0 THEN 10 ELSE 1000 END AS packed, l_suppkey % 13 = 0 AS encrypted, l_suppkey % 17 = 0 AS link FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY path, lower(member)) AS same FROM m)
SELECT path, member, bytes, CASE WHEN encrypted THEN 'encrypted' WHEN link THEN 'link' WHEN member LIKE '/%' THEN 'absolute' WHEN contains(member, '\\') THEN 'backslash' WHEN member LIKE '../%' THEN 'traversal' WHEN member = 'x/nul.txt' THEN 'reserved'
  WHEN same > 1 THEN 'collision' WHEN bytes / packed > 200 THEN 'ratio' END AS problem FROM n""".replace("\\\\", "\\"))
def member_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of packages with the first reason to refuse them."""
    k, s = F.col("l_partkey") % 9, F.col("l_suppkey")
    name = F.when(k == 0, F.concat(F.lit("../"), "l_linenumber")).when(k == 1, F.concat(F.lit("/etc/"), "l_linenumber")).when(k == 2, "a\\b").when(k == 3, "x/nul.txt").when(k == 4, "A/Same").otherwise(F.concat(F.lit("dir/"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), name.alias("member"), (F.col("l_quantity").cast("long") * 1000).alias("bytes"), F.when(s % 10 == 0, 10).otherwise(1000).cast("long").alias("packed"), (s % 13 == 0).alias("encrypted"), (s % 17 == 0).alias("link"))
    return files.audit_members(members).select("path", "member", "bytes", "problem")


@query("""WITH a AS (SELECT l_orderkey AS drawing, ['one', 'two', 'three'][l_partkey % 3 + 1] AS tool, CASE WHEN l_suppkey % 4 = 0 THEN 'out-' || l_suppkey END AS output, CASE WHEN l_suppkey % 4 > 0 THEN 'error-' || l_suppkey END AS error FROM lineitem),
r AS (SELECT *, CASE tool WHEN 'two' THEN 1 WHEN 'one' THEN 2 ELSE 3 END AS r FROM a),
g AS (SELECT drawing, count(*) AS attempts, min((r, tool, output)) FILTER (WHERE output IS NOT NULL) AS b, max((r, coalesce(error, ''))) AS e FROM r GROUP BY drawing)
SELECT drawing, attempts, b[2] AS tool, b[3] AS output, CASE WHEN b IS NULL THEN nullif(e[2], '') END AS error FROM g""")
def conversion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawing's first successful conversion by preference, or the last error."""
    s = F.col("l_suppkey")
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("drawing"), F.get(F.array(*map(F.lit, ("one", "two", "three"))), (F.col("l_partkey") % 3).cast("int")).alias("tool"), F.when(s % 4 == 0, F.concat(F.lit("out-"), s)).alias("output"), F.when(s % 4 > 0, F.concat(F.lit("error-"), s)).alias("error"))
    return files.conversions(attempts, ["two", "one"])


@query("""SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS INT) AS "row", p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part""")
def headed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a header row, from single cells; a workbook for each brand."""
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1)
    cell = lambda row, col, c: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), c.cast("string").alias("text"))
    body = parts.select("p_brand", F.explode(F.array(cell(F.col("n"), 2, F.concat(F.lit(" "), "p_name")), cell(F.col("n"), 3, F.col("p_size")))).alias("c"))
    head = parts.select("p_brand").distinct().select("p_brand", F.explode(F.array(cell(F.lit(1), 2, F.lit("Part Name")), cell(F.lit(1), 3, F.lit("SIZE")))).alias("c"))
    cells = head.unionByName(body).select(F.col("p_brand").alias("path"), F.lit("sheet1").alias("sheet"), "c.*", F.lit(None).cast("string").alias("problem"))
    return workbooks.headed_rows(cells, {"name": ["Part name"], "size": []}).select("path", "row", "name", "size")


@query("""WITH r AS (SELECT p_brand AS path, p_partkey AS entry, CASE WHEN p_brand LIKE '%2' AND p_partkey % 50 = 0 THEN 'no' ELSE 'Yes' END AS approved, 'v' || (p_size // 20) AS version FROM part)
SELECT path, entry, bool_and(approved = 'Yes') OVER (PARTITION BY path) AS book_approved, b.v AS book_version FROM r JOIN (SELECT path, string_agg(DISTINCT version, '+' ORDER BY version) AS v FROM r GROUP BY path) b USING (path)""")
def price_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of price books with the book's approval and version."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("entry"), F.when(F.col("p_brand").endswith("2") & (F.col("p_partkey") % 50 == 0), "no").otherwise("Yes").alias("approved"), F.concat(F.lit("v"), F.expr("p_size div 20")).alias("version"))
    return workbooks.price_book(rows).select("path", "entry", "book_approved", "book_version")


@query("""SELECT p_brand, p_size, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS locators, count(*) AS mentions FROM part GROUP BY ALL""")
def merged_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec for each identity, with its locators."""
    out = workbooks.merged_specs(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_type")
    return out.withColumn("locators", F.array_join("locators", "|"))


@query("""SELECT event_id, user_id, event_type, value, CAST(NULL AS VARCHAR) AS problem FROM events""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read again by a strict schema."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = _folder(spark)
    sinks.write_json(events, path)
    return files.read_records(spark, path, events.schema, multiline=False)


@query("""SELECT user_id AS source_file_id, event_id, CASE WHEN user_id % 3 = 0 THEN 'second' ELSE event_type END AS state FROM events WHERE user_id % 3 > 0 OR event_id % 2 = 0""")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: an index in which a third of the sources is replaced by a second run, the others stay, though they share files with them."""
    index = sinks.SourceIndex(spark, _folder(spark), "source_file_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_file_id"), "event_id", F.col("event_type").alias("state"))
    index.upsert(events)
    index.upsert(events.where("source_file_id % 3 = 0 and event_id % 2 = 0").withColumn("state", F.lit("second")))
    return index.read()


@query("""SELECT o_custkey, '{"o_custkey":' || o_custkey || ',"candidates":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS document FROM orders GROUP BY o_custkey""")
def review_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a JSON document of all candidates of a customer."""
    return sinks.review_pack(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"])


@query("""SELECT '| ' || p_partkey || ' | ' || p_name || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE replace(p_brand || '|' || p_size, '|', '\\|') END || ' |' AS line FROM part""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: lines of a Markdown table."""
    parts = table(spark, sf_dir, "part").withColumn("b", F.when(F.col("p_partkey") % 3 > 0, F.concat("p_brand", F.lit("|"), "p_size")))
    return sinks.markdown_lines(parts, ["p_partkey", "p_name", "b"])


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing for each customer: block B (a line, a text, a circle, a dimension and a leader, base 1, 1), block N that shows B turned by 90 degrees, and an insert of N for each order."""
    pairs = lambda *xs: F.lit("\n".join(map(str, xs)))
    inner = [0, "LINE", 5, "L", 8, "wall", 10, 1, 20, 1, 11, 11, 21, 1, 0, "TEXT", 5, "T", 8, "note", 1, "MT-01\u2028\x85 \x0cx", 10, 3, 20, 4, 0, "CIRCLE", 5, "C", 8, "wall", 10, 5, 20, 5, 40, 2, 0, "DIMENSION", 5, "D", 8, "dim", 10, 1, 20, 3, 13, 1, 23, 1, 14, 11, 24, 1, 42, 10, 0, "LEADER", 5, "P", 8, "note", 10, 2, 20, 2, 10, 6, 20, 8]
    head = pairs(0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "B", 10, 1, 20, 1, *inner, 0, "ENDBLK", 0, "BLOCK", 2, "N", 10, 0, 20, 0, 0, "INSERT", 5, "I", 2, "B", 10, 5, 20, 5, 50, 90, 0, "ENDBLK", 0, "ENDSEC", 0, "SECTION", 2, "ENTITIES")
    k = F.col("o_orderkey")
    insert = F.concat_ws("\n", pairs(0, "INSERT", 5), F.concat(F.lit("X"), k), pairs(8, "view", 2, "N", 10), k % 1000, pairs(20), k % 300, pairs(41), k % 3 + 1, pairs(42), k % 3 + 1, pairs(67), k % 2)
    files_ = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.sort_array(F.collect_list(insert)).alias("inserts"))
    return files_.select("path", F.concat_ws("\n", head, F.array_join("inserts", "\n"), pairs(0, "ENDSEC", 0, "EOF", "")).cast("binary").alias("content"))


_INDEX = """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, 'X' || o_orderkey AS h, CASE WHEN o_orderkey % 2 = 1 THEN 'paper' ELSE 'model' END AS space, CAST(o_orderkey % 1000 AS DOUBLE) AS u, CAST(o_orderkey % 300 AS DOUBLE) AS v, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS s FROM orders),
e(kind, handle, layer, text, level, x, y, x0, y0, x1, y1, m) AS (VALUES ('INSERT', '', 'view', 'N', 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, NULL), ('INSERT', '/I', NULL, 'B', 1, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, NULL),
  ('LINE', '/I/L', 'wall', NULL, 2, 5.0, 5.0, 5.0, 5.0, 5.0, 15.0, NULL), ('TEXT', '/I/T', 'note', 'MT-01' || chr(8232) || chr(133) || ' ' || chr(12) || 'x', 2, 2.0, 7.0, 2.0, 7.0, 2.0, 7.0, NULL), ('CIRCLE', '/I/C', 'wall', NULL, 2, 1.0, 9.0, -1.0, 7.0, 3.0, 11.0, NULL),
  ('DIMENSION', '/I/D', 'dim', NULL, 2, 3.0, 5.0, 3.0, 5.0, 5.0, 15.0, 10.0), ('LEADER', '/I/P', 'note', NULL, 2, 4.0, 6.0, -2.0, 6.0, 4.0, 10.0, NULL)),
i AS (SELECT path, level, kind, h || handle AS handle, layer, space, text, CASE WHEN level = 1 THEN 'N' WHEN level = 2 THEN 'B' END AS block, u + s * x AS x, v + s * y AS y, u + s * x0 AS x0, v + s * y0 AS y0, u + s * x1 AS x1, v + s * y1 AS y1, m AS measured FROM o, e)"""


@query(f"{_INDEX} SELECT path, CAST(level AS INT) AS level, kind, handle, layer, space, text, block, round(x, 6) AS x, round(y, 6) AS y, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, CAST(measured AS DOUBLE) AS measured, false AS truncated FROM i")
def drawing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of text drawings, two levels of blocks moved, scaled and turned."""
    out = drawings.drawing_entities(_drawings(spark, sf_dir))
    return out.select("path", "level", "kind", "handle", "layer", "space", "text", "block", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "x0", "y0", "x1", "y1")], "measured", "truncated")


@query(f"{_INDEX}, r AS (SELECT c_custkey AS region, CAST(c_custkey AS VARCHAR) AS path, 100.5::DOUBLE AS x0, 20.5::DOUBLE AS y0, 700.5::DOUBLE AS x1, 200.5::DOUBLE AS y1 FROM customer) SELECT region, count(handle) AS entities, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS layers, false AS truncated FROM r LEFT JOIN i ON i.path = r.path AND i.x0 <= r.x1 AND r.x0 <= i.x1 AND i.y0 <= r.y1 AND r.y0 <= i.y1 GROUP BY region")
def region_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: what regions of the drawings hold."""
    regions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("region"), F.col("c_custkey").cast("string").alias("path"), F.lit(100.5).alias("x0"), F.lit(20.5).alias("y0"), F.lit(700.5).alias("x1"), F.lit(200.5).alias("y1"))
    index = drawings.drawing_entities(_drawings(spark, sf_dir), regions=regions)
    return drawings.probe_regions(index, regions, 250.0)
