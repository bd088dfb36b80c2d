"""Queries of single text, code and number functions, each with the SQL of what it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import numeric, text
from tallyforge.operators import assembly, rules
from tallyforge.plans.registry import query, table
from tallyforge.sources import workbooks


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("""SELECT p_partkey, 'MT-1 ' || p_name || ' - X' AS plain, 'mt-1 ' || lower(p_name) || ' - x' AS folded, 'MT-1' || replace(p_name, ' ', '') || '-X' AS compact, 'mt-1' || lower(replace(p_name, ' ', '')) || '-x' AS key FROM part""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width letters, dashes and wide spaces around part names, in the four forms."""
    raw = F.concat(F.lit("ＭＴ–１　　"), "p_name", F.lit(" \t— Ｘ "))
    forms = {"plain": text.plain_text, "folded": text.folded_text, "compact": text.compact_text, "key": text.match_key}
    return _parts(spark, sf_dir).select("p_partkey", *[f(raw).alias(n) for n, f in forms.items()])


@query("""SELECT p_partkey, p_name || ' ' || p_brand || ' 1/' || p_size || 'mm' AS shown FROM part""")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: formatted text without its control codes."""
    raw = F.concat(F.lit(r"{\fArial|b0;\H2.5x;"), "p_name", F.lit(r"\P\C1;\L"), "p_brand", F.lit(r"\l}\~\S1^"), "p_size", F.lit(r";mm"))
    return _parts(spark, sf_dir).select("p_partkey", text.clean_markup(raw).alias("shown"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'height' WHEN 1 THEN 'quantity' WHEN 2 THEN 'length' WHEN 4 THEN 'width' END AS role, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS n FROM part""")
def attribute_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of attribute tags and counts in texts."""
    k = F.col("p_partkey")
    tag = F.get(F.array(*map(F.lit, ("HT", " qty ", "Len", "note", "WIDTH"))), (k % 5).cast("int"))
    shown = F.when(k % 4 == 0, F.concat(F.lit("x "), "p_size")).when(k % 4 == 1, F.concat("p_size", F.lit("pcs"))).when(k % 4 == 2, F.concat(F.lit("Qty: "), "p_size", F.lit(" sets"))).otherwise("as drawn")
    return _parts(spark, sf_dir).select("p_partkey", text.attribute_role(tag).alias("role"), text.count_token(shown).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name ELSE p_name || ' ' || p_size END AS base, CASE p_partkey % 3 WHEN 0 THEN 'B' END AS variant FROM part""")
def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that end in a number and a letter, in a number, or in neither."""
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat("p_name", F.lit(" "), "p_size", F.lit(" -b "))).when(k % 3 == 1, F.concat("p_name", F.lit(" "), "p_size")).otherwise(F.col("p_name"))
    return _parts(spark, sf_dir).select("p_partkey", text.row_variant(title).alias("v")).select("p_partkey", "v.base", "v.variant")


@query("""SELECT p_partkey, ['m', 'm', '㎡', '㎡', '套', '件', NULL][p_partkey % 7 + 1] AS unit FROM part""")
def pricing_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the unit that a pricing method names."""
    methods = F.array(*map(F.lit, ("by_length", "Linear metre", "AREA", "per square", "set", "piece", None)))
    return _parts(spark, sf_dir).select("p_partkey", numeric.unit_of(F.get(methods, (F.col("p_partkey") % 7).cast("int"))).alias("unit"))


@query("""WITH s AS (SELECT p_partkey, p_size::DOUBLE AS w, (p_partkey % 50)::DOUBLE AS px, (p_partkey % 30 - 10)::DOUBLE AS py FROM part), t AS (SELECT *, greatest(0, least(1, (px * w + py * 2 * w) / (5 * w * w))) AS t FROM s)
SELECT p_partkey, round(sqrt((px - t * w) ** 2 + (py - t * 2 * w) ** 2), 6) AS distance, round(w * (w + 3) + 0.5 * w * 4, 6) AS area, round(w * pi() / 2, 6) AS arc, w AS chord FROM t""")
def geometry_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from a segment, area of a polygon, length of a half circle and of a straight side."""
    k, w, zero = F.col("p_partkey"), F.col("p_size").cast("double"), F.lit(0.0)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    outline = F.array(point(zero, zero), point(w, zero), point(w, w + 3), point(w / 2, w + 7), point(zero, w + 3))
    distance = numeric.segment_distance((k % 50).cast("double"), (k % 30 - 10).cast("double"), zero, zero, w, 2 * w)
    return _parts(spark, sf_dir).select("p_partkey", F.round(distance, 6).alias("distance"), F.round(numeric.polygon_area(outline), 6).alias("area"), F.round(numeric.bulge_length(w, F.lit(1.0)), 6).alias("arc"), numeric.bulge_length(w, zero).alias("chord"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(o_orderdate::TIMESTAMP)::BIGINT + 36000 WHEN 1 THEN epoch(o_orderdate::TIMESTAMP)::BIGINT + 36000 - 8 * 3600 END AS instant FROM orders""")
def review_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with an offset count, others and those that are no dates don't."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    shown = F.when(k % 4 == 0, F.concat(day, F.lit("T10:00:00Z"))).when(k % 4 == 1, F.concat(day, F.lit(" 10:00:00.000+08:00"))).when(k % 4 == 2, F.concat(day, F.lit("T10:00:00"))).otherwise(F.concat(day, F.lit("T25:99:00Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(numeric.review_time(shown)).alias("instant"))


@query("""SELECT p_partkey, p_partkey % 4 < 2 AS found FROM part""")
def code_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codes by themselves, and inside longer identifiers."""
    k, code = F.col("p_partkey"), F.concat(F.lit("A-"), "p_size")
    shown = F.when(k % 4 == 0, F.concat(F.lit("see a-"), "p_size", F.lit(", "), "p_name")).when(k % 4 == 1, F.concat(F.lit("("), code, F.lit(".)"))).when(k % 4 == 2, F.concat(F.lit("1F-"), code)).otherwise(F.concat(code, F.lit("-02 "), "p_name"))
    return _parts(spark, sf_dir).select("p_partkey", rules.standalone(shown, code).alias("found"))


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS generic FROM part""")
def generic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles that name a view alone."""
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat(F.lit(" Plan  View "), "p_size")).when(k % 3 == 1, F.concat(F.lit("Plan of "), "p_name"))
    return _parts(spark, sf_dir).select("p_partkey", rules.generic_title(title, ["plan", "view", "detail"]).alias("generic"))


@query("""SELECT event_id, event_id % 3 = 0 AS tainted FROM events""")
def target_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tasks whose JSON gives an answer away, at any depth."""
    k = F.col("event_id")
    task = F.when(k % 3 == 0, F.concat(F.lit('{"in": '), "props", F.lit(', "x": {"amount" : 3}}'))).when(k % 3 == 1, F.concat(F.lit('{"in": '), "props", F.lit(', "note": "amount"}'))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", rules.contaminated(task, ["amount", "gold_quantity"]).alias("tainted"))


@query("""WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: substring(p_name, i, 2))) AS a, list_distinct(list_transform(range(1, length(p_type)), lambda i: substring(lower(p_type), i, 2))) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS likeness FROM g""")
def title_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of two titles by their pairs of characters."""
    return _parts(spark, sf_dir).select("p_partkey", F.round(text.similarity_bigrams(F.col("p_name"), F.lower("p_type")), 9).alias("likeness"))


@query("""SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) = list_sort(list_distinct(list(CASE WHEN l_linenumber > 1 THEN l_returnflag ELSE 'A' END))) AS same FROM lineitem GROUP BY l_orderkey""")
def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two sets of evidence are equal."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).otherwise("A")).alias("b"))
    return sets.select("l_orderkey", assembly.same_set(F.col("a"), F.col("b")).alias("same"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 4 AS k FROM lineitem), n AS (SELECT l_orderkey, count(*) FILTER (WHERE k < 3) AS n, count(*) FILTER (WHERE k < 2) AS good FROM k GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k.k < 2 AND n >= 3 AND good >= greatest(3, ceil(n * 0.7)) THEN '材料 ' || l_linenumber WHEN k.k < 2 THEN 'æ\u009d\u0090æ\u0096\u0099 ' || l_linenumber WHEN k.k = 2 THEN 'Größe' ELSE 'plain' END AS repaired,
  CASE WHEN k.k < 2 THEN '材料 ' || l_linenumber END AS reading, k.k < 2 AND n >= 3 AND good >= greatest(3, ceil(n * 0.7)) AS ideographs FROM k JOIN n USING (l_orderkey)""".replace(r"\u009d", "\u009d").replace(r"\u0090", "\u0090").replace(r"\u0096", "\u0096").replace(r"\u0099", "\u0099"))
def encoding_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were read by the wrong encoding, repaired where most of a file's foreign texts have a strict reading."""
    k = F.col("l_partkey") % 4
    shown = F.when(k < 2, F.concat(F.lit("材料 ".encode().decode("latin-1")), "l_linenumber")).when(k == 2, "Größe").otherwise("plain")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("shown")).withColumn("reading", text.utf8_reading("shown"))
    out = workbooks.text_repairs(rows, "l_orderkey", "shown", "reading")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "repaired", "reading", text.has_cjk(F.col("repaired")).alias("ideographs"))


@query("""WITH t AS (SELECT c_custkey AS id, c_custkey // 60 AS scope, CAST(c_custkey % 60 * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey % 12 * 10 AS DOUBLE) + (c_custkey % 5) * 0.4 AS y, CAST(c_custkey % 3 + 2 AS DOUBLE) AS h, CASE WHEN c_custkey % 7 = 0 THEN 'MT-' || c_custkey ELSE c_name END AS text FROM customer),
m AS (SELECT scope, median(h) AS mh FROM t GROUP BY scope), s AS (SELECT scope, id AS seed, text AS code, x AS sx, y AS sy, h AS sh FROM t WHERE text LIKE 'MT-%'),
b AS (SELECT scope, id, text, x, min((x - sx, seed, code)) AS b FROM t JOIN s USING (scope) JOIN m USING (scope) WHERE abs(y - sy) <= greatest(0.5, least(2 * mh, 2.5 * sh)) AND x > sx GROUP BY ALL)
SELECT scope, b[2] AS seed, b[3] AS code, id, text, CAST(row_number() OVER (PARTITION BY scope, b[2] ORDER BY x, id) AS INT) AS position FROM b""")
def row_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on the baselines of codes, on sheets of sixty texts."""
    k = F.col("c_custkey")
    shown = F.when(k % 7 == 0, F.concat(F.lit("MT-"), k)).otherwise(F.col("c_name"))
    texts = table(spark, sf_dir, "customer").select(k.alias("id"), F.expr("c_custkey div 60").alias("scope"), (k % 60 * 37 % 1000).cast("double").alias("x"), ((k % 12 * 10).cast("double") + (k % 5) * 0.4).alias("y"), (k % 3 + 2).cast("double").alias("h"), shown.alias("text"))
    return workbooks.row_associations(texts, ["scope"], "^MT-")
