"""Queries of matching and evaluation, of the catalogue, and of rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import numeric, text
from tallyforge.operators import catalog, matching, rules
from tallyforge.plans.checkpoints import spread
from tallyforge.plans.registry import query, table


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a copy in which some keys, customers, dates and prices differ."""
    o = table(spark, sf_dir, "orders")
    left = o.select(F.col("o_orderkey").alias("l"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("k1"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("p"))
    right = o.where("o_orderstatus <> 'P'").select((-F.col("o_orderkey")).alias("r"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey")).alias("k1"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).otherwise(F.lit(0)).cast("long").alias("c"), F.col("o_orderdate").alias("d"), F.round(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 4 == 0, 1.1).otherwise(1.0), 2).alias("p"))
    return left, right


_SIDES = """a AS (SELECT o_orderkey AS l, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS k1, o_custkey AS c, o_orderdate AS d, o_totalprice AS p FROM orders),
b AS (SELECT -o_orderkey AS r, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS k1, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey ELSE 0 END AS c, o_orderdate AS d, round(o_totalprice * CASE WHEN o_orderkey % 4 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 2) AS p FROM orders WHERE o_orderstatus <> 'P')"""


def _stage_sql(n: int, keys: str) -> str:
    before = "" if n == 1 else " WHERE {0} NOT IN (SELECT {0} FROM m%d)" % (n - 1)
    a, b = f"(SELECT * FROM a{before.format('l')})", f"(SELECT * FROM b{before.format('r')})"
    one = "SELECT {0}, min({1}) AS {1} FROM {2} GROUP BY {0} HAVING count(*) = 1"
    found = f"SELECT l, r, {n} AS stage FROM ({one.format(keys, 'l', a)}) JOIN ({one.format(keys, 'r', b)}) USING ({keys})"
    return f"m{n} AS ({found if n == 1 else f'SELECT * FROM m{n - 1} UNION ALL {found}'})"


#: Keys of the stages, strongest first.
STAGES = [["k1"], ["c", "d"], ["d", "p"]]
_STAGED = f"{_SIDES}, {_stage_sql(1, 'k1')}, {_stage_sql(2, 'c, d')}, {_stage_sql(3, 'd, p')}"


@query(f"WITH {_STAGED} SELECT * FROM m3")
def staged_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, first stages."""
    left, right = _orders(spark, sf_dir)
    return matching.staged_match(left, right, STAGES)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one project (orders 6,000 by 6,000) and month with like amounts, among the rows that the stages leave."""
    left, right = _orders(spark, sf_dir)
    done = matching.staged_match(left, right, STAGES)
    month = F.date_format("d", "yyyy-MM").alias("month")
    left = matching.without(left, done, "l").select("l", "c", "p", F.expr("l div 6000").alias("project"), month)
    right = matching.without(right, done, "r").select("r", F.col("c").alias("rc"), F.col("p").alias("rp"), F.expr("-r div 6000").alias("project"), month)
    pairs = left.join(right, ["project", "month"])
    return pairs.select(F.concat_ws("/", "project", "month").alias("d"), "l", "r", F.round(1 / (1 + F.abs(F.col("p") - F.col("rp")) / 1000) + F.when(F.col("c") == F.col("rc"), 0.5).otherwise(0.0), 6).alias("score"))


_MUTUAL = f"""WITH RECURSIVE {_STAGED},
x AS (SELECT * FROM a WHERE l NOT IN (SELECT l FROM m3)), y AS (SELECT * FROM b WHERE r NOT IN (SELECT r FROM m3)),
pairs AS (SELECT l // 6000 || '/' || strftime(x.d, '%Y-%m') AS d, l, r, round(1 / (1 + abs(x.p - y.p) / 1000) + CASE WHEN x.c = y.c THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM x JOIN y ON l // 6000 = -r // 6000 AND strftime(x.d, '%Y-%m') = strftime(y.d, '%Y-%m')),
o AS (SELECT 1 AS n, l, r, score FROM pairs
  UNION ALL SELECT n + 1, l, r, score FROM (SELECT *, bool_or(t) OVER (PARTITION BY l) AS dl, bool_or(t) OVER (PARTITION BY r) AS dr, bool_or(t) OVER () AS hit FROM
    (SELECT *, tl AND tr AND sum(CASE WHEN tl THEN 1 ELSE 0 END) OVER (PARTITION BY l) = 1 AND sum(CASE WHEN tr THEN 1 ELSE 0 END) OVER (PARTITION BY r) = 1 AS t FROM
      (SELECT *, score = max(score) OVER (PARTITION BY l) AS tl, score = max(score) OVER (PARTITION BY r) AS tr FROM o))) WHERE hit AND NOT dl AND NOT dr),
taken AS (SELECT l, r, n AS round FROM (SELECT *, tl AND tr AND sum(CASE WHEN tl THEN 1 ELSE 0 END) OVER (PARTITION BY n, l) = 1 AND sum(CASE WHEN tr THEN 1 ELSE 0 END) OVER (PARTITION BY n, r) = 1 AS t FROM
  (SELECT *, score = max(score) OVER (PARTITION BY n, l) AS tl, score = max(score) OVER (PARTITION BY n, r) AS tr FROM o)) WHERE t)"""


@query(f"{_MUTUAL} SELECT l, r, round FROM taken")
def mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, last stage: a fixpoint."""
    return matching.mutual_best(_pairs(spark, sf_dir))


@query(f"{_MUTUAL}, n AS (SELECT d, l, count(*) AS candidates FROM pairs GROUP BY ALL) SELECT d, l, r, candidates, CASE WHEN r IS NULL THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS state FROM n LEFT JOIN taken USING (l)")
def one_to_one_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    return matching.one_to_one(_pairs(spark, sf_dir), ["d"])


_COPY = """SELECT o_orderkey AS l, -o_orderkey AS r, o_orderkey % 3 AS region, o_totalprice AS p, CASE WHEN o_orderkey % 13 > 0 THEN round(o_totalprice * CASE WHEN o_orderkey % 4 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 2) END AS q,
  o_orderstatus AS s, CASE WHEN o_orderkey % 17 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS t, CASE WHEN o_orderkey % 23 > 0 THEN o_orderpriority END AS u, o_orderpriority AS v FROM orders"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        (k % 3).alias("region"), F.col("o_totalprice").alias("p"), F.when(k % 13 > 0, F.round(F.col("o_totalprice") * F.when(k % 4 == 0, 1.1).otherwise(1.0), 2)).alias("q"),
        F.col("o_orderstatus").alias("s"), F.when(k % 17 == 0, F.lower("o_orderstatus")).when(k % 19 == 0, "X").otherwise(F.col("o_orderstatus")).alias("t"), F.when(k % 23 > 0, F.col("o_orderpriority")).alias("u"), F.col("o_orderpriority").alias("v"),
    )


@query(f"""WITH c AS ({_COPY}), f AS (SELECT region, 'price' AS field, CASE WHEN q IS NULL THEN 'FAIL' WHEN abs(q - p) <= abs(p) * 0.05 THEN 'PASS' ELSE 'FAIL' END AS o FROM c
  UNION ALL SELECT region, 'status', CASE WHEN lower(s) = lower(t) THEN 'PASS' ELSE 'FAIL' END FROM c UNION ALL SELECT region, 'strict', CASE WHEN s = t THEN 'PASS' ELSE 'FAIL' END FROM c
  UNION ALL SELECT region, 'priority', CASE WHEN u IS NULL THEN 'UNRESOLVED' ELSE 'PASS' END FROM c)
SELECT region, field, count(*) FILTER (WHERE o = 'PASS') AS pass, count(*) FILTER (WHERE o = 'FAIL') AS fail, count(*) FILTER (WHERE o = 'UNRESOLVED') AS unresolved,
  count(*) FILTER (WHERE o = 'PASS') / count(*) FILTER (WHERE o <> 'UNRESOLVED') AS accuracy FROM f GROUP BY ALL""")
def field_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, G17."""
    outcomes = {"price": numeric.compare_number(F.col("p"), F.col("q"), 0.05), "status": numeric.compare_text(F.col("s"), F.col("t")), "strict": numeric.compare_text(F.col("s"), F.col("t"), strict=True), "priority": numeric.compare_text(F.col("u"), F.col("v"))}
    return matching.evaluate_fields(_compared(spark, sf_dir), outcomes, ["region"])


_GATES = f"""WITH c AS ({_COPY}), g AS (SELECT region, count(*) AS eligible, count(q) AS predicted, count(*) FILTER (WHERE q IS NOT NULL AND abs(q - p) <= abs(p) * 0.05) AS correct, bool_or(region = 2 AND u IS NULL) AS blocked FROM c GROUP BY region),
r AS (SELECT region, eligible, predicted, correct, correct / eligible AS recall, correct / predicted AS precision, CASE WHEN blocked THEN 'BLOCKED' WHEN correct / eligible >= 0.7 AND correct / predicted >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS gate FROM g)"""


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.coalesce(F.abs(F.col("q") - F.col("p")) <= F.abs("p") * 0.05, F.lit(False))
    rows = _compared(spark, sf_dir).select("region", F.lit(True).alias("eligible"), F.col("q").isNotNull().alias("predicted"), near.alias("correct"), ((F.col("region") == 2) & F.col("u").isNull()).alias("blocked_row"))
    return matching.project_gate(rows, "region", 0.7, F.col("blocked_row"))


@query(f"{_GATES} SELECT * FROM r")
def project_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17."""
    return _gates(spark, sf_dir)


@query(f"{_GATES} SELECT count(*) AS projects, round(avg(recall), 9) AS macro_recall, round(avg(precision), 9) AS macro_precision, sum(correct) / sum(eligible) AS micro_recall, sum(correct) / sum(predicted) AS micro_precision, 'BLOCKED' AS gate FROM r")
def batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18."""
    out = matching.batch_evaluation(_gates(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("macro_recall", "macro_precision")})


@query(f"WITH c AS ({_COPY}) SELECT region, count(q) AS n, round(avg(abs(q - p)), 1) AS mae, round(avg(abs(q - p) / abs(p)), 8) AS mape FROM c GROUP BY region")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    out = matching.error_metrics(_compared(spark, sf_dir), ["region"], "p", "q")
    return out.withColumns({"mae": F.round("mae", 1), "mape": F.round("mape", 8)})


@query("""WITH a AS (SELECT md5(c_name) AS digest, c_mktsegment AS seg, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS nat FROM customer WHERE c_acctbal > 0 UNION ALL SELECT md5(c_name), c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 9500),
b AS (SELECT md5(c_name) AS digest, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg, c_nationkey AS nat FROM customer WHERE c_acctbal < 9000),
l AS (SELECT digest, count(*) AS n, min(seg) AS seg, min(nat) AS nat FROM a GROUP BY digest), r AS (SELECT digest, count(*) AS n, min(seg) AS seg, min(nat) AS nat FROM b GROUP BY digest),
j AS (SELECT coalesce(l.digest, r.digest) AS digest, CASE WHEN l.n > 1 OR r.n > 1 THEN 'duplicate' WHEN r.n IS NULL THEN 'left_only' WHEN l.n IS NULL THEN 'right_only' ELSE 'matched' END AS state, l.seg AS ls, r.seg AS rs, l.nat AS ln, r.nat AS rn FROM l FULL JOIN r ON l.digest = r.digest)
SELECT digest, state, CASE WHEN state = 'matched' THEN 'seg:' || CASE WHEN ls IS NULL OR rs IS NULL THEN 'UNRESOLVED' WHEN ls = rs THEN 'PASS' ELSE 'FAIL' END || ',nat:' || CASE WHEN ln IS NULL OR rn IS NULL THEN 'UNRESOLVED' WHEN ln = rn THEN 'PASS' ELSE 'FAIL' END END AS verdicts FROM j""")
def digest_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    row = lambda df, seg, nat: df.select(F.md5("c_name").alias("digest"), seg.alias("seg"), nat.alias("nat"))
    left = row(c.where("c_acctbal > 0"), F.col("c_mktsegment"), F.when(k % 3 > 0, F.col("c_nationkey"))).unionByName(row(c.where("c_acctbal > 9500"), F.col("c_mktsegment"), F.col("c_nationkey")))
    right = row(c.where("c_acctbal < 9000"), F.when(k % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")), F.col("c_nationkey"))
    return matching.digest_join(left, right, "digest", ["seg", "nat"], F.col("digest").isNotNull())


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderkey % 4000 AS seq, o_orderstatus FROM orders), r AS (SELECT o_orderkey AS record_id, o_custkey, o_orderkey % 4000 AS seq, o_orderstatus FROM orders WHERE o_orderstatus = 'P'),
k AS (SELECT o_custkey, min(record_id) AS k FROM r GROUP BY o_custkey), q AS (SELECT seq, count(*) AS n, min(record_id) AS s, min(o_orderstatus) AS st FROM r GROUP BY seq),
j AS (SELECT o_orderkey, k, q.s AS s, CASE WHEN k IS NOT NULL THEN NULL WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'sequence_not_unique' WHEN o_orderstatus IS DISTINCT FROM st THEN 'identity_differs' END AS error FROM s LEFT JOIN k USING (o_custkey) LEFT JOIN q USING (seq))
SELECT o_orderkey, CASE WHEN error IS NULL THEN coalesce(k, s) END AS record_id, error FROM j""")
def selection_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    o = table(spark, sf_dir, "orders")
    selections = o.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4000).alias("seq"), "o_orderstatus")
    records = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("record_id"), "o_custkey", (F.col("o_orderkey") % 4000).alias("seq"), "o_orderstatus")
    return matching.bound_records(selections, records, "o_custkey", "seq", ["o_orderstatus"]).select("o_orderkey", "record_id", "error")


@query(r"""WITH t AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents)
SELECT term, source, count(*) AS entities, min(doc_id) AS first_entity FROM t GROUP BY ALL""")
def catalog_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, C3, T5."""
    return catalog.term_index(table(spark, sf_dir, "documents"), "source", "text", "doc_id")


@query("SELECT source, lang, count(*) AS entities, count(*) FILTER (WHERE length(trim(text, ' ')) > 0) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY ALL")
def sheet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    return catalog.sheet_counts(table(spark, sf_dir, "documents"), "source", "lang", "text")


@query(r"""WITH t AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
i AS (SELECT term, source, count(*) AS entities FROM t WHERE contains(term, 'license') GROUP BY ALL)
SELECT source, max(CASE WHEN term = 'license' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS score, count(*) AS terms, CAST(sum(entities) AS BIGINT) AS entities FROM i GROUP BY source ORDER BY score DESC, source LIMIT 50""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return catalog.search(catalog_terms(spark, sf_dir), "License", "source")


@query("""WITH k AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'plan' WHEN 1 THEN 'elevation_index' WHEN 2 THEN 'elevation' WHEN 3 THEN 'detail' WHEN 4 THEN 'door' WHEN 5 THEN 'ceiling' WHEN 6 THEN 'floor' WHEN 7 THEN 'cover' END AS kind FROM orders)
SELECT o_orderkey, CASE WHEN kind IN ('plan', 'elevation_index') THEN 'plan' WHEN kind = 'elevation' THEN 'elevation' WHEN kind IN ('detail', 'door', 'ceiling', 'floor') THEN 'detail' END AS stage FROM k""")
def stage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    kinds = F.array(*map(F.lit, ("plan", "elevation_index", "elevation", "detail", "door", "ceiling", "floor", "cover")))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.stage_of(F.get(kinds, (F.col("o_orderkey") % 9).cast("int"))).alias("stage"))


#: Patterns of part names as sheet kinds.
KIND_RULES = [("plan", "metal", "steel|copper", 2.0), ("plan", "small", "small|economy", 1.5), ("elevation", "metal", "brass|nickel", 2.5), ("elevation", "large", "large|promo", 1.0), ("detail", "tin", "tin", 3.0), ("detail", "colour", "blue|green", 1.0)]


@query("""WITH t AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS y FROM part),
k AS (SELECT p_partkey, 'plan' AS kind, 2 * (CASE WHEN regexp_matches(n, 'steel|copper') THEN 2.0::DOUBLE ELSE 0 END) + 1.5 * (CASE WHEN regexp_matches(y, 'steel|copper') THEN 2.0::DOUBLE ELSE 0 END) + 2 * (CASE WHEN regexp_matches(n, 'small|economy') THEN 1.5::DOUBLE ELSE 0 END) + 1.5 * (CASE WHEN regexp_matches(y, 'small|economy') THEN 1.5::DOUBLE ELSE 0 END) AS s FROM t
  UNION ALL SELECT p_partkey, 'elevation', 2 * (CASE WHEN regexp_matches(n, 'brass|nickel') THEN 2.5::DOUBLE ELSE 0 END) + 1.5 * (CASE WHEN regexp_matches(y, 'brass|nickel') THEN 2.5::DOUBLE ELSE 0 END) + 2 * (CASE WHEN regexp_matches(n, 'large|promo') THEN 1.0::DOUBLE ELSE 0 END) + 1.5 * (CASE WHEN regexp_matches(y, 'large|promo') THEN 1.0::DOUBLE ELSE 0 END) FROM t
  UNION ALL SELECT p_partkey, 'detail', 2 * (CASE WHEN regexp_matches(n, 'tin') THEN 3.0::DOUBLE ELSE 0 END) + 1.5 * (CASE WHEN regexp_matches(y, 'tin') THEN 3.0::DOUBLE ELSE 0 END) + 2 * (CASE WHEN regexp_matches(n, 'blue|green') THEN 1.0::DOUBLE ELSE 0 END) + 1.5 * (CASE WHEN regexp_matches(y, 'blue|green') THEN 1.0::DOUBLE ELSE 0 END) FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, kind) AS r FROM k), w AS (SELECT p_partkey, max(CASE WHEN r = 1 THEN kind END) AS kind, max(CASE WHEN r = 1 THEN s END) AS a, max(CASE WHEN r = 2 THEN s END) AS b FROM r GROUP BY p_partkey),
c AS (SELECT p_partkey, kind, a < 3 OR (b >= 3 AND a - b < 1) AS u, least(0.96, 0.48::DOUBLE + 0.3::DOUBLE * (1 - exp(-a / 5)) + least(0.16, (a - b) / 25)) AS sure FROM w)
SELECT p_partkey, CASE WHEN u THEN 'unknown' ELSE kind END AS kind, round(CASE WHEN u THEN least(sure, 0.45) ELSE sure END, 3) AS confidence FROM c""")
def sheet_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return catalog.classify(parts, KIND_RULES, {"file": "p_name", "primary": "p_type", "title": "p_name"}).select("p_partkey", "kind", "confidence")


@query("""WITH p AS (SELECT n_nationkey AS k, 'panel' AS kind FROM nation WHERE n_regionkey < 2), o AS (SELECT n_nationkey AS k, 'sheet' AS kind FROM nation) SELECT * FROM p UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM p)""")
def view_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    nation = table(spark, sf_dir, "nation")
    panels = nation.where("n_regionkey < 2").select(F.col("n_nationkey").alias("k"), F.lit("panel").alias("kind"))
    return catalog.with_fallback(panels, nation.select(F.col("n_nationkey").alias("k"), F.lit("sheet").alias("kind")), panels, "k")


@query("""SELECT s_nationkey, s_acctbal, coalesce((lag(s_acctbal) OVER w + s_acctbal) / 2, -2000.0::DOUBLE) AS part_low, coalesce((s_acctbal + lead(s_acctbal) OVER w) / 2, 20000.0::DOUBLE) AS part_high FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)""")
def panel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    anchors = table(spark, sf_dir, "supplier").withColumns({"low": F.lit(-2000.0), "high": F.lit(20000.0)})
    return catalog.split_panels(anchors, "s_nationkey", "s_acctbal", "low", "high")


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS callout, l_suppkey % 30 AS page, l_partkey % 40 AS target FROM lineitem), p AS (SELECT s_suppkey AS page, s_suppkey % 35 AS code, s_suppkey * 3 % 30 AS back FROM supplier),
t AS (SELECT code, count(*) AS targets FROM p GROUP BY code), b AS (SELECT code, back, count(*) AS backs, min(page) AS target_page FROM p GROUP BY ALL),
j AS (SELECT callout, c.page, target, CASE WHEN targets IS NULL THEN 'missing' WHEN backs IS NULL THEN 'one_way' WHEN backs > 1 THEN 'ambiguous' ELSE 'reciprocal' END AS state, target_page FROM c LEFT JOIN t ON t.code = target LEFT JOIN b ON b.code = target AND b.back = c.page)
SELECT callout, page, target, state, CASE WHEN state = 'reciprocal' THEN target_page END AS target_page FROM j""")
def detail_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, J11."""
    callouts = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("callout"), (F.col("l_suppkey") % 30).alias("page"), (F.col("l_partkey") % 40).alias("target"))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") % 35).alias("code"), (F.col("s_suppkey") * 3 % 30).alias("back"))
    return catalog.reciprocal_links(callouts, pages)


@query("""WITH f AS (SELECT p_name AS phrase, min(p_brand) AS code FROM part GROUP BY p_name), m AS (SELECT p_partkey AS mention, 'two ' || p_name || ' and ' || p_type AS text FROM part),
h AS (SELECT mention, count(DISTINCT code) AS codes, min(code) AS code FROM m JOIN f ON contains(lower(' ' || text || ' '), lower(' ' || phrase || ' ')) GROUP BY mention)
SELECT mention, CASE WHEN codes = 1 THEN code END AS code, CASE WHEN codes = 1 THEN 'REVIEW' WHEN codes > 1 THEN 'BLOCK' END AS status FROM m LEFT JOIN h USING (mention)""")
def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    parts = table(spark, sf_dir, "part")
    phrases = parts.groupBy(F.col("p_name").alias("phrase")).agg(F.min("p_brand").alias("code"))
    mentions = parts.select(F.col("p_partkey").alias("mention"), F.concat(F.lit("two "), "p_name", F.lit(" and "), "p_type").alias("text"))
    return catalog.phrase_codes(mentions, phrases)


@query("""SELECT md5(text) AS identity, count(*) AS uses, count(DISTINCT lower(trim(source))) AS "names", count(DISTINCT lang) AS stages, CASE WHEN count(DISTINCT lower(trim(source))) > 1 THEN 'BLOCK' ELSE 'REVIEW' END AS status FROM documents GROUP BY text HAVING count(DISTINCT lower(trim(source))) > 1 OR count(DISTINCT lang) > 1""")
def reuse_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20."""
    return catalog.reuse_audit(table(spark, sf_dir, "documents"), F.md5("text"), "source", "lang")


RULES = [
    {"id": "r1", "match": {"brand_any": ["Brand#11", "Brand#12", "Brand#13"], "name_terms_any": ["red", "small"]}, "action": "per_m", "status": "APPROVED"},
    {"id": "r2", "match": {"tags_all": ["big", "even"]}, "action": "per_set", "status": "APPROVED"},
    {"id": "r3", "match": {"tags_none": ["even"], "name_terms_none": ["a"]}, "action": "per_piece", "status": "DRAFT"},
    {"id": "r4", "match": {"brand": ["Brand#21"]}, "action": "per_area", "status": "APPROVED", "enabled": False},
]


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS brand, lower(p_name) AS name, p_size >= 25 AS big, p_partkey % 2 = 0 AS even, CASE WHEN p_partkey % 5 > 0 THEN 'PASS' ELSE 'REVIEW' END AS status, p_partkey % 7 > 0 AS bound FROM part),
v AS (SELECT id, 'r1' AS rule, 'per_m' AS action, '' AS own, status, bound FROM c WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND (contains(name, 'red') OR contains(name, 'small'))
  UNION ALL SELECT id, 'r2', 'per_set', '', status, bound FROM c WHERE big AND even UNION ALL SELECT id, 'r3', 'per_piece', 'rule_not_approved', status, bound FROM c WHERE NOT even AND NOT contains(name, 'a') UNION ALL SELECT id, 'r4', 'per_area', 'rule_disabled', status, bound FROM c WHERE brand = 'Brand#21'),
w AS (SELECT id, rule, action, concat_ws(',', nullif(own, ''), CASE WHEN status <> 'PASS' THEN 'component_not_pass' END, CASE WHEN NOT bound THEN 'inputs_not_bound' END) AS reasons FROM v)
SELECT *, CASE WHEN reasons = '' THEN 'CONFIRMED' ELSE 'REVIEW' END AS status FROM w""")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, X1."""
    k = F.col("p_partkey")
    tags = F.array_compact(F.array(F.when(F.col("p_size") >= 25, "big"), F.when(k % 2 == 0, "even")))
    contexts = table(spark, sf_dir, "part").select(k.alias("id"), F.array("p_brand").alias("brand"), F.col("p_name").alias("name"), tags.alias("tags"), F.when(k % 5 > 0, "PASS").otherwise("REVIEW").alias("status"), (k % 7 > 0).alias("bound"))
    return rules.apply_rules(contexts, RULES)


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_type = 'view' THEN 'not_view' END, CASE WHEN user_id % 10 = 0 THEN 'user' END, CASE WHEN value > 90 THEN 'value_at_most_90' END) AS violations FROM events""")
def schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    checks = {"not_view": F.col("event_type") != "view", "user": F.col("user_id") % 10 != 0, "value_at_most_90": F.col("value") <= 90}
    return rules.schema_audit(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value"), checks).select("event_id", "violations")


@query("""SELECT event_id, CASE WHEN value < 10 THEN 'too_small' WHEN user_id % 4 = 0 THEN 'user' WHEN event_type = 'click' THEN 'click' END AS reason FROM events""")
def ordered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    checks = [("too_small", F.col("value") >= 10), ("user", F.col("user_id") % 4 != 0), ("click", F.col("event_type") != "click")]
    return table(spark, sf_dir, "events").select("event_id", rules.first_reason(checks).alias("reason"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), h AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT min(l_suppkey) FROM c WHERE c.l_orderkey = o_orderkey) ELSE o_custkey % 100 END AS choice FROM orders WHERE o_orderstatus <> 'P')
SELECT k.l_orderkey, CASE WHEN c.l_suppkey IS NOT NULL THEN choice END AS chosen, CASE WHEN choice IS NOT NULL AND c.l_suppkey IS NULL THEN 'unknown_choice' END AS reason FROM (SELECT DISTINCT l_orderkey FROM c) k LEFT JOIN h USING (l_orderkey) LEFT JOIN c ON c.l_orderkey = k.l_orderkey AND c.l_suppkey = choice""")
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18."""
    candidates = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    low = candidates.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("low"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "l_orderkey").join(low, "l_orderkey", "left")
    choices = orders.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("low")).otherwise(F.col("o_custkey") % 100).alias("choice"))
    return rules.confirm(candidates, choices, "l_orderkey", "l_suppkey")


@query(r"""WITH p AS (SELECT p_partkey, p_partkey % 12 AS k, p_size, p_name, lower(trim(p_name)) AS n FROM part),
t AS (SELECT *, list_sort(list_distinct(list_append(regexp_extract_all(n, '[a-z0-9]+'), n))) AS tok, list_sort(list_distinct(CASE WHEN length(p_name) < 2 THEN [p_name] ELSE list_transform(range(1, length(p_name)), lambda i: substring(p_name, i, 2)) END)) AS g FROM p)
SELECT p_partkey, 'GC-SS-' || lpad(CAST(k AS VARCHAR), 2, '0') || ',MT-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS codes, array_to_string(list_transform(range(k, k + 4), lambda i: 'A-' || lpad(CAST(i AS VARCHAR), 2, '0')), ',') AS "range", array_to_string(tok, ',') AS tokens, array_to_string(g, '') AS grams,
  'A' || lpad(CAST(k AS VARCHAR), 2, '0') || 'A' || lpad(CAST(k + 3 AS VARCHAR), 2, '0') AS key, p_name || ';x' AS list FROM t""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, ranges, tokens, bigrams and keys of made-up texts around part names."""
    parts = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 12)
    sample = parts.select("p_partkey", F.concat(F.lit("see GC-SS-"), "k", F.lit(" and mt"), "p_size", F.lit(", XMT-1; "), "p_name").alias("t"), F.format_string("A-%02d~A-%02d", "k", F.col("k") + 3).alias("r"), "p_name")
    return sample.select("p_partkey", F.array_join(text.material_codes(F.col("t"), ["MT", "GC-SS"]), ",").alias("codes"), F.array_join(text.expand_range(F.col("r")), ",").alias("range"), F.array_join(text.tokens(F.col("p_name")), ",").alias("tokens"), F.array_join(text.bigrams(F.col("p_name")), "").alias("grams"), text.code_key(F.col("r")).alias("key"), F.array_join(text.key_list(F.concat_ws(", ", "p_name", F.upper("p_name"), F.lit("x"))), ";").alias("list"))


@query(r"""WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'say "' || p_name || '"' WHEN 2 THEN 'C:\' || p_name || '\n' WHEN 3 THEN 'a' || chr(10) || chr(9) || chr(31) || p_name || '㎡' END AS note FROM part),
j AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN '"' || p_name || '"' WHEN 1 THEN '"say \"' || p_name || '\""' WHEN 2 THEN '"C:\\' || p_name || '\\n"' WHEN 3 THEN '"a\n\t\u001f' || p_name || '㎡"' ELSE 'null' END AS json FROM p)
SELECT p_partkey, 'part:' || substring(sha256('{"brand":"' || p_brand || '","note":' || json || ',"size":"' || p_size || '"}'), 1, 24) AS id FROM j""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of values with quotes, backslashes, control characters, and nulls."""
    k = F.col("p_partkey") % 5
    note = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit('say "'), "p_name", F.lit('"'))).when(k == 2, F.concat(F.lit("C:\\"), "p_name", F.lit("\\n"))).when(k == 3, F.concat(F.lit("a\n\t\x1f"), "p_name", F.lit("㎡")))
    return table(spark, sf_dir, "part").select("p_partkey", text.content_id("part", {"size": F.col("p_size"), "note": note, "brand": F.col("p_brand")}).alias("id"))


@query("""SELECT p_partkey, (p_size + 3) * 2 - (p_partkey % 5) / 4 AS value, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE * 10 * p_size * 100 * 2 / 1000000 ELSE p_size::DOUBLE * 100 * 2 / 1000 END AS quantity, 2.0::DOUBLE * p_size - 1 AS derived,
  CASE WHEN p_partkey % 2 = 0 THEN '=(((I{row}*J{row})*K{row})/1000000)' ELSE '=((J{row}*K{row})/1000)' END AS formula FROM part""")
def safe_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions over part sizes, by a parser in Arrow batches."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.concat_ws("", F.lit("("), "p_size", F.lit("+3)×2-"), F.col("p_partkey") % 5, F.lit("/4")).alias("e"), F.when(F.col("p_partkey") % 2 == 0, "width_mm*length_mm*quantity/1000000").otherwise("length_mm*quantity/1000").alias("d"), "p_size")
    unit = F.when(F.col("p_partkey") % 2 == 0, "㎡").otherwise("m")
    size = F.col("p_size").cast("double")
    return parts.select("p_partkey", numeric.arithmetic("e").cast("double").alias("value"), numeric.dimensional_quantity("d", unit, size * 10, size * 100, F.lit(2.0)).cast("double").alias("quantity"), numeric.formula(F.lit("2*a-b"), F.create_map(F.lit("a"), size, F.lit("b"), F.lit(1.0))).cast("double").alias("derived"), numeric.excel_formula("d").alias("formula"))
