"""How far the sources of a language are from each other and from the language, by smoothed shares of its terms.

Counting runs in DuckDB where the data is: each task counts the terms of its texts and joins the counts of several batches
before they are shuffled. Shards hashed by language and term then hold all counts of a term: one SQL pass keeps
the terms with enough documents; with the totals that Spark sums up, another gives every source its share of each term,
the sums of differences between sources over the shard's terms, and the shard's best terms. Spark adds up the partial
sums and ranks.

A hot term or source is a few rows a task once counted. Shards are as many as their rows ask for, and pairs of sources
are dealt over blocks where there are many, so no task holds more than its bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import bound_batches, stored

#: Shares are parts of a thousand millions, and each count is raised by this much. Fixed values of the measure.
SCALE, RAISED = 1_000_000_000, 5
#: A term: letters of any script. Fixed value of the measure.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Counted rows that a task holds before it joins them, and at most hands on together.
HELD = 200_000
#: Counted rows of a shard, shares of a shard (each term in each source of its language) and pairs of sources of a block, on average.
ROWS_A_SHARD, SHARES_A_SHARD, PAIRS_A_BLOCK = 400_000, 400_000, 500_000

#: Characters of a text that SQL takes at a time.
PART = 1 << 20
_BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

COUNTED = "lang string, source string, term string, n long, docs long"


def _sql() -> duckdb.DuckDBPyConnection:
    """A database in a task's memory that leaves no files."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _arrow(found: duckdb.DuckDBPyRelation | duckdb.DuckDBPyConnection) -> pa.Table:
    table = found.arrow()
    return table.read_all() if isinstance(table, pa.RecordBatchReader) else table


_COUNT = f"""
WITH docs AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM batch),
once AS (SELECT d, lang, source, term, count(*) AS n FROM docs GROUP BY ALL)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM once GROUP BY ALL
"""


def text_parts(batch: pa.RecordBatch) -> pa.Table:
    """(d, lang, source, text): ``batch`` with its rows numbered and texts of over PART bytes cut behind other characters than terms have."""
    d, parts = [], []
    for k, text in enumerate(batch.column("text").to_pylist()):
        start, end = 0, len(text)
        while end - start > PART:
            found = _BETWEEN.search(text, start + PART)
            if found is None:
                break
            d.append(k)
            parts.append(text[start : found.end()])
            start = found.end()
        d.append(k)
        parts.append(text[start:])
    rows = batch.select(["lang", "source"]).take(pa.array(d))
    return pa.table({"d": pa.array(d), "lang": rows.column("lang"), "source": rows.column("source"), "text": pa.array(parts, pa.string())})


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents, joined within each task; nulls are empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sql = _sql()
        held, rows = [], 0

        def joined() -> pa.Table:
            parts = pa.concat_tables(held)  # noqa: F841, read by name
            return _arrow(sql.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM parts GROUP BY ALL"))

        for batch in batches:
            batch = text_parts(batch)
            held.append(_arrow(sql.sql(_COUNT)))
            rows += len(held[-1])
            if rows > HELD:
                held = [joined()]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from held[0].to_batches(10_000)
                    held, rows = [], 0
        if rows:
            yield from joined().to_batches(10_000)

    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))]).mapInArrow(run, COUNTED)


def kept_terms(counted: DataFrame, least_docs: int, shards: int) -> DataFrame:
    """(lang, source, term, n) of the terms that ``least_docs`` documents of their language have, one row for each source that has the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sql = _sql()
        sql.execute("CREATE TABLE shard (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            sql.execute("INSERT INTO shard SELECT * FROM batch")
        found = sql.sql(f"""
            SELECT lang, source, term, sum(n)::BIGINT AS n FROM shard
            SEMI JOIN (SELECT lang, term FROM shard GROUP BY ALL HAVING sum(docs) >= {least_docs}) USING (lang, term) GROUP BY ALL""")
        yield from _arrow(found).to_batches(10_000)

    return counted.repartition(shards, "lang", "term").mapInArrow(run, "lang string, source string, term string, n long")


def _share(n: str, total: str, terms: str) -> str:
    return f"(1 + {SCALE}::HUGEINT * ({n} + {RAISED}) // ({total}::HUGEINT + {RAISED} * {terms}::HUGEINT))::BIGINT"


_SHARES = f"""
CREATE TEMP TABLE shares AS
WITH terms AS (SELECT lang, term, row_number() OVER () AS t, sum(n)::HUGEINT AS n FROM kept GROUP BY lang, term)
SELECT g.lang, g.source, g.g, t.t, t.term, coalesce(k.n, 0) AS n,
    {_share('coalesce(k.n, 0)', 'g.total', 'g.terms')} AS p, {_share('t.n', 'g.all_total', 'g.terms')} AS q
FROM terms t JOIN groups g USING (lang) LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term
"""


def shard_differences(kept: DataFrame, groups: DataFrame, shards: int, blocks: int, most: int) -> DataFrame:
    """(lang, source, part, item, value) of each shard: sums of differences of two sources over its terms, and its ``most`` best terms of each source.

    ``groups`` (lang, source, g, total, all_total, terms) numbers the sources of each language and has their sums; each shard takes a copy. A pair of
    sources is under its lower number, which picks its block.
    """
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    dealt = kept.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple[pa.Scalar, ...], kept: pa.Table, groups: pa.Table) -> pa.Table:
        sql = _sql()
        block = key[1].as_py()
        sql.execute(_SHARES)
        pairs = _arrow(sql.sql(f"""
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.t = b.t AND a.g < b.g
            WHERE a.g % {blocks} = {block} GROUP BY a.lang, a.source, b.source"""))
        terms = _arrow(sql.sql(f"""
            SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q AND g % {blocks} = {block}
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(term)) <= {most}"""))
        return pa.concat_tables([pairs, terms])

    return dealt.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(run, "lang string, source string, part string, item string, value long")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, most: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other sources of the language by their summed difference, part ``term`` the ``most`` terms that a source has more of than its language.

    Null texts, languages and sources are empty ones; a source without terms, and one whose language keeps none, has pairs all the same; repeated rows are
    documents of their own; ties go by the item's bytes; texts may have any length, their terms being counted a batch at a time; other columns, whatever
    their names, are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counted = stored(term_counts(docs, text, lang, source))
    kept = stored(kept_terms(counted, least_docs, _many(counted.count(), ROWS_A_SHARD)))
    own = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = kept.groupBy("lang").agg(F.sum("n").alias("all_total")).join(terms, "lang")
    numbered = own.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    groups = stored(numbered.join(sums, ["lang", "source"], "left").join(totals, "lang", "left").na.fill(0, ["total", "all_total", "terms"]))
    size = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("terms").alias("v")).agg(F.sum(F.col("s") * F.col("v")), F.sum(F.col("s") * F.col("s") / 2)).first()
    found = shard_differences(kept, groups, _many(size[0] or 0, SHARES_A_SHARD), _many(size[1] or 0, PAIRS_A_BLOCK), most)
    none = groups.select("lang", "source")
    found = found.unionByName(none.alias("a").join(none.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select("a.lang", "a.source", F.lit("pair").alias("part"), F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value")))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.union(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked_terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= most)
    return both.withColumn("rank", rank).unionByName(ranked_terms)


def _many(size: float, each: int) -> int:
    return max(1, -int(-size // each))
