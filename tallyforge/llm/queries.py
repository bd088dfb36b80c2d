"""The queries opN_<name> over the whole documents table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, divergence, fingerprints, licenses, line_dedup, mixing, pieces, quality, resampling, secrets, shards, simhash, toxicity
from tallyforge.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Domains of the mixture: the number of a source, divided by the number of domains, picks one.
DOMAINS = ["web", "books", "news", "code"]
#: Weights of the mixture's nodes; others have 1.
WEIGHTS = {("web",): 4, ("books",): 3, ("news",): 2, ("web", "en"): 3, ("books", "en"): 2, ("web", "en", "src0"): 2}
MIX = {"share": 0.6, "max_epochs": 3, "seed": 7}


def domain_of(source: str = "source") -> F.Column:
    """The domain of a source by its number, null if it has none."""
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.get(names, (F.regexp_extract(source, "[0-9]+", 0).try_cast("int") % len(DOMAINS)).cast("int"))


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited ones.

    A null text is an empty one, null ids come first, ties go by text, repeated rows are rows like others; an empty table gives no rows.
    """
    return fingerprints.edited_halves(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all texts and the notices in their lines, names joined by commas.

    Null and empty texts have neither; rows of one id are scanned each for itself; an empty table gives no rows.
    """
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a model of the rows that aren't held out.

    Null and empty texts get the score of no hits, equal texts equal scores, a null id isn't held out; without labels all scores are 0; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of all texts and of their decoded bytes.

    Null and empty texts have no tokens; rows of one id are encoded each for itself; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.bpe_round_trip(docs, RANKS, PATTERN).drop("text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in 40 shards of equal numbers, to one.

    Null texts have 16 bytes and the checksum of the empty text; equal rows get slots of their own; an empty table gives no rows.
    """
    placed = shards.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40, seed=5)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    return placed.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of all texts.

    Null and empty texts have no words and fail; rows of one id are judged each for itself; without labels the rules alone decide; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    return quality.quality_verdicts(docs, model).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all texts.

    Texts without words, null ones too, share the fingerprint 0; repeated rows share a component; a null id is no component's id unless it has no other; an empty table gives no rows.
    """
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once for every epoch that takes it.

    A null language or source is the node "unknown"; texts without words cost nothing; rows of one id in a leaf are taken together; an empty table gives no rows.
    """
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, domain_of(), **MIX)
    return mixed.select("doc_id", F.coalesce(domain_of(), F.lit("unknown")).alias("domain"), "lang", "source", "n_tokens", "epoch")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier one has.

    A null text stays null; rows of a null id come last; equal rows of one id are one document and all stay; an empty table gives no rows.
    """
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all texts.

    Null and empty texts have none; equal texts have equal spans; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.span_columns(secrets.scan_secrets(docs, RANKS, PATTERN)).drop("text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of each language, and the terms that each source has more of.

    Null texts, languages and sources are empty; texts may have any length; ties go by the item's bytes; repeated rows count again; other columns, of any
    name, are left out; an empty table gives no rows.
    """
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's texts, and the ranks of those drawn.

    Null and empty texts have no features and weigh nothing; a null id is an empty one in the noise; texts of any length are scanned whole; ties go to the
    smaller id; repeated rows are drawn each for itself; other columns, of any name, are left out; an empty table gives no rows.
    """
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of all texts and of their decoded texts.

    Null and empty texts have the begin and end ids alone; texts of any length are encoded whole; rows of one id are encoded each for itself; other
    columns, of any name, are left out; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.piece_round_trip(docs, PIECES).drop("text"))


QUERIES = {f.__name__: f for f in (op1_syncmer_fingerprints, op2_license_scan, op3_toxicity, op4_byte_bpe, op5_sharding, op6_quality_rules, op7_simhash, op8_source_mixing, op9_line_dedup, op10_secret_scan, op11_source_divergence, op12_importance_resampling, op13_sentencepiece)}


def _weight_sql(level: int) -> str:
    names = ["domain", "language", "origin"]
    cases = [" AND ".join(f"{n} = '{v}'" for n, v in zip(names, key)) + f" THEN {w}" for key, w in WEIGHTS.items() if len(key) == level + 1]
    return f"CASE WHEN {' WHEN '.join(cases)} ELSE 1 END"


def _level_sql(level: int) -> str:
    """The budgets of a level of the tree, from those of the level above."""
    names = ["domain", "language", "origin"][: level + 1]
    parents = names[:-1]
    above = f"(SELECT *, (SELECT sum(tokens) FROM leaves) * {round(MIX['share'] * 1000)} // 1000 AS budget FROM n{level})" if not level else f"(SELECT * FROM n{level} JOIN g{level - 1} USING ({', '.join(parents)}))"
    part = f"PARTITION BY {', '.join(parents)} " if parents else ""
    order = f"{part}ORDER BY cap::DOUBLE / w, {names[-1]}"
    return f"""
n{level} AS (SELECT {', '.join(names)}, sum(tokens) * {MIX['max_epochs']} AS cap, any_value({_weight_sql(level)}) AS w FROM leaves GROUP BY {', '.join(names)}),
f{level} AS (SELECT *, cap * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS filled FROM {above}),
g{level} AS (SELECT {', '.join(names)}, CASE WHEN filled THEN cap ELSE
    (budget - coalesce(sum(cap) FILTER (WHERE filled) OVER ({part}), 0)) * w // sum(w) FILTER (WHERE NOT filled) OVER ({part}) END AS budget FROM f{level})"""


MIX_SQL = rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(list_extract([{', '.join(f"'{d}'" for d in DOMAINS)}], try_cast(regexp_extract(source, '[0-9]+') AS INT) % {len(DOMAINS)} + 1), 'unknown') AS domain,
    coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
{', '.join(_level_sql(level) for level in range(3))},
plan AS (SELECT l.*, g2.budget, CASE WHEN tokens = 0 THEN 0 ELSE g2.budget // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE g2.budget % tokens END AS rest FROM leaves l JOIN g2 USING (domain, language, origin)),
keyed AS (SELECT d.*, epochs, rest, md5('{MIX['seed']}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM docs d JOIN plan USING (domain, language, origin)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
copies AS (SELECT *, CAST(epochs + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS INT) AS copies FROM run)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(copies)) AS INT) AS epoch FROM copies
"""

DIVERGENCE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{divergence.TERM}')) AS term FROM docs),
terms AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN terms USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n FROM groups g JOIN terms t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
sums AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM grid GROUP BY ALL),
own AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v) AS p FROM grid JOIN sums USING (lang, source)),
whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (any_value(total) + 5 * any_value(v)) AS q
    FROM grid JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM sums GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
ranked AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
    UNION ALL SELECT o.lang, o.source, 'term', o.term, p - q FROM own o JOIN whole w ON o.lang = w.lang AND o.term = w.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= 50
"""

ORACLE_SQL = {"op8_source_mixing": MIX_SQL, "op11_source_divergence": DIVERGENCE_SQL}
