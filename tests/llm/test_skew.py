"""Hot rows, leaves and hubs: the same results, spread over many tasks."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing, quality, queries, shards
from tallyforge.llm.common import table

SF = "/root/testdata/sf0.001"


def test_equal_rows_fill_many_buckets(spark):
    equal = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text " * 4).alias("text"), F.lit("a").alias("source"))
    others = spark.range(2000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("b").alias("source"))
    nulls = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("c").alias("source"))
    docs = equal.unionByName(others).unionByName(nulls)
    out = shards.shuffled_shards(docs, shards=7, seed=3, bucket_bytes=40_000).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((r["doc_id"], r["source"]) for r in docs.collect())
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
        share = np.mean([r["doc_id"] == 7 for r in out if r["shard"] == s])
        assert 0.6 < share < 0.85  # of all rows: 0.74
    data = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("__crc"))
    data = data.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(3), "doc_id", "__crc"), F.lit(39)))
    keys = shards.equal_rows(data.withColumn("__size", F.lit(60)), "doc_id", 3, 39, 40_000)
    spread = shards.scattered(data, "doc_id", 3, 39, keys, chunk=1000)
    assert spread.count() == docs.count()
    assert spread.where("doc_id = 7").select("__bucket").distinct().count() == 39
    again = shards.scattered(data.repartition(7), "doc_id", 3, 39, keys, chunk=1000)
    assert spread.groupBy("__bucket").count().exceptAll(again.groupBy("__bucket").count()).isEmpty()


def test_many_origins_of_a_family(spark):
    rng = random.Random(1)
    rows = [("web", "en", f"s{i}", rng.choice([0, 3, 3, 3, 50, rng.randint(1, 2000)])) for i in range(3000)] + [("web", "de", "t", 100), ("books", "en", "u", 10**6)]
    leaves = spark.createDataFrame(rows, "domain string, language string, origin string, tokens long")
    weights = {("web",): 3, ("web", "en", "s1"): 5, ("web", "en", "s2"): 5}
    out = {(r["domain"], r["language"], r["origin"]): r["given"] for r in mixing.leaf_budgets(leaves, weights, 0.5, 2).collect()}

    def fill(budget, nodes):  # nodes: (cap, weight, key)
        nodes, got = sorted(nodes, key=lambda n: (n[0] / n[1], n[2])), {}
        total = sum(w for _, w, _ in nodes)
        for k, (cap, w, key) in enumerate(nodes):
            if cap * total > budget * w:
                return got | {n[2]: budget * n[1] // total for n in nodes[k:]}
            got[key], budget, total = cap, budget - cap, total - w
        return got

    caps = {r[:3]: 2 * r[3] for r in rows}
    want, given = {}, {(): sum(r[3] for r in rows) * 500 // 1000}
    for level in (1, 2, 3):
        paths = sorted({p[:level] for p in caps})
        given = {k: v for parent, budget in given.items() for k, v in fill(budget, [(sum(c for q, c in caps.items() if q[:level] == p), weights.get(p, 1), p) for p in paths if p[:-1] == parent]).items()}
    want = given
    assert out == want


def test_leaves_of_equal_ids_and_without_any(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "src1")] * 500 + [(1, "a b", "en", "src2")] * 300 + [(i, "w " * (i % 7), "de", "src3") for i in range(2000)], "doc_id long, text string, lang string, source string")
    mixed = mixing.mix_sources(docs, {}, queries.domain_of(), share=0.7, max_epochs=1, seed=5)
    taken = Counter(r["source"] for r in mixed.collect())
    assert taken["src1"] in (0, 500) and taken["src2"] in (0, 300)
    tokens = mixed.agg(F.sum("n_tokens")).first()[0]
    assert tokens <= 0.7 * docs.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    everything = mixing.mix_sources(docs, {}, queries.domain_of(), share=1.0, max_epochs=1, seed=5)
    assert everything.where("n_tokens > 0").count() == docs.where("trim(text) <> ''").count()


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def walked(model, x):
    """The score of one row, node by node."""
    total = model.start
    for root in model.roots:
        at = root
        while model.left[at] != at:
            at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
        total += model.value[at]
    return 1 / (1 + np.exp(-total))


def test_query_of_quality_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = quality.learn_quality(docs, table(spark, SF, "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = queries.op6_quality_rules(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        base = brute_statistics(texts[r["doc_id"]])
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert [r[c] for c in quality.BASE] == base and r["base_failed"] == failed
        good = True if model is None else walked(model, quality.statistics(texts[r["doc_id"]])[1]) >= quality.LEAST
        assert r["kept"] == (not failed and good)


def test_trees_learn_only_from_rows_that_pass(spark):
    long = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    docs = spark.createDataFrame([(i, long(i)) for i in range(12)] + [(100 + i, "short") for i in range(30)], "doc_id long, text string")
    bad_fails = spark.createDataFrame([(i, 1) for i in range(12)] + [(100 + i, 0) for i in range(30)], "doc_id long, quality int")
    assert quality.learn_quality(docs, bad_fails) is None  # one label alone among those that pass, however many rows there are
    both = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    assert quality.learn_quality(docs, both) is not None


@pytest.mark.parametrize("many", [1, 400])
def test_sample_of_a_repeated_id(spark, many):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(many)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, quality int")
    chosen, counts = quality.labelled_sample(labels, "quality", 6000, 0)
    assert sorted((r["doc_id"], r["y"], r["text"]) for r in quality.texts_of_sample(docs, chosen).collect()) == [(1, 1, "text 0"), (2, 0, "")] and counts == {0: 1, 1: 1}
