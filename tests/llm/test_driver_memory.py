"""What the driver holds: jobs and broadcast tables of the pipeline's near_dedup and line_dedup."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import common, line_dedup, near_copies
from tallyforge.operators import graphs


def jobs_of(spark, name, run):
    """The result of ``run`` and the number of Spark jobs that it took."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup(name))


def test_a_step_of_small_components_is_two_executions(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 200) for i in range(30)], "a long, b long")
    roots, jobs = jobs_of(spark, "components", lambda: {r["node"]: r["root"] for r in graphs.connected_components(edges).collect()})
    assert all(roots[i] == 0 for i in range(41)) and roots[200] == roots[129] == 100
    assert jobs <= 60


def test_broadcast_tables_are_bounded(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.if_few(spark.range(1000))) and hinted(common.if_small(spark.range(1000), 1000))
    assert not hinted(common.if_few(spark.range(200_000))) and not hinted(common.if_small(spark.range(10), 200_000))
    assert common.SIEVE_BITS <= 1 << 26  # 8 MB
    assert [common.sieve_bits(n) for n in (0, 1000, 10**9)] == [1 << 15, 1 << 16, common.SIEVE_BITS]


def test_sieves_follow_their_keys(spark, monkeypatch):
    """A few hundred documents don't make a bitmap of megabytes."""
    asked, sieve = [], common.sieved
    monkeypatch.setattr(line_dedup, "sieved", lambda *a, bits=common.SIEVE_BITS, **k: asked.append(bits) or sieve(*a, bits=bits, **k))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("a line that every document has"), F.concat(F.lit("one of five words here "), F.col("id"))).alias("text"))
    assert line_dedup.dedup_lines(docs).where("n_dropped > 0").count() == 299
    assert asked and max(asked) <= 1 << 16


def test_near_copies_without_broadcasts(spark, monkeypatch):
    """Beyond the bound texts go through a sieve and joins are shuffled: the same rows stay."""
    rng = random.Random(5)
    passage = [f"common{i}" for i in range(30)]
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 120))] + (passage if k % 2 else [])
        rows += [(100 * k + c, " ".join("x" + w if rng.random() < 0.006 * c else w for w in words)) for c in range(6)]
    rows += [(5000, None), (5001, " "), (5002, rows[0][1]), (5003, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(docs, hot_key=4).collect()}
    sets = {i: set(near_copies.shingle_set(t).tolist()) for i, t in rows}
    alike = lambda a, b: a == b or bool(a | b) and len(a & b) * 1.8 >= 0.8 * (len(a) + len(b)) - 1e-9
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and alike(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    assert kept == set(root.values()) and 12 < len(kept) < len(rows)
    monkeypatch.setattr(common, "FEW", 0)
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs, hot_key=4).collect()} == kept
