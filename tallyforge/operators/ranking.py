"""Ranked candidates with explicit ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_candidates(rows: DataFrame, keys: list[str], order: list[Column], k: int = 24) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank`` and, where rows were left out, a ``note`` of how many there were.

    ``order`` must end in a unique column. A limit on the rank lets Spark keep k rows a key before the shuffle; the counts are a
    separate aggregate with map-side combine.
    """
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    note = F.when(F.col("__n") > k, F.concat(F.lit("candidate_pool_truncated:"), F.col("__n"), F.lit(f"->{k}")))
    return ranked.join(counts, keys).withColumn("note", note).drop("__n")


def clear_best(rows: DataFrame, keys: list[str], value: str, score: str, tie: str, gap: float = 0.12, relative: float = 1e-9) -> DataFrame:
    """The value of the best row of each key; null and ``ambiguous`` if the second best differs and scores less than ``gap`` below."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    top = rows.withColumn("__r", F.row_number().over(order)).where("__r <= 2").groupBy(*keys)
    two = top.agg(*[F.max(F.when(F.col("__r") == r, F.col(c))).alias(f"{c}{r}") for c in dict.fromkeys((value, score, tie)) for r in (1, 2)])
    v1, v2, s1, s2 = (F.col(f"{c}{r}") for c in (value, score) for r in (1, 2))
    differs = v2.isNotNull() & (F.abs(v1 - v2) > relative * F.greatest(F.abs(v1), F.abs(v2)))
    ambiguous = F.coalesce(differs & (s1 - s2 < gap), F.lit(False))
    return two.select(*keys, F.when(~ambiguous, v1).alias("chosen"), ambiguous.alias("ambiguous"))


def automatic_pick(rows: DataFrame, keys: list[str], value: str, score: str, least: float = 0.72, margin: float = 0.05) -> DataFrame:
    """The best value of a key if it scores ``least`` and ``margin`` above the best of any other value; else null."""
    best = rows.groupBy(*keys, value).agg(F.max(score).alias("s"))
    order = Window.partitionBy(*keys).orderBy(F.desc("s"), value)
    two = best.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy(*keys)
    top = two.agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("v"), F.max(F.when(F.col("r") == 1, F.col("s"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("s2"))
    good = (F.col("s1") >= least) & (F.col("s2").isNull() | (F.col("s1") - F.col("s2") >= margin))
    return top.select(*keys, F.when(good, F.col("v")).alias("picked"), F.col("s1").alias("best_score"))


def merged_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of each key's intervals as islands; touching intervals are one. Rows without a bound are left out."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"))


def interval_gaps(islands: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The gaps between the islands of each key."""
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return islands.select(*keys, F.col(end).alias("gap_start"), after.alias("gap_end")).where("gap_end is not null")


def chain_lengths(rows: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 0.05) -> DataFrame:
    """The total length of each key's intervals if they form one chain: no overlap and no gap beyond ``tolerance``; else null and the first reason."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end))
    step = F.col(start) - before
    checked = rows.withColumns({"__overlap": step < -tolerance, "__gap": step > tolerance})
    sums = checked.groupBy(*keys).agg(F.bool_or("__overlap").alias("o"), F.bool_or("__gap").alias("g"), F.sum(F.col(end) - F.col(start)).alias("t"), F.count("*").alias("parts"))
    reason = F.when(F.col("o"), "overlap").when(F.col("g"), "gap")
    return sums.select(*keys, "parts", reason.alias("reason"), F.when(reason.isNull(), F.col("t")).alias("total"))


def recall_probe(expected: DataFrame, candidates: DataFrame, keys: list[str], absolute: float = 1.0, relative: float = 0.05) -> DataFrame:
    """For each expected value the closest candidate of its key (ties: the smaller) and whether it is within tolerance.

    ``expected`` has ``expected``, ``candidates`` has ``value``; a key without candidates is a miss.
    """
    near = F.struct(F.abs(F.col("value") - F.col("expected")).alias("d"), F.col("value").alias("v"))
    joined = expected.join(candidates.select(*keys, "value"), keys, "left").groupBy(*expected.columns)
    found = joined.agg(F.min(F.when(F.col("value").isNotNull(), near)).alias("m"), F.count("value").alias("candidates"))
    hit = F.coalesce(F.col("m.d") <= F.greatest(F.lit(absolute), F.abs("expected") * relative), F.lit(False))
    return found.select(*expected.columns, "candidates", F.col("m.v").alias("closest"), hit.alias("hit"))
