"""Mixing sources to target weights, with DataFrame functions alone.

A token budget goes down a tree of domain, language and source by integer weights. A node whose data can't fill its
share, at ``max_epochs`` passes at most, is filled, and what is short goes to its siblings by their weights; only what
a whole family can't take goes to its ancestors' siblings. A leaf takes whole epochs of its documents and, from one
more, the longest prefix in that epoch's seeded order whose tokens fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, if_few, word_count

LEVELS = ["domain", "language", "origin"]
#: Hexadecimal digits of a document's place in an epoch that are summed at a time, and how often: after them, a leaf's edge has its rows / 16 ** 6.
DIGITS, ROUNDS = 3, 2
_HEX = "0123456789abcdef"


def weight_of(weights: dict[tuple, int], level: int) -> F.Column:
    """The weight of each node of a level, by its path; 1 where none is given. ``weights`` is configuration: a few entries."""
    path = [F.col(c) for c in LEVELS[: level + 1]]
    out = F.lit(1)
    for key, w in weights.items():
        if len(key) == level + 1:
            here = F.lit(True)
            for column, value in zip(path, key):
                here = here & (column == F.lit(value))
            out = F.when(here, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(10,0)")


def share_out(nodes: DataFrame, parents: list[str], node: str) -> DataFrame:
    """``nodes`` (budget: that of the parent; w, cap) with ``given``: each node's whole number of tokens.

    Children are taken by cap / w; the first of them are full as long as an even level over the rest would overfill
    them, the others share what is left by weight, rounded down. Children of one cap and weight are one step. The steps are summed in
    a histogram of cap / w (64 cells for each doubling, 4096 at most a family); only those of the cell in which the level
    lies are put in order one by one.
    """
    family = parents or ["__one"]
    nodes = nodes if parents else nodes.withColumn("__one", F.length(node) * 0)  # one family; no literal, so that it is a key to join on
    ratio = F.col("cap").cast("double") / F.col("w").cast("double")
    steps = nodes.groupBy(*family, "budget", "cap", "w").agg(F.count("*").alias("k")).withColumns({"ratio": ratio, "cell": F.floor(F.log2(ratio + 1) * 64)})
    total = lambda c: F.sum((F.col(c) * F.col("k")).cast("decimal(25,0)"))
    cells = steps.groupBy(*family, "budget", "cell").agg(total("cap").alias("caps"), total("w").alias("ws"), F.max("ratio").alias("top"))
    order = Window.partitionBy(*family).orderBy("cell")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    none = F.lit(0).cast("decimal(38,0)")
    cells = cells.withColumns({"caps_before": F.coalesce(F.sum("caps").over(before), none), "ws_after": F.coalesce(F.sum("ws").over(after), none)})
    # steps of lower cells than the level's are full, those of higher ones aren't: a cell before which the caps leave nothing can't be
    within = steps.join(cells.select(*family, "cell", "caps_before", "ws_after"), [*family, "cell"])
    inner = Window.partitionBy(*family, "cell").orderBy("ratio", "cap")
    lower, upper = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    caps = F.col("caps_before") + F.coalesce(total("cap").over(lower), none)
    ws = F.col("ws_after") + total("w").over(upper)
    full = within.withColumn("full", F.col("cap").cast("decimal(20,0)") * ws.cast("decimal(18,0)") <= (F.col("budget") - caps).cast("decimal(20,0)") * F.col("w"))
    sums = full.groupBy(*family).agg(F.coalesce(F.sum(F.when(F.col("full"), (F.col("cap") * F.col("k")).cast("decimal(25,0)"))), none).alias("spent"), F.coalesce(F.sum(F.when(~F.col("full"), (F.col("w") * F.col("k")).cast("decimal(25,0)"))), none).alias("weight"), F.max(F.when(F.col("full"), F.col("ratio"))).alias("level"))
    shared = nodes.join(if_few(cut(sums)), family).withColumns({"full": F.coalesce(ratio <= F.col("level"), F.lit(False)), "rest": (F.col("budget") - F.col("spent")).cast("decimal(20,0)"), "weight": F.col("weight").cast("decimal(18,0)")})
    return shared.withColumn("given", F.expr("case when full then cap else cast(rest * w div weight as bigint) end")).drop("full", "rest", "weight", "spent", "level", "__one")


def leaf_budgets(leaves: DataFrame, weights: dict[tuple, int], share: float, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, language, origin, tokens) with each one's ``given`` tokens; the budget is ``share``, to a thousandth, of all."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")).first()[0]
    given = None
    for level, name in enumerate(LEVELS):
        nodes = caps.groupBy(*LEVELS[: level + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", weight_of(weights, level))
        parents = LEVELS[:level]
        nodes = nodes.withColumn("budget", F.lit(total * round(share * 1000) // 1000)) if given is None else nodes.join(given, parents)
        given = share_out(nodes, parents, name).select(*LEVELS[: level + 1], F.col("given").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "given"), LEVELS)


def epoch_key(seed: int, epoch: F.Column, doc_id: str) -> F.Column:
    """A document's place in an epoch's order: equal ids share it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def edges_of(sums: DataFrame, leaves: DataFrame, at: int) -> DataFrame:
    """``leaves`` (levels, rest, prefix, before) with the prefix longer by ``DIGITS``: where the running sum of ``sums`` (levels, bucket, s) passes ``rest``.

    A digit at a time, by sixteen sums a leaf, which Spark adds up before it shuffles.
    """
    names = [*LEVELS, "rest", "prefix", "before"]
    for k in range(DIGITS):
        digit = F.substring("bucket", at + k + 1, 1)
        met = sums.join(leaves, LEVELS).where(F.col("bucket").startswith(F.col("prefix")))
        each = met.groupBy(*names).agg(*[F.coalesce(F.sum(F.when(digit == d, F.col("s"))), F.lit(0)).alias(f"s{d}") for d in _HEX])
        start = F.struct(F.col("before"), F.lit("").alias("found"))
        parts = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"s{d}").alias("s")) for d in _HEX])
        walk = F.aggregate(parts, start, lambda a, x: F.when((a["found"] == "") & (a["before"] + x["s"] > F.col("rest")), F.struct(a["before"].alias("before"), x["d"].alias("found"))).when(a["found"] == "", F.struct((a["before"] + x["s"]).alias("before"), F.lit("").alias("found"))).otherwise(a))
        leaves = each.withColumn("w", walk).where("w.found <> ''").select(*LEVELS, "rest", F.concat("prefix", "w.found").alias("prefix"), F.col("w.before").alias("before"))
        leaves = if_few(cut(leaves))
    return leaves


def mixing_plan(rows: DataFrame, weights: dict[tuple, int], share: float, max_epochs: int, seed: int) -> DataFrame:
    """(domain, language, origin, tokens, given, epochs, last): whole epochs of each leaf, and the last key of the next one that fits.

    ``rows`` has doc_id, the levels and n_tokens. A leaf's edge is found by sums over leading digits of the keys; only the keys that share six digits
    with it, one in sixteen millions, are put in order, and equal keys are one.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, weights, share, max_epochs)
    plan = cut(plan.withColumns({"epochs": F.expr("case when tokens = 0 then 0 else given div tokens end"), "rest": F.expr("case when tokens = 0 then 0 else given % tokens end")}))
    keyed = rows.join(if_few(plan.select(*LEVELS, "epochs")), LEVELS).select(*LEVELS, epoch_key(seed, F.col("epochs"), "doc_id").alias("key"), "n_tokens")
    edge = if_few(plan.where("rest > 0").select(*LEVELS, "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before")))
    for k in range(ROUNDS):
        near = keyed if not k else keyed.join(edge, LEVELS).where(F.col("key").startswith(F.col("prefix"))).select(*LEVELS, "key", "n_tokens")
        sums = cut(near.groupBy(*LEVELS, F.substring("key", 1, (k + 1) * DIGITS).alias("bucket")).agg(F.sum("n_tokens").alias("s")))
        edge = edges_of(sums, edge, k * DIGITS)
    at_edge = keyed.join(edge, LEVELS).where(F.col("key").startswith(F.col("prefix"))).groupBy(*LEVELS, "rest", "before", "key").agg(F.sum("n_tokens").alias("s"))
    inside = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = at_edge.withColumn("run", F.col("before") + F.sum("s").over(inside)).where("run <= rest")
    last = fits.groupBy(*LEVELS).agg(F.max("key").alias("key"))
    out = plan.join(edge.select(*LEVELS, "prefix"), LEVELS, "left").join(last, LEVELS, "left")
    return out.select(*LEVELS, "tokens", "given", "epochs", F.coalesce("key", "prefix", F.lit("")).alias("last"))


def mix_sources(df: DataFrame, weights: dict[tuple, int], domain: F.Column, share: float = 0.6, max_epochs: int = 3, seed: int = 0, doc_id: str = "doc_id", text: str = "text", language: str = "lang", origin: str = "source") -> DataFrame:
    """``df`` once for each epoch that takes the row, with ``epoch`` (from 0) and ``n_tokens`` (words of its text).

    ``share`` of all tokens is the budget. Null levels count as one node "unknown"; a node's weight is 1 unless given.
    Rows of equal ids in a leaf are taken or left together. Texts without words cost nothing and go with the prefix;
    leaves without tokens give no rows. Columns named epoch or n_tokens are replaced; an empty table gives no rows.
    """
    names = [c for c in df.columns if c not in ("epoch", "n_tokens")]
    level = [F.coalesce(c.cast("string"), F.lit("unknown")) for c in (domain, F.col(language), F.col(origin))]
    rows = df.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for c, n in zip(level, LEVELS)], word_count(text).alias("n_tokens"))
    plan = mixing_plan(cut(rows), weights, share, max_epochs, seed)
    plan = if_few(cut(plan.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], "epochs", "last").withColumnsRenamed({"epochs": "__epochs", "last": "__last"})))
    met = level[0].eqNullSafe(F.col("__domain")) & level[1].eqNullSafe(F.col("__language")) & level[2].eqNullSafe(F.col("__origin"))
    copies = F.col("__epochs") + F.when(epoch_key(seed, F.col("__epochs"), doc_id) <= F.col("__last"), 1).otherwise(0)
    taken = df.join(plan, met).withColumn("__copies", copies.cast("int")).where("__copies > 0")
    return taken.select(*names, word_count(text).alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("epoch"))
