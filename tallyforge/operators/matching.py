"""Uniqueness-gated matching of predictions and reviewed rows, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.graphs import connected_components
from tallyforge.plans.checkpoints import cut


def unique_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_id: str = "l", right_id: str = "r") -> DataFrame:
    """(left_id, right_id) for each key that exactly one row of either side has; null keys match nothing."""
    one = lambda df, i: df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(i).alias(i)).where("__n = 1").drop("__n")
    return one(left, left_id).join(one(right, right_id), keys).select(left_id, right_id)


def without(df: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return df.join(matched.select(key), key, "left_anti")


def staged_match(left: DataFrame, right: DataFrame, stages: list[list[str]], left_id: str = "l", right_id: str = "r") -> DataFrame:
    """J15, first stages: matches by each list of keys in turn, unique on both sides among the rows that no earlier stage matched.

    Returns left_id, right_id and stage, from 1. Each stage's pairs, a few numbers a row, are checkpointed, so that the next ones read them instead
    of matching again.
    """
    out = None
    for number, keys in enumerate(stages, 1):
        a, b = (left, right) if out is None else (without(left, out, left_id), without(right, out, right_id))
        found = cut(unique_pairs(a, b, keys, left_id, right_id).withColumn("stage", F.lit(number)))
        out = found if out is None else out.unionByName(found)
    return out


#: Pairs of a component that one task matches at once, and of a group of such components; rounds on larger ones before their components are sought again.
WHOLE, GROUP, ROUNDS = 20_000, 100_000, 4


def _solver(before: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pairs: _rounds_of(pairs, before)


def _rounds_of(pairs: pd.DataFrame, before: int) -> pd.DataFrame:
    """Matches of whole components (component, l, r, score), round by round, all components at once; one without a match in a round is done."""
    left, right, part = (pd.factorize(pairs[c])[0] for c in ("l", "r", "component"))
    rank = np.unique(pairs["score"].to_numpy(), return_inverse=True)[1]  # a NaN is above all numbers, as in Spark
    rows, number, taken = np.arange(len(pairs)), before, []
    while len(rows):
        number += 1
        sole = np.ones(len(rows), bool)
        for side in (left[rows], right[rows]):
            top = np.full(side.max() + 1, -1)
            np.maximum.at(top, side, rank[rows])
            at_top = rank[rows] == top[side]
            sole &= at_top & (np.bincount(side[at_top], minlength=len(top))[side] == 1)
        found = rows[sole]
        taken.append((found, np.full(len(found), number)))
        gone = np.isin(left[rows], left[found]) | np.isin(right[rows], right[found])
        rows = rows[~gone & np.isin(part[rows], part[found])]
    chosen, rounds = (np.concatenate(x) for x in zip(*taken))
    return pairs.iloc[chosen][["l", "r"]].assign(round=rounds.astype("int32"))


def _one_round(pairs: DataFrame, number: int) -> DataFrame:
    """The pairs that are the one best of both their rows: grouped maxima and joins, so that a row of any number of pairs is in no single task."""
    best = pairs
    for side in ("l", "r"):
        top = pairs.groupBy(side).agg(F.max("score").alias("__m"))
        at_top = pairs.join(top, side).where(F.col("score") == F.col("__m"))
        sole = at_top.groupBy(side).agg(F.count("*").alias("__n")).where("__n = 1").select(side)
        best = best.join(top, side).where(F.col("score") == F.col("__m")).drop("__m").join(sole, side, "left_semi")
    return cut(best.select("l", "r", F.lit(number).alias("round")))


def mutual_best(pairs: DataFrame, left_id: str = "l", right_id: str = "r", score: str = "score", whole: int = WHOLE) -> DataFrame:
    """J15, last stage: takes the pairs that are the one best of both their rows, drops those rows, and repeats until none is left.

    Rows with a tie for the best wait for the tie to be resolved by others' matches. Components of up to ``whole`` pairs are matched to the end by one
    task each, however many rounds they need. Larger ones go through ROUNDS rounds of grouped maxima and joins, each checkpointed, and what they
    fall into is taken up again. ``whole`` changes the cost, never the result. A null id or score matches nothing. Returns left_id, right_id and round.
    """
    known = pairs.select(F.col(left_id).alias("l"), F.col(right_id).alias("r"), F.col(score).alias("score"))
    known = cut(known.where(F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("score").isNotNull()))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    done, number, open_pairs = [], 0, known
    while not open_pairs.isEmpty():
        ends = open_pairs.withColumns({"__a": F.xxhash64(F.lit(0), "l"), "__b": F.xxhash64(F.lit(1), "r")})  # equal hashes join components, which does no harm
        roots = cut(connected_components(ends.select(F.col("__a").alias("a"), F.col("__b").alias("b"))).select(F.col("node").alias("__a"), F.col("root").alias("component")))
        rooted = cut(ends.join(roots, "__a").select("component", "l", "r", "score"))
        sizes = cut(rooted.groupBy("component").agg(F.count("*").alias("n")))
        small = rooted.join(sizes.where(F.col("n") <= whole).select("component"), "component", "left_semi")
        groups = max(1, -(-(sizes.where(F.col("n") <= whole).agg(F.sum("n")).first()[0] or 0) // GROUP))
        dealt = small.groupBy(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("__group"))
        done.append(cut(dealt.applyInPandas(_solver(number), f"l {kinds['l']}, r {kinds['r']}, round int")))
        open_pairs = cut(rooted.join(sizes.where(F.col("n") > whole).select("component"), "component", "left_semi").select("l", "r", "score"))
        for _ in range(ROUNDS):
            if open_pairs.isEmpty():
                break
            number += 1
            found = _one_round(open_pairs, number)
            done.append(found)
            open_pairs = cut(without(without(open_pairs, found, "l"), found, "r")) if not found.isEmpty() else open_pairs.limit(0)
    out = done[0] if done else known.select("l", "r", F.lit(0).alias("round")).where("false")
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "round")


def anchor_pairs(left: DataFrame, right: DataFrame, material: str, anchors: list[str], least: int = 2, left_id: str = "l", right_id: str = "r") -> DataFrame:
    """Pairs of rows that share the material and ``least`` (two or more) anchors, with the number of anchors that agree as ``score``.

    Rows meet on the material and each two of their anchors, not on the material alone; nulls agree with nothing.
    """
    pairs = [(i, j) for i in range(len(anchors)) for j in range(i + 1, len(anchors))]

    def keyed(df: DataFrame, id_: str, p: str) -> DataFrame:
        keys = F.array(*[F.when(F.col(anchors[i]).isNotNull() & F.col(anchors[j]).isNotNull(), F.struct(F.lit(n).alias("n"), F.col(anchors[i]).cast("string").alias("x"), F.col(anchors[j]).cast("string").alias("y"))) for n, (i, j) in enumerate(pairs)])
        return df.where(F.col(material).isNotNull()).select(id_, material, *[F.col(c).alias(f"{p}{c}") for c in anchors], F.explode(F.array_compact(keys)).alias("__k"))

    met = keyed(left, left_id, "__l").join(keyed(right, right_id, "__r"), [material, "__k"])
    agree = sum((F.coalesce((F.col(f"__l{c}") == F.col(f"__r{c}")).cast("int"), F.lit(0)) for c in anchors), F.lit(0))
    return met.groupBy(left_id, right_id).agg(F.max(agree).alias("score")).where(F.col("score") >= least)


#: Pairs a row up to which the last stage lists them all; beyond that it goes by counts.
LISTED = 8


def anchor_matches(left: DataFrame, right: DataFrame, material: str, anchors: list[str], least: int = 2, left_id: str = "l", right_id: str = "r", listed: float = LISTED) -> DataFrame:
    """J15, last stage: (left_id, right_id), the ``mutual_best`` of ``anchor_pairs``, without listing the pairs where they are many. Ids are unique.

    Rows of one side with equal fields are a class: two or more tie for each partner for ever, so a class stands for all its rows. A row's best score is the size of
    its largest set of anchors that a row of the other side shares, and at that size no partner is in two such sets: counts by material and set give how many are best, and
    which one if it is sole. A round takes the pairs that are each other's sole best, as long as there are any; each costs what the rows and their sets of anchors do.
    Once the pairs left are at most ``listed`` a row they are listed, so that long chains end in one task. ``listed`` changes the cost, never the result.
    """
    sets = [s for k in range(least, len(anchors) + 1) for s in combinations(range(len(anchors)), k)]

    def classes(df: DataFrame, id_: str) -> DataFrame:
        fields = [F.col(material).alias("m"), *[F.col(a).cast("string").alias(f"a{i}") for i, a in enumerate(anchors)]]
        known = df.where(F.col(material).isNotNull() & F.col(id_).isNotNull()).groupBy(*fields)
        return cut(known.agg(F.min(id_).alias("id"), F.max(id_).alias("last")).withColumn("n", F.when(F.col("id") == F.col("last"), 1).otherwise(2)))

    def keyed(side: DataFrame) -> DataFrame:
        whole = lambda s: F.forall(F.array(*[F.col(f"a{i}").isNotNull() for i in s]), lambda x: x)
        keys = [F.when(whole(s), F.struct(F.lit(len(s)).alias("k"), F.lit(n).alias("s"), F.array(*[F.col(f"a{i}") for i in s]).alias("v"))) for n, s in enumerate(sets)]
        return side.select("m", "id", "n", F.explode(F.array_compact(F.array(*keys))).alias("key"))

    def sole(one: DataFrame, counts: DataFrame) -> DataFrame:
        met = keyed(one.where("n = 1")).drop("n").join(counts.hint("merge"), ["m", "key"])
        sizes = met.groupBy("id", F.col("key.k").alias("k")).agg(F.sum("n").alias("n"), F.min("other").alias("other"))
        return sizes.groupBy("id").agg(F.max(F.struct("k", "n", "other")).alias("b")).where("b.n = 1").select("id", F.col("b.other").alias("other"))

    both, done = [classes(left, left_id), classes(right, right_id)], []
    rows = lambda side, id_: side.select(F.explode(F.array_distinct(F.array("id", "last"))).alias(id_), F.col("m").alias(material), *[F.col(f"a{i}").alias(a) for i, a in enumerate(anchors)])
    while True:
        counts = [cut(keyed(side).groupBy("m", "key").agg(F.sum("n").alias("n"), F.min("id").alias("other"))) for side in both]
        lowest = [c.where(F.col("key.k") == least) for c in counts]
        open_pairs = lowest[0].join(lowest[1].select("m", "key", F.col("n").alias("__n")).hint("merge"), ["m", "key"]).agg(F.sum(F.col("n").cast("double") * F.col("__n"))).first()[0] or 0.0
        if not open_pairs:
            break
        if open_pairs <= listed * sum(side.count() for side in both):
            pairs = anchor_pairs(rows(both[0], left_id), rows(both[1], right_id), material, anchors, least, left_id, right_id)
            done.append(mutual_best(pairs, left_id, right_id).select(left_id, right_id))
            break
        first = sole(both[0], counts[1]).select(F.col("id").alias(left_id), F.col("other").alias(right_id))
        second = sole(both[1], counts[0]).select(F.col("other").alias(left_id), F.col("id").alias(right_id))
        found = cut(first.join(second.hint("merge"), [left_id, right_id]))
        if found.isEmpty():
            break
        done.append(found)
        both = [cut(side.join(found.select(F.col(i).alias("id")).hint("merge"), "id", "left_anti")) for side, i in zip(both, (left_id, right_id))]
    out = done[0] if done else left.select(left_id).join(right.select(right_id), F.lit(False))
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def match_rows(left: DataFrame, right: DataFrame, component: str, row: str, material: str, anchors: list[str], left_id: str = "l", right_id: str = "r") -> DataFrame:
    """Predicted (left) and reviewed (right) rows by component id, row id, categorical signature - each unique on both sides -, then mutual best anchors.

    A signature is the material and all anchors; it needs the material and one anchor. Numbers take no part. Returns left_id, right_id and method.
    """
    some = F.coalesce(*[F.col(a).cast("string") for a in anchors])
    signature = F.when(F.col(material).isNotNull() & some.isNotNull(), F.to_json(F.struct(material, *anchors), {"ignoreNullFields": "false"}))
    left, right = (df.withColumn("__signature", signature) for df in (left, right))
    stages = staged_match(left, right, [[component], [row], ["__signature"]], left_id, right_id)
    last = anchor_matches(without(left, stages, left_id), without(right, stages, right_id), material, anchors, 2, left_id, right_id).withColumn("method", F.lit("mutual_best"))
    names = F.array(*map(F.lit, ("component_id", "row_id", "signature")))
    return stages.select(left_id, right_id, F.element_at(names, F.col("stage")).alias("method")).unionByName(last)


def evaluate_projects(predicted: DataFrame, gold: DataFrame, matches: DataFrame, outcomes: dict[str, tuple[Column, Column]], identities: list[str], key: str = "project", target: float = 0.95, left_id: str = "l", right_id: str = "r") -> DataFrame:
    """Rows, recall, precision and gate of each project.

    ``outcomes`` gives for each field its verdict on a matched row (columns of the gold row, and of the predicted one as p_<name>) and whether the gold row has it. A gold
    row that lacks a field is invalid and not eligible; without a prediction its fields fail. A row is correct if all fields pass. BLOCKED: an invalid
    row, an identity (``identities``) that several gold rows of the project have, or no gold rows. INDETERMINATE: an unresolved field or nothing eligible. Else PASS if recall
    and precision reach the target.
    """
    own = predicted.select(*[F.col(c).alias(c if c == left_id else f"p_{c}") for c in predicted.columns])
    rows = gold.join(matches.select(left_id, right_id), right_id, "left").join(own, left_id, "left")
    has = [h for _, h in outcomes.values()]
    verdict = {n: F.when(F.col(left_id).isNull(), F.when(h, "FAIL").otherwise("UNRESOLVED")).otherwise(c) for n, (c, h) in outcomes.items()}
    marked = rows.withColumns({**{f"__v_{n}": c for n, c in verdict.items()}, "__eligible": F.forall(F.array(*[F.coalesce(h, F.lit(False)) for h in has]), lambda x: x)})
    every = F.array(*[F.col(f"__v_{n}") for n in outcomes])
    correct = F.col("__eligible") & F.col(left_id).isNotNull() & F.forall(every, lambda v: v == "PASS")
    sums = marked.groupBy(key).agg(F.count("*").alias("gold_rows"), F.count_if("__eligible").alias("eligible"), F.count_if(correct).alias("correct"), F.bool_or(F.array_contains(every, "UNRESOLVED")).alias("__unresolved"))
    repeated = None
    for c in identities:
        twice = gold.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count("*").alias("n")).where("n > 1").groupBy(key).agg(F.count("*").alias("__twice"))
        repeated = twice if repeated is None else repeated.unionByName(twice)
    doubles = repeated.groupBy(key).agg(F.sum("__twice").alias("duplicate_identities"))
    counts = predicted.groupBy(key).agg(F.count("*").alias("predicted_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = sums.join(counts, key, "full_outer").join(doubles, key, "left").select(key, *[zero(c) for c in ("gold_rows", "predicted_rows", "eligible", "correct", "duplicate_identities")], F.coalesce("__unresolved", F.lit(False)).alias("__unresolved"))
    recall, precision = F.try_divide("correct", "eligible"), F.coalesce(F.try_divide("correct", "predicted_rows"), F.lit(0.0))
    blocked = (F.col("gold_rows") == 0) | (F.col("eligible") < F.col("gold_rows")) | (F.col("duplicate_identities") > 0)
    gate = F.when(blocked, "BLOCKED").when(F.col("__unresolved") | (F.col("eligible") == 0), "INDETERMINATE").when((recall >= target) & (precision >= target), "PASS").otherwise("FAIL")
    return out.select(key, "gold_rows", "predicted_rows", "eligible", "correct", "duplicate_identities", recall.alias("recall"), precision.alias("precision"), gate.alias("gate"))


def one_to_one(pairs: DataFrame, bucket: list[str], left_id: str = "l", right_id: str = "r", score: str = "score") -> DataFrame:
    """Per left row its state: MATCHED to the right row if the pair is alone in its bucket or the sole best of both, else AMBIGUOUS, or MISSING without pairs.

    Elimination follows: rows whose other candidates are all taken are matched in the next pass.
    """
    taken = mutual_best(pairs, left_id, right_id, score)
    counts = pairs.groupBy(*bucket, left_id).agg(F.count("*").alias("candidates"))
    out = counts.join(taken, left_id, "left")
    return out.select(*bucket, left_id, right_id, "candidates", F.when(F.col(right_id).isNotNull(), "MATCHED").otherwise("AMBIGUOUS").alias("state"))


def bound_records(selections: DataFrame, records: DataFrame, key: str, sequence: str, identity: list[str]) -> DataFrame:
    """Each selection's record: by its stable key; without one by its sequence number, if that is unique and the identity agrees; else an error.

    Records have ``record_id``. Errors are missing, sequence_not_unique and identity_differs.
    """
    by_key = records.groupBy(key).agg(F.min("record_id").alias("__k"))
    by_sequence = records.groupBy(sequence).agg(F.count("*").alias("__n"), F.min("record_id").alias("__s"), *[F.min(c).alias(f"__{c}") for c in identity])
    joined = selections.join(by_key, key, "left").join(by_sequence, sequence, "left")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    error = F.when(F.col("__k").isNotNull(), None).when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "sequence_not_unique").when(~same, "identity_differs")
    out = joined.withColumns({"error": error, "record_id": F.when(error.isNull(), F.coalesce("__k", "__s"))})
    return out.select(*selections.columns, "record_id", "error")


def evaluate_fields(matched: DataFrame, outcomes: dict[str, Column], keys: list[str]) -> DataFrame:
    """Per key and field the rows that pass, fail and stay unresolved, and the share that passes of those decided."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("outcome")) for n, c in sorted(outcomes.items())])
    long = matched.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.field", "f.outcome")
    counts = long.groupBy(*keys, "field").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("PASS", "FAIL", "UNRESOLVED")])
    return counts.withColumn("accuracy", F.try_divide(F.col("pass"), F.col("pass") + F.col("fail")))


def project_gate(rows: DataFrame, key: str, target: float = 0.95, blocked: Column | None = None) -> DataFrame:
    """Recall, precision and gate of a project from rows with eligible, predicted and correct.

    BLOCKED beats INDETERMINATE (nothing eligible or nothing predicted), which beats PASS (both reach the target) and FAIL.
    """
    counts = rows.groupBy(key).agg(F.count_if("eligible").alias("eligible"), F.count_if("predicted").alias("predicted"), F.count_if(F.col("eligible") & F.col("correct")).alias("correct"), F.bool_or(blocked if blocked is not None else F.lit(False)).alias("blocked"))
    out = counts.withColumns({"recall": F.try_divide("correct", "eligible"), "precision": F.try_divide("correct", "predicted")})
    gate = F.when(F.col("blocked"), "BLOCKED").when(F.col("recall").isNull() | F.col("precision").isNull(), "INDETERMINATE").when((F.col("recall") >= target) & (F.col("precision") >= target), "PASS").otherwise("FAIL")
    return out.withColumn("gate", gate).drop("blocked")


def batch_evaluation(projects: DataFrame) -> DataFrame:
    """One row over all projects: macro means, micro ratios, and the worst gate."""
    worst = F.max(F.when(F.col("gate") == "BLOCKED", 3).when(F.col("gate") == "INDETERMINATE", 2).when(F.col("gate") == "FAIL", 1).otherwise(0))
    sums = projects.agg(F.count("*").alias("projects"), F.avg("recall").alias("macro_recall"), F.avg("precision").alias("macro_precision"), F.try_divide(F.sum("correct"), F.sum("eligible")).alias("micro_recall"), F.try_divide(F.sum("correct"), F.sum("predicted")).alias("micro_precision"), worst.alias("w"))
    return sums.withColumn("gate", F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "INDETERMINATE", "BLOCKED"))), F.col("w") + 1)).drop("w")


def error_metrics(matched: DataFrame, keys: list[str], gold: str, predicted: str, tolerance: float = 1e-9) -> DataFrame:
    """Mean absolute error, and mean absolute percentage error over rows whose gold value isn't about zero."""
    d = F.abs(F.col(predicted) - F.col(gold))
    return matched.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mae"), F.avg(F.when(F.abs(gold) > tolerance, d / F.abs(gold))).alias("mape"))


def digest_join(left: DataFrame, right: DataFrame, digest: str, fields: list[str], supported: Column) -> DataFrame:
    """Rows of both sides by digest. A digest that a side has twice is never matched; a pair gets its fields' verdicts.

    Per digest: state matched, duplicate, left_only or right_only, and for matched ones ``verdicts``, ``field:PASS|FAIL|UNRESOLVED`` (a null on either side is unresolved).
    """
    side = lambda df, p: df.where(supported).groupBy(digest).agg(F.count("*").alias(f"{p}n"), *[F.min(f).alias(f"{p}{f}") for f in fields])
    joined = side(left, "l_").join(side(right, "r_"), digest, "full_outer")
    state = F.when((F.coalesce("l_n", F.lit(0)) > 1) | (F.coalesce("r_n", F.lit(0)) > 1), "duplicate").when(F.col("r_n").isNull(), "left_only").when(F.col("l_n").isNull(), "right_only").otherwise("matched")
    verdict = lambda f: F.when(F.col(f"l_{f}").isNull() | F.col(f"r_{f}").isNull(), "UNRESOLVED").when(F.col(f"l_{f}") == F.col(f"r_{f}"), "PASS").otherwise("FAIL")
    verdicts = F.concat_ws(",", *[F.concat(F.lit(f"{f}:"), verdict(f)) for f in fields])
    return joined.select(digest, state.alias("state"), F.when(state == "matched", verdicts).alias("verdicts"))


