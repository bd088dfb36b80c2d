"""Declarative rules over contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def condition(key: str, values: list[str]) -> Column:
    """F8: one key of a rule's match as a predicate. The suffix says how: of ``_terms_*`` the text holds the values, else the array has them."""
    for suffix, kind in (("_terms_any", "any"), ("_terms_all", "all"), ("_terms_none", "none")):
        if key.endswith(suffix):
            text = F.lower(F.coalesce(F.col(key.removesuffix(suffix)).cast("string"), F.lit("")))
            held = [text.contains(v.lower()) for v in values]
            return {"any": _any(held), "all": ~_any([~h for h in held]), "none": ~_any(held)}[kind]
    for suffix in ("_any", "_all", "_none", ""):
        if suffix and not key.endswith(suffix):
            continue
        own = F.coalesce(F.col(key.removesuffix(suffix) if suffix else key), F.array().cast("array<string>"))
        wanted = F.array(*[F.lit(v) for v in values])
        if suffix == "_all":
            return F.size(F.array_except(wanted, own)) == 0
        overlap = F.arrays_overlap(own, wanted)
        return ~overlap if suffix == "_none" else overlap
    raise AssertionError


def matches(rule: dict[str, list[str]]) -> Column:
    """F8: the conjunction of a rule's conditions; an empty rule matches everything."""
    return reduce(lambda a, b: a & b, [condition(k, v) for k, v in sorted(rule.items())], F.lit(True))


def apply_rules(contexts: DataFrame, rules: list[dict]) -> DataFrame:
    """One row for each context and rule that matches, REVIEW with reasons or CONFIRMED.

    A rule has id, match, status, enabled and action. Contexts have ``id``, ``status`` and ``bound`` (whether all inputs are). Rules are
    configuration: they are compiled into one projection, so contexts are read once and never crossed with a table.
    """
    verdicts = []
    for r in rules:
        reasons = F.array_compact(F.array(F.when(F.lit(r["status"] != "APPROVED"), "rule_not_approved"), F.when(F.lit(not r.get("enabled", True)), "rule_disabled"), F.when(F.col("status") != "PASS", "component_not_pass"), F.when(~F.col("bound"), "inputs_not_bound")))
        verdicts.append(F.when(matches(r["match"]), F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["action"]).alias("action"), reasons.alias("reasons"))))
    out = contexts.select("id", F.explode(F.array_compact(F.array(*verdicts))).alias("v"))
    return out.select("id", "v.rule", "v.action", F.array_join("v.reasons", ",").alias("reasons"), F.when(F.size("v.reasons") == 0, "CONFIRMED").otherwise("REVIEW").alias("status"))


def visible(invisible: Column, frozen: Column, hidden: Column) -> Column:
    """not invisible, frozen or hidden; an unknown flag doesn't hide."""
    return ~(F.coalesce(invisible, F.lit(False)) | F.coalesce(frozen, F.lit(False)) | F.coalesce(hidden, F.lit(False)))


def object_layer(layer: Column, annotation: list[str]) -> Column:
    """a layer whose name has no annotation token."""
    return ~F.coalesce(F.lower(layer).rlike("|".join(annotation)), F.lit(False))


def standalone(text: Column, code: Column) -> Column:
    """whether a text has the code outside longer connected identifiers."""
    return F.coalesce(F.expr("false") if code is None else F.regexp_like(F.upper(text), F.concat(F.lit(r"(?<![A-Z0-9_.-])\Q"), F.upper(code), F.lit(r"\E(?![A-Z0-9_-])"))), F.lit(False))


def real_view(view: Column) -> Column:
    """neither empty nor a stand-in for "not applicable"."""
    return F.coalesce(~F.lower(F.trim(view)).rlike(r"^(|n/?a|none|null|nil|-+|tbd|unknown)$"), F.lit(False))


def evidence_list(ids: Column) -> Column:
    """a list of ids that isn't empty and has no blank one."""
    return F.coalesce((F.size(ids) > 0) & F.forall(ids, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(False))


def generic_title(title: Column, words: list[str]) -> Column:
    """a title that names a view or a material alone, by the given words."""
    return F.coalesce(F.lower(F.trim(title)).rlike(rf"^(?:(?:{'|'.join(words)})[\s0-9.:-]*)+$"), F.lit(False))


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """the name of the first check that fails, null if none does; an unknown outcome fails."""
    out = F.lit(None).cast("string")
    for name, good in reversed(checks):
        out = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(out)
    return out


def contaminated(task: Column, answers: list[str]) -> Column:
    """whether a JSON object has a key that gives the answer away, at any depth."""
    return F.coalesce(task.rlike("\"(?:" + "|".join(answers) + ")\"\\s*:"), F.lit(False))


def schema_audit(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """C4: the rows with ``violations``, the names of the checks that they fail; an unknown outcome doesn't fail."""
    failed = [F.when(~F.coalesce(c, F.lit(True)), n) for n, c in sorted(checks.items())]
    return rows.withColumn("violations", F.array_join(F.array_compact(F.array(*failed)), ","))


def confirm(candidates: DataFrame, choices: DataFrame, key: str, candidate: str) -> DataFrame:
    """Each key with its reviewer's choice if that is among its candidates, else with the reason unknown_choice; keys without a choice keep null."""
    known = choices.join(candidates.select(key, F.col(candidate).alias("choice")).distinct(), [key, "choice"], "left_semi").select(key, "choice").withColumn("__ok", F.lit(True))
    out = candidates.select(key).distinct().join(choices.select(key, "choice"), key, "left").join(known, [key, "choice"], "left")
    return out.select(key, F.when(F.col("__ok"), F.col("choice")).alias("chosen"), F.when(F.col("choice").isNotNull() & F.col("__ok").isNull(), "unknown_choice").alias("reason"))
