"""Quantities, amounts and prices of takeoff items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numeric import price_date, unfolded_width

THOUSANDTH, MILLIONTH = "cast(0.001 as decimal(3,3))", "cast(0.000001 as decimal(6,6))"
SPEC_FIELDS = ["name", "grade", "thickness_mm", "finish", "process"]


def calculate_items(items: DataFrame) -> DataFrame:
    """M5: engineering quantity, amount, status and the first missing input of each item.

    By length: length * quantity / 1000; by area: width * length * quantity / 1000000, the width being that of the
    unfolded specification if none is given; by piece or set: the quantity. Rounded half up to 6 and, for amounts from the
    unrounded quantity, to 2 places. An item without an input that its unit needs is BLOCKed and has no values; the reason
    names the first of unit, quantity, length, width. Empty input gives no rows.
    """
    q, length = F.col("quantity").cast("decimal(10,2)"), F.col("length_mm").cast("decimal(10,2)")
    width = F.coalesce(F.col("width_mm").cast("decimal(10,2)"), unfolded_width(F.col("unfolded_spec")).cast("decimal(10,2)"))
    typed = items.withColumns({"__q": q, "__l": length, "__w": width, "__p": F.col("unit_price").cast("decimal(10,2)")})
    by_length, by_area, by_piece = F.col("unit") == "m", F.col("unit") == "㎡", F.col("unit").isin("件", "套")
    exact = F.when(by_length, F.expr(f"cast(__l * __q * {THOUSANDTH} as decimal(26,9))")).when(by_area, F.expr(f"cast(__w * __l * __q * {MILLIONTH} as decimal(26,9))")).when(by_piece, F.expr("cast(__q as decimal(26,9))"))
    reason = (
        F.when(~F.coalesce(by_length | by_area | by_piece, F.lit(False)), "unit")
        .when(F.col("__q").isNull(), "quantity")
        .when((by_length | by_area) & F.col("__l").isNull(), "length")
        .when(by_area & F.col("__w").isNull(), "width")
    )
    out = typed.withColumns({"__exact": exact, "block_reason": reason})
    amount = F.round(F.expr("cast(__exact as decimal(20,9)) * __p"), 2).cast("decimal(20,2)")
    return out.withColumns({
        "engineering_quantity": F.when(F.col("block_reason").isNull(), F.round("__exact", 6).cast("decimal(20,6)")),
        "amount": F.when(F.col("block_reason").isNull(), amount),
        "status": F.when(F.col("block_reason").isNotNull(), "BLOCK").when(F.col("__p").isNull(), "REVIEW").otherwise("PASS"),
    }).drop("__q", "__l", "__w", "__p", "__exact")


def audit_quantity(rows: DataFrame, tolerance: float = 0.01, relative: float = 1e-4, most: int = 100_000) -> DataFrame:
    """M6: checks a reported quantity (``reported``) against width, length and the whole number of pieces that it implies.

    ``implied`` is the whole number nearest to reported / base if it is within the display tolerance or a relative 1e-4
    and from 1 to ``most``; ``finding`` is match, mismatch (another number is stated) or unexplained.
    """
    base = F.expr(f"cast(cast(width_mm as decimal(10,2)) * cast(length_mm as decimal(10,2)) * {MILLIONTH} as decimal(20,6))").cast("double")
    ratio = F.try_divide(F.col("reported"), base)
    whole = F.round(ratio)
    near = (F.abs(F.col("reported") - whole * base) <= F.greatest(F.lit(tolerance), F.abs(F.col("reported")) * relative)) & whole.between(1, most)
    implied = F.when(near, whole.cast("long"))
    finding = F.when(implied.isNull(), "unexplained").when(F.col("quantity").isNull() | (F.col("quantity") == implied), "match").otherwise("mismatch")
    return rows.withColumns({"implied": implied, "finding": finding})


def unique_specs(specs: DataFrame, key: str, fields: list[str], conflict: Column, order: str) -> DataFrame:
    """Per key the first spec (by ``order``) if all its specs agree in ``fields``, nulls being values, and none is in conflict; else null and the number of variants."""
    same = F.count_distinct(F.struct(*fields))
    first = F.min_by(F.struct(order, *fields), order)
    found = specs.groupBy(key).agg(same.alias("variants"), F.bool_or(F.coalesce(conflict, F.lit(False))).alias("conflicted"), first.alias("spec"))
    return found.withColumn("spec", F.when((F.col("variants") == 1) & ~F.col("conflicted"), F.col("spec")))


def match_prices(items: DataFrame, prices: DataFrame, keys: list[str], day: str, thickness: str | None = None, tolerance: float = 0.01) -> DataFrame:
    """The price of each item: equal normalised keys, thickness within ``tolerance``, the day within the price's validity, and exactly one such price.

    Prices have ``price_id``, ``unit_price``, ``approved``, ``valid_from`` and ``valid_to``. An item with none or several has no
    price and the reason no_price or ambiguous; its number of candidates stays visible. Prices that aren't approved don't take part. A null key
    matches nothing. The book is grouped by its keys - an array of the key's versions - and joined once, so items aren't multiplied, grouped or joined
    back; Spark broadcasts the book only if it is small.
    """
    normal = lambda c: F.lower(F.regexp_replace(F.col(c).cast("string"), r"\s+", ""))
    named = {f"__k{i}": normal(k) for i, k in enumerate(keys)}
    low, high = price_date(F.col("valid_from")), price_date(F.col("valid_to"))
    readable = (F.col("valid_from").isNull() | low.isNotNull()) & (F.col("valid_to").isNull() | high.isNotNull())
    version = F.struct("price_id", F.col("unit_price").alias("price"), low.alias("low"), high.alias("high"), *([F.col(thickness).alias("thick")] if thickness else []))
    book = prices.where("approved").where(readable).select(*[c.alias(n) for n, c in named.items()], version.alias("v")).groupBy(*named).agg(F.array_sort(F.collect_list("v")).alias("__book"))
    at = F.col(day)

    def holds(v: Column) -> Column:
        near = F.abs(F.col(thickness) - v["thick"]) <= tolerance if thickness else F.lit(True)
        return F.coalesce(at.isNotNull() & (v["low"].isNull() | (v["low"] <= at)) & (v["high"].isNull() | (at <= v["high"])) & near, F.lit(False))

    out = items.withColumns(named).join(book, list(named), "left").withColumn("__found", F.filter("__book", holds))
    candidates = F.coalesce(F.size("__found"), F.lit(0)).cast("long")
    only = candidates == 1
    columns = {"candidates": candidates, "price_id": F.when(only, F.col("__found")[0]["price_id"]), "unit_price": F.when(only, F.col("__found")[0]["price"]), "reason": F.when(candidates == 0, "no_price").when(~only, "ambiguous")}
    return out.withColumns(columns).drop("__book", "__found", *named)


def conflicts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, conflicts): ``field: a | b`` for each field with several distinct values in the key's rows; nulls are no value."""
    sets = rows.groupBy(key).agg(*[F.array_sort(F.collect_set(F.trim(F.col(f).cast("string")))).alias(f) for f in fields])
    named = [F.when(F.size(f) > 1, F.concat(F.lit(f"{f}: "), F.array_join(f, " | "))) for f in fields]
    return sets.select(key, F.array_compact(F.array(*named)).alias("conflicts")).where(F.size("conflicts") > 0)


def consensus(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value on which all non-null rows of a key agree, after trimming; null if they don't or there is none."""
    v = F.trim(F.col(value))
    return rows.groupBy(*keys).agg(F.when(F.count_distinct(v) == 1, F.max(v)).alias(value), F.count_distinct(v).alias("values"))


def first_issues(issues: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first issue of each key."""
    rest = [c for c in issues.columns if c not in key]
    return issues.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def cross_source_conflicts(specs: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """Keys whose values differ between sources, with the sources: they block."""
    # sets of both, not counts of distinct values, for which Spark would shuffle each row three times over
    found = specs.where(F.col(value).isNotNull()).groupBy(key).agg(F.size(F.collect_set(value)).cast("long").alias("values"), F.array_sort(F.collect_set(source)).alias("s"))
    return found.where("values > 1 and size(s) > 1").select(key, "values", F.array_join("s", "|").alias("sources"), F.lit("BLOCK").alias("status"))


def exclusive_owners(claims: DataFrame, owner: str, evidence: str) -> DataFrame:
    """Each claim with its status: BLOCK for every owner with evidence that another owner claims too, else PASS; confidence 0 where blocked."""
    shared = claims.groupBy(evidence).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a <> b").select(evidence)
    blocked = claims.join(shared, evidence, "left_semi").groupBy(owner).agg(F.count_distinct(evidence).alias("shared_evidence"))
    owners = claims.groupBy(owner).agg(F.count_distinct(evidence).alias("evidence_count"))
    out = owners.join(blocked, owner, "left").withColumn("shared_evidence", F.coalesce("shared_evidence", F.lit(0)))
    return out.withColumn("status", F.when(F.col("shared_evidence") > 0, "BLOCK").otherwise("PASS"))


def stage_gate(items: DataFrame, records: DataFrame, key: str, stage: str, required: list[str]) -> DataFrame:
    """A PASS item without records of all required stages becomes REVIEW, loses its amount, and lists what it lacks."""
    have = records.groupBy(key).agg(F.collect_set(stage).alias("__have"))
    lacking = F.array_except(F.array(*[F.lit(s) for s in required]), F.coalesce("__have", F.array().cast("array<string>")))
    out = items.join(have, key, "left").withColumn("__lack", F.array_sort(lacking)).drop("__have")
    failed = (F.col("status") == "PASS") & (F.size("__lack") > 0)
    return out.withColumns({"amount": F.when(~failed, F.col("amount")), "missing": F.array_join("__lack", ","), "status": F.when(failed, "REVIEW").otherwise(F.col("status"))}).drop("__lack")


def totals(items: DataFrame, *keys: str) -> DataFrame:
    """Items and amounts by status."""
    return items.groupBy(*keys, "status").agg(F.count("*").alias("items"), F.sum("amount").alias("amount"))


