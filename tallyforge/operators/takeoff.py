"""Takeoff rows from components: evidence chains, commercial terms, confirmed quantities, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numeric import excel_formula, unit_of
from tallyforge.operators.pricing import calculate_items

#: Units in which rows are billed. Fixed values.
UNITS = ["m", "㎡", "件", "套"]


def commercial_terms(unit: Column, method: Column) -> Column:
    """Unit and pricing method of a row as a reviewer confirmed them, with the reasons against them; a unit that isn't given is that of the method, none is guessed.

    Reasons: invalid_unit, empty_method, missing_method, unit_conflict (the method names another unit), missing_unit.
    """
    own_unit, own_method = F.trim(unit), F.nullif(F.trim(method), F.lit(""))
    valid = F.coalesce(own_unit.isin(*UNITS), F.lit(False))
    inferred = unit_of(own_method)
    invalid, conflict = unit.isNotNull() & ~valid, valid & inferred.isNotNull() & (inferred != own_unit)
    chosen = F.when(valid & ~conflict, own_unit).when(unit.isNull(), inferred)
    reasons = F.array_compact(F.array(
        F.when(invalid, "invalid_unit"), F.when(method.isNotNull() & own_method.isNull(), "empty_method"), F.when(own_method.isNull(), "missing_method"),
        F.when(conflict, "unit_conflict"), F.when(chosen.isNull() & ~invalid, "missing_unit"),
    ))
    return F.struct(chosen.alias("unit"), own_method.alias("method"), reasons.alias("reasons"))


def component_chains(members: DataFrame, details: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component its chain of two edges, plan to elevation and on to a detail: whether it is PASS, and the reasons for REVIEW or BLOCK.

    members: component, role (plan or elevation), sheet; details: component, sheet; edges: edge, relation (plan_to_elevation or elevation_to_detail),
    source, target, status. A chain is coherent if the elevation that the first edge reaches is the one that the second leaves, both ends being the component's. One
    chain of PASS edges is chosen; without one, a sole chain is ``unconfirmed_edge`` and several are ``several_chains``. A component without any is blocked:
    missing_plan_edge, missing_detail_edge or incoherent.
    """
    role = lambda r: members.where(F.col("role") == r).select("component", "sheet").distinct()
    edge = lambda r, n: edges.where(F.col("relation") == r).select(F.col("source").alias("__from"), F.col("target").alias("__to"), F.col("edge").alias(f"edge{n}"), (F.col("status") == "PASS").alias(f"pass{n}"))
    elevations = role("elevation")
    first = role("plan").withColumnRenamed("sheet", "__from").join(edge("plan_to_elevation", 1), "__from").join(elevations.withColumnRenamed("sheet", "__to"), ["component", "__to"])
    second = elevations.withColumnRenamed("sheet", "__from").join(edge("elevation_to_detail", 2), "__from").join(details.select("component", F.col("sheet").alias("__to")).distinct(), ["component", "__to"])
    first = first.select("component", F.col("__to").alias("__mid"), "edge1", "pass1").distinct()
    second = second.select("component", F.col("__from").alias("__mid"), "edge2", "pass2").distinct()
    both = first.join(second, ["component", "__mid"]).withColumn("ok", F.col("pass1") & F.col("pass2"))
    pair = F.struct("edge1", "edge2")
    chains = both.groupBy("component").agg(F.count("*").alias("chains"), F.count_if("ok").alias("passed"), F.min(F.when(F.col("ok"), pair)).alias("good"), F.min(pair).alias("any"))
    has = lambda df, n: df.select("component").distinct().withColumn(n, F.lit(True))
    every = members.select("component").union(details.select("component")).distinct()
    out = every.join(chains, "component", "left").join(has(first, "__first"), "component", "left").join(has(second, "__second"), "component", "left")
    one = F.coalesce(F.col("passed") == 1, F.lit(False))
    chosen = F.when(one, F.col("good")).when(F.col("chains") == 1, F.col("any"))
    review = F.when(~one & (F.col("chains") > 1), "several_chains").when(~one & (F.col("chains") == 1), "unconfirmed_edge")
    missing = [F.when(F.col("__first").isNull(), "missing_plan_edge"), F.when(F.col("__second").isNull(), "missing_detail_edge"), F.when(F.col("__first") & F.col("__second"), "incoherent")]
    block = F.when(F.col("chains").isNull(), F.array_compact(F.array(*missing))).otherwise(F.array().cast("array<string>"))
    return out.select("component", chosen["edge1"].alias("plan_edge"), chosen["edge2"].alias("detail_edge"), one.alias("chain_pass"), F.array_compact(F.array(review)).alias("review"), block.alias("block"))


def confirmed_quantities(confirmations: DataFrame, entities: DataFrame, chain_sheets: DataFrame) -> DataFrame:
    """Reasons against a reviewer's own quantity expression, per component; none if it holds.

    confirmations: component, expression, basis, evidence (array of entity ids); entities: entity, sheet; chain_sheets: component, sheet. Reasons: expression
    (missing or not safe arithmetic over the sizes), basis, evidence (none given), unknown_entity and outside_chain, with their ids.
    """
    good = F.col("expression").isNotNull() & excel_formula("expression").isNotNull()
    basis = F.coalesce(F.trim("basis") != "", F.lit(False))
    some = F.coalesce(F.size("evidence") > 0, F.lit(False))
    own = confirmations.select("component", F.array_compact(F.array(F.when(~good, "expression"), F.when(~basis, "basis"), F.when(~some, "evidence"))).alias("own"))
    ids = confirmations.select("component", F.explode(F.array_distinct("evidence")).alias("entity"))
    placed = ids.join(entities.select("entity", "sheet", F.lit(True).alias("__known")), "entity", "left").join(chain_sheets.select("component", "sheet").distinct().withColumn("__in", F.lit(True)), ["component", "sheet"], "left")
    bad = F.when(F.col("__known").isNull(), F.concat(F.lit("unknown_entity:"), "entity")).when(F.col("__in").isNull(), F.concat(F.lit("outside_chain:"), "entity"))
    found = placed.groupBy("component").agg(F.array_sort(F.collect_set(bad)).alias("bad"))
    return own.join(found, "component", "left").select("component", F.concat("own", F.coalesce("bad", F.array().cast("array<string>"))).alias("reasons"))


def takeoff_rows(items: DataFrame, chains: DataFrame, quantities: DataFrame) -> DataFrame:
    """A row for each item (component, confirmed_unit, confirmed_method, sizes, unit_price): quantity and amount, status and all reasons.

    BLOCK if terms, chain, a confirmed quantity or an input is against it; REVIEW if the chain isn't PASS or there is no price; only PASS rows have an amount. A
    component without a chain row is blocked as ``missing_chain``.
    """
    terms = items.withColumn("__t", commercial_terms(F.col("confirmed_unit"), F.col("confirmed_method"))).withColumn("unit", F.col("__t.unit"))
    done = calculate_items(terms).join(chains, "component", "left").join(quantities.withColumnRenamed("reasons", "__q"), "component", "left")
    none = F.array().cast("array<string>")
    missing = F.when(F.col("chain_pass").isNull(), F.array(F.lit("missing_chain"))).otherwise(none)
    block = F.concat("__t.reasons", F.coalesce("block", none), missing, F.coalesce("__q", none), F.array_compact(F.array(F.when(F.col("block_reason") != "unit", F.concat(F.lit("missing_"), "block_reason")))))
    review = F.concat(F.coalesce("review", none), F.array_compact(F.array(F.when(F.col("unit_price").isNull(), "no_price"))))
    out = done.withColumns({"__b": F.array_compact(block), "__r": review})
    status = F.when(F.size("__b") > 0, "BLOCK").when(F.size("__r") > 0, "REVIEW").otherwise("PASS")
    return out.select(
        "component", "unit", "plan_edge", "detail_edge", status.alias("status"), F.array_join(F.concat("__b", "__r"), ",").alias("reasons"),
        "engineering_quantity", F.when(status == "PASS", F.col("amount")).alias("amount"),
    )
