"""Component instances from plans, elevations and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import content_id


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, in any order and number."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def _consensus(column: str) -> Column:
    v = F.trim(F.col(column))
    return F.when(F.count_distinct(v) == 1, F.max(v)).alias(column)


def component_instances(plans: DataFrame, elevations: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a component, led by the groups of the plans; elevation groups that no plan claims follow if a leader backs them.

    plans: plan (group id), mt, sheet, room, name. elevations: id, semantic (group id), mt, sheet, room, name, leader_backed.
    edges: relation (plan_elevation or elevation_detail), source, target. A plan claims the elevations of its material on the sheets that its own is
    related to; they must be of one semantic group, else the component has none and ``groups`` says how many there were. Details are the sheets that
    the claimed elevations' sheets are related to. Room and name are those on which all rows agree. The id hashes material, lead and group.
    """
    to_elevation = edges.where("relation = 'plan_elevation'").select(F.col("source").alias("sheet"), F.col("target").alias("e_sheet")).distinct()
    to_detail = edges.where("relation = 'elevation_detail'").select(F.col("source").alias("e_sheet"), F.col("target").alias("detail")).distinct()
    own = elevations.select("id", "semantic", "mt", F.col("sheet").alias("e_sheet"), F.col("room").alias("e_room"), F.col("name").alias("e_name"), "leader_backed")
    met = plans.join(to_elevation, "sheet").join(own, ["e_sheet", "mt"])
    counts = met.groupBy("plan").agg(F.count_distinct("semantic").alias("groups"), F.min("semantic").alias("one"))
    led = plans.join(counts, "plan", "left").withColumn("semantic", F.when(F.col("groups") == 1, F.col("one"))).select("plan", "mt", "room", "name", "semantic", F.coalesce("groups", F.lit(0)).alias("groups"))
    claimed = led.where("semantic is not null").select("semantic").distinct()
    free = elevations.where("leader_backed").select("semantic", "mt").distinct().join(claimed, "semantic", "left_anti")
    leads = led.select(F.concat(F.lit("p"), "plan").alias("lead"), "mt", "semantic", "groups", "room", "name").unionByName(free.select(F.concat(F.lit("e"), "semantic").alias("lead"), "mt", "semantic", F.lit(1).cast("long").alias("groups"), F.lit(None).cast("string").alias("room"), F.lit(None).cast("string").alias("name")))
    members = leads.select("lead", "mt", "semantic", "groups").join(own.drop("leader_backed"), ["semantic", "mt"], "left")
    traits = members.select("lead", "mt", "semantic", "groups", "id", "e_sheet", F.col("e_room").alias("room"), F.col("e_name").alias("name"))
    traits = traits.unionByName(leads.select("lead", "mt", "semantic", "groups", F.lit(None).cast(elevations.schema["id"].dataType).alias("id"), F.lit(None).cast(elevations.schema["sheet"].dataType).alias("e_sheet"), "room", "name"))
    base = traits.groupBy("lead", "mt", "semantic", "groups").agg(F.count("id").alias("elevations"), F.min("id").alias("first_id"), _consensus("room"), _consensus("name"))
    sheets = members.select("lead", "e_sheet").distinct().join(to_detail, "e_sheet").groupBy("lead").agg(F.array_join(F.array_sort(F.collect_set(F.col("detail").cast("string"))), ",").alias("details"))
    out = base.join(sheets, "lead", "left")
    return out.select(content_id("component", {"mt": F.col("mt"), "lead": F.col("lead"), "group": F.col("semantic")}).alias("component"), "lead", "mt", "semantic", "groups", "elevations", "first_id", "room", "name", F.coalesce("details", F.lit("")).alias("details"))
