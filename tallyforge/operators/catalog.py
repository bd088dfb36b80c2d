"""The drawing catalogue, sheet classification and relation ranking."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stages of drawing kinds (P1). Fixed values.
STAGES = {"plan": "plan", "elevation_index": "plan", "elevation": "elevation", "detail": "detail", "door": "detail", "ceiling": "detail", "floor": "detail"}
#: Weights of the sources of a classification (P2). Fixed values.
SOURCE_WEIGHTS = {"file": 1.0, "primary": 1.5, "title": 1.0, "layout": 0.55}


def stage_of(kind: Column) -> Column:
    """The stage of a drawing's kind, null for others."""
    return F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[kind]


def term_index(entities: DataFrame, sheet: str, text: str, entity: str) -> DataFrame:
    """The inverted index: (term, sheet, entities): each lower-case alphanumeric term of a sheet and how many entities have it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    return entities.select(sheet, entity, F.explode(words).alias("term")).groupBy("term", sheet).agg(F.count("*").alias("entities"), F.min(entity).alias("first_entity"))


def sheet_counts(entities: DataFrame, sheet: str, kind: str, text: str) -> DataFrame:
    """G1: entities, entities with text, and characters of each sheet and kind."""
    return entities.groupBy(sheet, kind).agg(F.count("*").alias("entities"), F.count_if(F.length(F.trim(text)) > 0).alias("texts"), F.sum(F.length(text)).cast("long").alias("characters"))


def search(index: DataFrame, query: str, sheet: str, limit: int = 50) -> DataFrame:
    """F1: sheets with a term equal to the query (score 1) or holding it (.8): best score, terms and entities, the ``limit`` best by (score, sheet)."""
    q = query.lower().strip()
    hits = index.where(F.col("term").contains(q)).withColumn("score", F.when(F.col("term") == q, 1.0).otherwise(0.8))
    found = hits.groupBy(sheet).agg(F.max("score").alias("score"), F.count("*").alias("terms"), F.sum("entities").alias("entities"))
    return found.orderBy(F.desc("score"), sheet).limit(limit)


def classify(sheets: DataFrame, rules: list[tuple[str, str, str, float]], texts: dict[str, str]) -> DataFrame:
    """Kind and confidence of each sheet from weighted patterns.

    ``rules`` are (kind, label, pattern, weight); ``texts`` names a column for each source of SOURCE_WEIGHTS. A label counts once a source.
    The best kind is unknown below 3 points, or with under 1 point of lead over a second of 3 or more.
    """
    kinds = sorted({k for k, *_ in rules})
    scores = []
    for kind in kinds:
        points = F.lit(0.0)
        for source, column in texts.items():
            by_label: dict[str, list[tuple[str, float]]] = {}
            for k, label, pattern, weight in rules:
                if k == kind:
                    by_label.setdefault(label, []).append((pattern, weight))
            for patterns in by_label.values():
                best = F.greatest(*[F.when(F.lower(column).rlike(p), w).otherwise(0.0) for p, w in patterns], F.lit(0.0))
                points = points + F.coalesce(best, F.lit(0.0)) * SOURCE_WEIGHTS[source]
        scores.append(F.struct((-points).alias("s"), F.lit(kind).alias("kind")))
    ranked = sheets.withColumn("__r", F.array_sort(F.array(*scores)))
    top, second = -F.col("__r")[0]["s"], -F.col("__r")[1]["s"]
    unknown = (top < 3) | ((second >= 3) & (top - second < 1))
    sure = F.least(F.lit(0.96), 0.48 + 0.3 * (1 - F.exp(-top / 5)) + F.least(F.lit(0.16), (top - second) / 25))
    return ranked.withColumns({"kind": F.when(unknown, "unknown").otherwise(F.col("__r")[0]["kind"]), "confidence": F.round(F.when(unknown, F.least(sure, F.lit(0.45))).otherwise(sure), 3)}).drop("__r")


def with_fallback(panels: DataFrame, originals: DataFrame, represented: DataFrame, key: str) -> DataFrame:
    """The panels, and every original that no panel represents."""
    return panels.unionByName(originals.join(represented.select(key).distinct(), key, "left_anti"))


def split_panels(anchors: DataFrame, panel: str, position: str, low: str, high: str) -> DataFrame:
    """P5: the parts of a panel between the midpoints of neighbouring anchors, from its own ``low`` to its ``high`` side."""
    order = Window.partitionBy(panel).orderBy(position)
    before, after = F.lag(position).over(order), F.lead(position).over(order)
    here = F.col(position)
    return anchors.select(panel, position, F.coalesce((before + here) / 2, F.col(low)).alias("part_low"), F.coalesce((here + after) / 2, F.col(high)).alias("part_high"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching share of two texts (twice the matched characters over all); each distinct pair is compared once a batch."""
    known = {p: SequenceMatcher(None, *p).ratio() for p in set(zip(a, b)) if None not in p}
    return pd.Series([known.get(p) for p in zip(a, b)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, the share of lengths if one holds the other, else the matching ratio; 0 if either is missing or empty."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    some = F.coalesce((F.length(a) > 0) & (F.length(b) > 0), F.lit(False))
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(~some, 0.0).when(a == b, 1.0).when(inside, low / high).otherwise(_ratio(F.when(some & ~inside, a), F.when(some & ~inside, b)))


def relation_candidates(left: DataFrame, right: DataFrame, references: DataFrame) -> DataFrame:
    """The pairs (sheet, other, explicit, by_number) that can score above the prior: of one project they share a material, a room, or two neighbouring characters of
    titles or room names; or one refers to the other.

    Keys that are shared are joined once each, after ``distinct``; a project is one set of drawings.
    """
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.concat(F.lit("~"), F.substring(c, i, F.lit(2))))
    empty = F.array().cast("array<string>")
    tag = lambda t, c: F.transform(F.coalesce(c, empty), lambda x: F.concat(F.lit(t), x))
    keys = F.array_distinct(F.concat(tag("m:", F.col("materials").cast("array<string>")), tag("r:", F.col("rooms")), F.coalesce(pairs(F.col("title")), empty), F.flatten(F.transform(F.coalesce("rooms", empty), pairs))))
    of = lambda df, n: df.select("project", F.col("sheet").alias(n), F.explode(keys).alias("key"))
    met = of(left, "sheet").join(of(right, "other"), ["project", "key"]).where("sheet <> other").select("sheet", "other", F.lit(False).alias("explicit"), F.lit(False).alias("by_number"))
    own = references.where("sheet <> other").select("sheet", "other", F.lit(True).alias("explicit"), "by_number")
    return met.unionByName(own).groupBy("sheet", "other").agg(F.bool_or("explicit").alias("explicit"), F.bool_or("by_number").alias("by_number"))


def rank_relations(left: DataFrame, right: DataFrame, references: DataFrame, confirmed: DataFrame, top_k: int = 5, least: float = 0.05) -> DataFrame:
    """Scored relations of sheets, the weak ones cut to the ``top_k`` of each left sheet; those by drawing number, confirmed or sole explicit ones all kept.

    Sheets have project, sheet, title, floor, rooms and materials (arrays); references (sheet, other, by_number) and confirmed (sheet, other) are pairs.
    Score: .02; 1 if confirmed, else .72 for a reference; .10 and up to .08 more for shared materials (Jaccard); .15 for a shared room, else up
    to .08 for rooms that are .65 alike; up to .10 for titles that are .25 alike. Different floors veto a pair unless it is confirmed or referred to by its
    drawing number. Confirmed pairs are PASS, and a sheet's sole reference if it has no confirmed pair; others are REVIEW.
    """
    names = ["title", "floor", "rooms", "materials"]
    a = left.select("sheet", *[F.col(c).alias(f"a_{c}") for c in names])
    b = right.select(F.col("sheet").alias("other"), *[F.col(c).alias(f"b_{c}") for c in names])
    sure = confirmed.where("sheet <> other").select("sheet", "other").distinct().withColumn("confirmed", F.lit(True))
    pairs = relation_candidates(left, right, references).join(sure, ["sheet", "other"], "full_outer")
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("explicit", "by_number", "confirmed")}).join(a, "sheet").join(b, "other")
    pairs = pairs.where("confirmed or by_number or a_floor is null or b_floor is null or a_floor = b_floor")
    rooms = pairs.where(~F.coalesce(F.arrays_overlap("a_rooms", "b_rooms"), F.lit(False))).select("sheet", "other", F.explode("a_rooms").alias("x"), "b_rooms").select("sheet", "other", "x", F.explode("b_rooms").alias("y"))
    likest = rooms.withColumn("likeness", text_similarity(F.col("x"), F.col("y"))).groupBy("sheet", "other").agg(F.max("likeness").alias("room_likeness"))
    both = F.size(F.array_intersect("a_materials", "b_materials"))
    shared = F.when(both > 0, 0.10 + 0.08 * both / F.size(F.array_union("a_materials", "b_materials"))).otherwise(0.0)
    room = F.when(F.arrays_overlap("a_rooms", "b_rooms"), 0.15).when(F.col("room_likeness") >= 0.65, 0.08 * F.col("room_likeness")).otherwise(0.0)
    scored = pairs.join(likest, ["sheet", "other"], "left").withColumn("title_likeness", text_similarity(F.col("a_title"), F.col("b_title")))
    base = F.when(F.col("confirmed"), 1.0).when(F.col("explicit"), 0.74).otherwise(0.02)
    title = F.when(F.col("title_likeness") >= 0.25, 0.10 * F.col("title_likeness")).otherwise(0.0)
    kept = scored.withColumn("score", F.round(F.least(base + shared + room + title, F.lit(1.0)), 6)).where(F.col("score") >= least)
    sole = kept.groupBy("sheet").agg(F.count_if("explicit").alias("n"), F.bool_or("confirmed").alias("done"))
    judged = kept.join(sole, "sheet").withColumn("passed", F.col("confirmed") | (F.col("explicit") & (F.col("n") == 1) & ~F.col("done")))
    order = Window.partitionBy("sheet", "firm").orderBy(F.desc("score"), "other")
    ranked = judged.withColumn("firm", F.col("passed") | F.col("by_number")).withColumn("rank", F.row_number().over(order)).where(F.col("firm") | (F.col("rank") <= top_k))
    return ranked.select("sheet", "other", "score", "explicit", F.when(F.col("passed"), "PASS").otherwise("REVIEW").alias("status"))


def reciprocal_links(callouts: DataFrame, pages: DataFrame) -> DataFrame:
    """Each callout (callout, page, target, view) with the pages of its target code that refer back to its page.

    Pages have page, code and back (code of the page that they refer to). State: reciprocal, one_way (the target exists), ambiguous (several refer back) or missing.
    """
    targets = pages.groupBy("code").agg(F.count("*").alias("targets")).withColumnRenamed("code", "target")
    back = pages.groupBy("code", "back").agg(F.count("*").alias("backs"), F.min("page").alias("target_page")).withColumnsRenamed({"code": "target", "back": "page"})
    out = callouts.join(targets, "target", "left").join(back, ["target", "page"], "left")
    state = F.when(F.col("targets").isNull(), "missing").when(F.col("backs").isNull(), "one_way").when(F.col("backs") > 1, "ambiguous").otherwise("reciprocal")
    return out.select(*callouts.columns, state.alias("state"), F.when(state == "reciprocal", F.col("target_page")).alias("target_page"))


def phrase_codes(mentions: DataFrame, phrases: DataFrame) -> DataFrame:
    """Each mention (mention, text) with the code of the phrases (phrase, code) that its text has as whole words: one code gives REVIEW, several BLOCK, none null.

    Mentions' runs of words, of each number of words that a phrase has, are looked up among the phrases: words end at single spaces, case doesn't matter. A run meets one row, however many phrases begin alike.
    """
    words = lambda c: F.split(F.lower(c), " ")
    known = phrases.groupBy(F.lower("phrase").alias("__run")).agg(F.min("code").alias("low"), F.max("code").alias("high"))
    lengths = [r[0] for r in phrases.select(F.size(words("phrase"))).where(F.col("phrase").isNotNull()).distinct().collect()]  # numbers of words, of which there are few
    runs = mentions.select("mention", words("text").alias("__w"), F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>")).alias("__n")).where(F.size("__w") >= F.col("__n"))
    runs = runs.select("mention", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__w") - F.col("__n") + 1), lambda i: F.array_join(F.slice("__w", i, F.col("__n")), " ")))).alias("__run"))
    found = runs.join(known.hint("merge"), "__run").groupBy("mention").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out = mentions.join(found.hint("merge"), "mention", "left")  # Spark takes exploded rows for few and would broadcast them
    return out.select("mention", F.when(F.col("low") == F.col("high"), F.col("low")).alias("code"), F.when(F.col("low") == F.col("high"), "REVIEW").when(F.col("low") < F.col("high"), "BLOCK").alias("status"))


def reuse_audit(records: DataFrame, identity: Column, name: str, stage: str) -> DataFrame:
    """Images or texts used under several names (BLOCK) or stages (REVIEW), by identity; others PASS and aren't listed."""
    groups = records.groupBy(identity.alias("identity")).agg(F.count("*").alias("uses"), F.count_distinct(F.lower(F.trim(name))).alias("names"), F.count_distinct(stage).alias("stages"))
    return groups.where("names > 1 or stages > 1").withColumn("status", F.when(F.col("names") > 1, "BLOCK").otherwise("REVIEW"))
