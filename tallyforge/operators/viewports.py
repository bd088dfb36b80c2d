"""Chains of broken views and closed outlines of drawings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.evidence import selected_profiles, strip_profile
from tallyforge.operators.graphs import connected_components
from tallyforge.operators.sequential import unique_assignment
from tallyforge.operators.spatial import containing_boxes
from tallyforge.plans.checkpoints import cut

#: Gap between two parts of a view, in heights of their shared edge, at most. Fixed value of the rules.
GAP_RATIO = 0.06
#: Places count as equal within this part of an edge, and within LEAST units at least. Fixed values of the rules.
PART, LEAST = 1e-7, 1e-6
#: Segments or views of a scope whose faces or chains one task finds at once, and of a group of such scopes.
WHOLE, GROUP = 50_000, 100_000
#: A view's box on paper and in the model.
BOXES = ("x0", "y0", "x1", "y1", "mx0", "my0", "mx1", "my1")
#: Places from here on are left to the graph, and pairs of views that a task compares at once.
FAR, PAIRS = 1e12, 1_000_000
#: Odd factors of a cell's hash. Fixed values.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def fragment_edges(views: DataFrame, scope: str, gap_ratio: float = GAP_RATIO) -> DataFrame:
    """Pairs of views (scope, first, second, axis, gap, gap_ratio, model_gap) that are neighbouring parts of one broken view.

    ``views`` has view_id, scale, a box on paper (x0, y0, x1, y1) and one in the model (mx0, my0, mx1, my1). Two are neighbours along an axis if their edges across it are
    level on paper and in the model, the gap between them is at most ``gap_ratio`` of the edge, their scales are equal, and their model windows follow
    each other with a gap. A box that is empty or has a null has no neighbours. Views meet in cells of edge size, level and place, so the work follows
    the neighbours, not the pairs of a sheet.
    """
    sound = F.lit(True)
    for low, high in (("x0", "x1"), ("y0", "y1"), ("mx0", "mx1"), ("my0", "my1")):
        sound &= F.col(low) < F.col(high)
    own = views.select(scope, "view_id", "scale", *BOXES).where(sound & (F.col("scale") > 0))
    found = None
    for axis, (a, c) in (("x", ("x", "y")), ("y", ("y", "x"))):
        edge = F.col(f"{c}1") - F.col(f"{c}0")
        named = {"lo": f"{a}0", "hi": f"{a}1", "c0": f"{c}0", "c1": f"{c}1", "mlo": f"m{a}0", "mhi": f"m{a}1", "mc0": f"m{c}0", "mc1": f"m{c}1"}
        flat = own.select(scope, "view_id", "scale", edge.alias("edge"), *[F.col(v).alias(k) for k, v in named.items()])
        slack = F.greatest(F.lit(LEAST), F.col("edge") * PART) * 1.01
        # edges of one size class, lines of one level and ends of one stretch share a cell; those near a border stand in both
        size = lambda x: F.floor(F.log2(x)).cast("long")
        unit = F.pow(F.lit(2.0), F.col("size"))
        flat = flat.withColumn("size", F.explode(F.array_distinct(F.array(size(F.col("edge") - slack * 2), size(F.col("edge") + slack * 2)))))
        stretch = lambda x: F.floor(x / (unit * (2.02 * gap_ratio))).cast("long")
        flat = flat.withColumn("level", F.explode(F.array_distinct(F.array(F.floor((F.col("c0") - slack) / unit).cast("long"), F.floor((F.col("c0") + slack) / unit).cast("long")))))
        first = flat.withColumn("cell", F.explode(F.array(stretch(F.col("hi")), stretch(F.col("hi")) + 1)))
        second = flat.withColumn("cell", stretch(F.col("lo")))
        p, q = first.alias("p"), second.alias("q")
        met = p.join(q.hint("merge"), [scope, "size", "level", "cell"]).where(F.col("p.view_id") != F.col("q.view_id"))
        across = F.least("p.edge", "q.edge")
        near = F.greatest(F.lit(LEAST), across * PART)
        gap, model_gap = F.col("q.lo") - F.col("p.hi"), F.col("q.mlo") - F.col("p.mhi")
        level = lambda k, e: F.abs(F.col(f"p.{k}") - F.col(f"q.{k}")) <= e
        good = (gap > near) & (gap <= gap_ratio * across) & level("c0", near) & level("c1", near) & (F.abs(F.col("p.scale") - F.col("q.scale")) <= 1e-7 * F.greatest("p.scale", "q.scale"))
        good &= level("mc0", near / F.col("p.scale")) & level("mc1", near / F.col("p.scale")) & (model_gap > near / F.col("p.scale"))
        rows = met.where(good).select(scope, F.col("p.view_id").alias("first"), F.col("q.view_id").alias("second"), F.lit(axis).alias("axis"), gap.alias("gap"), (gap / across).alias("gap_ratio"), model_gap.alias("model_gap"))
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def view_chains(views: DataFrame, scope: str, gap_ratio: float = GAP_RATIO, whole: int = WHOLE) -> DataFrame:
    """(scope, view_id, chain, parts, x0, y0, x1, y1): each view's chain of neighbouring parts, named by its least view, with the box around all of them; a view without neighbours is a chain of its own.

    Scopes of up to ``whole`` views are dealt out whole, many to a task, which finds the neighbours in the same cells as ``fragment_edges``; in larger ones, and in those with views without an id or places
    beyond FAR or NaN, the chains are components of a graph.
    """
    views = views.select(scope, "view_id", "scale", *BOXES).where(F.col(scope).isNotNull())
    odd = F.col("view_id").isNull()
    for c in ("scale", *BOXES):
        odd |= F.coalesce(~(F.abs(F.col(c).cast("double")) < FAR), F.lit(False))
    sizes = cut(views.groupBy(scope).agg(F.count("*").alias("n"), F.bool_or(odd).alias("odd")))
    by_graph = (F.col("n") > whole) | F.col("odd")
    large = sizes.where(by_graph).select(scope)
    total = sizes.where(~by_graph).agg(F.sum("n")).first()[0] or 0
    some = not large.isEmpty()
    small = views.join(large.hint("merge"), scope, "left_anti") if some else views
    kind = {f.name: f.dataType.simpleString() for f in views.schema.fields}
    schema = f"{scope} {kind[scope]}, view_id {kind['view_id']}, chain {kind['view_id']}, parts long, " + ", ".join(f"{c} {kind[c]}" for c in BOXES[:4])
    groups = max(1, -(-total // GROUP))
    out = small.groupBy(F.pmod(F.xxhash64(scope), F.lit(groups)).alias("__group")).applyInPandas(lambda rows: _chains_of(rows, scope, gap_ratio), schema)
    return out.unionByName(_chains_by_graph(views.join(large.hint("merge"), scope, "left_semi"), scope, gap_ratio)) if some else out


def _chains_of(rows: pd.DataFrame, scope: str, gap_ratio: float) -> pd.DataFrame:
    """The chains of whole scopes."""
    node = rows.groupby([scope, "view_id"], sort=False).ngroup().to_numpy()
    root = np.arange(node.max() + 1)
    pairs = [(node[p], node[q]) for axis in "xy" for p, q in _neighbours(rows, scope, axis, gap_ratio)]
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, int) for k in (0, 1))
    while (root[a] != root[b]).any():
        one, two = root[a], root[b]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
    chains = rows.groupby(root[node], sort=False)
    return pd.DataFrame({scope: rows[scope], "view_id": rows["view_id"], "chain": chains["view_id"].transform("min"), "parts": np.bincount(root)[root[node]],
                         **{c: chains[c].transform(f) for c, f in zip(BOXES, ("min", "min", "max", "max"))}})


def _neighbours(rows: pd.DataFrame, scope: str, axis: str, gap_ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of neighbours along an axis, as ``fragment_edges`` finds them, in blocks of about PAIRS pairs that share a cell. Equal hashes of different cells only add pairs to compare."""
    a, c = (axis, "y" if axis == "x" else "x")
    v = {k: rows[k].to_numpy(float) for k in ("scale", *BOXES)}
    sound = (v["scale"] > 0) & (v["x0"] < v["x1"]) & (v["y0"] < v["y1"]) & (v["mx0"] < v["mx1"]) & (v["my0"] < v["my1"])
    at = np.flatnonzero(sound)
    sheet, scale = pd.factorize(rows[scope])[0][at], v["scale"][at]
    lo, hi, c0, c1, mlo, mhi, mc0, mc1 = (v[k][at] for k in (f"{a}0", f"{a}1", f"{c}0", f"{c}1", f"m{a}0", f"m{a}1", f"m{c}0", f"m{c}1"))
    edge = c1 - c0
    slack = np.maximum(LEAST, edge * PART) * 1.01
    one, two = [], []
    with np.errstate(all="ignore"):
        sizes = [np.floor(np.log2(edge + s * slack * 2)) for s in (-1, 1)]
        for n, size in enumerate(sizes):
            unit = 2.0**size
            levels = [np.floor((c0 + s * slack) / unit) for s in (-1, 1)]
            for k, level in enumerate(levels):
                own = np.flatnonzero(np.isfinite(size) & ((size != sizes[0]) if n else True) & ((level != levels[0]) if k else True))
                for ends, step, to in ((hi, 0, one), (hi, 1, one), (lo, 0, two)):
                    cell = np.floor(ends[own] / (unit[own] * (2.02 * gap_ratio))) + step
                    key = sum(x.astype(np.int64).astype(np.uint64) * np.uint64(m) for x, m in zip((sheet[own], size[own], level[own], cell), _MIX))
                    to.append((key, own))
    (p_key, p), (q_key, q) = (tuple(np.concatenate(x) for x in zip(*s)) for s in (one, two))
    order = np.argsort(q_key)
    q_key, q = q_key[order], q[order]
    first = np.searchsorted(q_key, p_key, "left")
    count = np.searchsorted(q_key, p_key, "right") - first
    ends, start = np.cumsum(count), 0
    while start < len(p):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = count[start:stop]
        i = np.repeat(p[start:stop], n)
        j = q[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[start:stop], n)]
        across, larger = np.minimum(edge[i], edge[j]), np.maximum(scale[i], scale[j])
        near = np.maximum(LEAST, across * PART)
        gap, model_gap, model_near = lo[j] - hi[i], mlo[j] - mhi[i], near / scale[i]
        good = (sheet[i] == sheet[j]) & (gap > near) & (gap <= gap_ratio * across) & (np.abs(c0[i] - c0[j]) <= near) & (np.abs(c1[i] - c1[j]) <= near) & (np.abs(scale[i] - scale[j]) <= 1e-7 * larger)
        good &= (np.abs(mc0[i] - mc0[j]) <= model_near) & (np.abs(mc1[i] - mc1[j]) <= model_near) & (model_gap > model_near)
        yield at[i[good]], at[j[good]]
        start = stop


def _chains_by_graph(views: DataFrame, scope: str, gap_ratio: float) -> DataFrame:
    """The same by components of a graph, for scopes of any size."""
    edges = fragment_edges(views, scope, gap_ratio)
    node = lambda c: F.xxhash64(F.lit("view"), scope, c)
    roots = connected_components(edges.select(node("first").alias("a"), node("second").alias("b")))
    rooted = views.withColumn("__n", node("view_id")).join(roots.withColumnRenamed("node", "__n").hint("merge"), "__n", "left").withColumn("__r", F.coalesce("root", "__n"))
    chains = rooted.groupBy(scope, "__r").agg(F.min("view_id").alias("chain"), F.count_distinct("view_id").alias("parts"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    return rooted.select(scope, "view_id", "__r").join(chains.hint("merge"), [scope, "__r"]).select(scope, "view_id", "chain", "parts", "x0", "y0", "x1", "y1")


def chain_titles(chains: DataFrame, titles: DataFrame, scope: str, cell: float = 1000.0) -> DataFrame:
    """(scope, chain, title_id, place): the titles that stand ``below`` a chain's box, or at its ``bottom_right``, with all their points.

    ``titles`` has title_id and points (array<struct<x,y>>). A title without points stands nowhere. The first point finds the boxes, in grid cells.
    """
    boxes = chains.select(scope, "chain", "x0", "y0", "x1", "y1").distinct()
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pad = 0.05 * F.least(w, h)
    below = {"x0": F.col("x0") - pad, "y0": F.col("y0") - F.greatest(h, 0.6 * w), "x1": F.col("x1") + pad, "y1": F.col("y0")}
    right = {"x0": F.col("x1"), "y0": F.col("y0") - 0.15 * h, "x1": F.col("x1") + 0.65 * w, "y1": F.col("y0") + 0.2 * h}
    fields = lambda at: F.struct(*[v.alias(k) for k, v in at.items()])
    wide = {"x0": below["x0"], "y0": F.least(below["y0"], right["y0"]), "x1": F.greatest(below["x1"], right["x1"]), "y1": right["y1"]}
    areas = boxes.select(scope, "chain", fields(below).alias("below"), fields(right).alias("right"), *[v.alias(k) for k, v in wide.items()])
    firsts = titles.where(F.size("points") > 0).select(scope, "title_id", "points", F.get("points", 0)["x"].alias("x"), F.get("points", 0)["y"].alias("y"))
    hits = containing_boxes(firsts, areas, [scope], cell, "chain").select(scope, "title_id", "chain").distinct()
    whole = hits.join(firsts.select(scope, "title_id", "points"), [scope, "title_id"]).join(areas.select(scope, "chain", "below", "right"), [scope, "chain"])
    inside = lambda box, after: F.forall("points", lambda q: ((q["x"] > box["x0"]) if after else (q["x"] >= box["x0"])) & (q["x"] <= box["x1"]) & (q["y"] >= box["y0"]) & (q["y"] <= box["y1"]))
    place = F.when(inside(F.col("below"), False), "below").when(inside(F.col("right"), True), "bottom_right")
    return whole.select(scope, "chain", "title_id", place.alias("place")).where("place is not null")


def titled_chains(views: DataFrame, titles: DataFrame, scope: str, gap_ratio: float = GAP_RATIO, cell: float = 1000.0) -> DataFrame:
    """Chains and titles that hang together, with their one complete assignment if there is just one (see ``unique_assignment``); no title is taken for being the nearest."""
    return unique_assignment(chain_titles(view_chains(views, scope, gap_ratio), titles, scope, cell), scope, "chain", "title_id")


def outline_faces(segments: DataFrame, scope: str, step: float = 1e-4, whole: int = WHOLE) -> DataFrame:
    """V2: each side of each segment (scope, segment_id, forward) with its face, its twin's face (``other``), its turn's ends (ax, ay, bx, by) and its ``twin`` and ``after`` sides.

    Segments (segment_id, x0, y0, x1, y1) meet at their ends only; ends within ``step`` of a grid point are that point. Every segment is two opposite sides; the side after
    one is the next clockwise at its end. The sides that follow each other are a face, named by its least side. Scopes of up to ``whole`` segments are dealt out whole, many to a task; in larger ones the faces are components of a graph. Segments without
    length, repeated ones and those with nulls are left out. In a larger scope a point's sides are sorted by one task; hubs of millions of segments don't occur in one drawing.
    Sides come from exploded segments, which Spark takes for as small as their table: the joins are merge joins by hint, none is broadcast. The faces are stored once.
    """
    at = lambda c: F.round(F.col(c) / step).cast("long")
    start, end = F.struct("ax", "ay"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"))
    flat = segments.select(scope, "segment_id", at("x0").alias("ax"), at("y0").alias("ay"), at("x1").alias("bx"), at("y1").alias("by")).na.drop()
    flat = flat.where("ax <> bx or ay <> by").withColumns({"__l": F.least(start, end), "__h": F.greatest(start, end)})
    flat = flat.groupBy(scope, F.col("__l.ax").alias("ax"), F.col("__l.ay").alias("ay"), F.col("__h.ax").alias("bx"), F.col("__h.ay").alias("by")).agg(F.min("segment_id").alias("segment_id"))
    side = lambda a, b: F.xxhash64(F.lit("side"), scope, *a, *b)
    one, two = ("ax", "ay"), ("bx", "by")
    flat = flat.withColumns({"side": side(one, two), "twin": side(two, one)})
    sizes = cut(flat.groupBy(scope).agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > whole).select(scope)
    total = sizes.where(F.col("n") <= whole).agg(F.sum("n")).first()[0] or 0
    kind = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    schema = f"{scope} {kind[scope]}, segment_id {kind['segment_id']}, forward boolean, side long, twin long, after long, face long, other long, ax double, ay double, bx double, by double"
    small = flat if large.isEmpty() else flat.join(large.hint("merge"), scope, "left_anti")
    groups = max(1, -(-total // GROUP))
    out = small.groupBy(F.pmod(F.xxhash64(scope), F.lit(groups)).alias("__group")).applyInPandas(lambda rows: _faces_of(rows, scope, step), schema)
    if small is not flat:
        out = out.unionByName(_faces_by_graph(flat.join(large.hint("merge"), scope, "left_semi"), scope, step))
    return cut(out)


def _faces_of(flat: pd.DataFrame, scope: str, step: float) -> pd.DataFrame:
    """The sides and faces of whole scopes: sides sorted around their points, and the least side of each turn by doubled steps along it."""
    n = len(flat)
    sheet = np.tile(pd.factorize(flat[scope])[0], 2)
    a, b = flat[["ax", "ay"]].to_numpy(), flat[["bx", "by"]].to_numpy()
    start, end = np.concatenate([a, b]), np.concatenate([b, a])
    names = np.concatenate([flat["side"].to_numpy(), flat["twin"].to_numpy()])
    way = (end - start).astype(float)
    order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), start[:, 1], start[:, 0], sheet))
    places = np.column_stack([sheet[order], start[order]])
    first = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1)])
    last = np.r_[first[1:], 2 * n] - 1
    before = np.arange(2 * n) - 1
    before[first] = last
    clockwise = np.empty(2 * n, int)
    clockwise[order] = order[before]
    twin = np.r_[np.arange(n) + n, np.arange(n)]
    after = clockwise[twin]
    face, ahead = names.copy(), after
    for _ in range(int(2 * n).bit_length()):
        face, ahead = np.minimum(face, face[ahead]), ahead[ahead]
    twice = lambda c: np.tile(flat[c].to_numpy(), 2)
    return pd.DataFrame({scope: twice(scope), "segment_id": twice("segment_id"), "forward": np.arange(2 * n) < n, "side": names, "twin": names[twin], "after": names[after], "face": face, "other": face[twin],
                         "ax": start[:, 0] * step, "ay": start[:, 1] * step, "bx": end[:, 0] * step, "by": end[:, 1] * step})


def _faces_by_graph(flat: DataFrame, scope: str, step: float) -> DataFrame:
    """The same by a window around each point and components of a graph, for scopes of any size."""
    back = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay", "side": "twin", "twin": "side"}
    both = flat.withColumn("forward", F.lit(True)).unionByName(flat.select(scope, "segment_id", *[F.col(c).alias(n) for n, c in back.items()], F.lit(False).alias("forward")))
    both = both.withColumn("angle", F.atan2((F.col("by") - F.col("ay")).cast("double"), (F.col("bx") - F.col("ax")).cast("double")))
    around = Window.partitionBy(scope, "ax", "ay").orderBy("angle")
    ends = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumn("clockwise", F.coalesce(F.lag("side").over(around), F.last("side").over(ends)))
    after = both.select(F.col("side").alias("twin"), F.col("clockwise").alias("after"))
    turned = cut(both.drop("clockwise", "angle").join(after.hint("merge"), "twin"))
    roots = cut(connected_components(turned.select(F.col("side").alias("a"), F.col("after").alias("b"))))
    faces = turned.join(roots.select(F.col("node").alias("side"), F.col("root").alias("face")).hint("merge"), "side")
    faces = faces.join(roots.select(F.col("node").alias("twin"), F.col("root").alias("other")).hint("merge"), "twin")
    scaled = lambda c: (F.col(c) * F.lit(step)).alias(c)
    return faces.select(scope, "segment_id", "forward", "side", "twin", "after", "face", "other", *[scaled(c) for c in ("ax", "ay", "bx", "by")])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def ring(sides: pd.Series) -> pd.Series:
    """The corners of a face in order, from its sides (side, after, ax, ay)."""

    def walk(raw) -> list[dict]:
        by, out = {s["side"]: s for s in raw}, []
        at = min(by, default=None)
        while at in by:
            s = by.pop(at)
            out.append({"x": s["ax"], "y": s["ay"]})
            at = s["after"]
        return out

    return sides.map(walk)


def closed_outlines(faces: DataFrame, scope: str, most: int = 256) -> DataFrame:
    """V2: the closed outlines (scope, face, sides, area, perimeter, open_sides, truncated, points) among ``faces``: those with an area of their own.

    A face whose both sides of a segment are the same face has dangling segments, counted as ``open_sides``. The outer side of what hangs together has a negative area
    and isn't one. Corners are listed up to ``most`` sides; more make the outline ``truncated``.
    """
    cross = (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    found = faces.groupBy(scope, "face").agg(F.count("*").alias("sides"), F.sum(cross).alias("area"), F.sum(length).alias("perimeter"), F.count_if(F.col("other") == F.col("face")).alias("open_sides"))
    found = found.where("area > 1e-9 * perimeter * perimeter").withColumn("truncated", F.col("sides") > most)
    listed = faces.join(found.where("not truncated").select(scope, "face").hint("merge"), [scope, "face"]).groupBy(scope, "face").agg(F.collect_list(F.struct("side", "after", "ax", "ay")).alias("__sides"))
    return found.join(listed.hint("merge"), [scope, "face"], "left").withColumn("points", ring(F.coalesce("__sides", F.array().cast(listed.schema["__sides"].dataType)))).drop("__sides")


def probe_profiles(segments: DataFrame, contacts: DataFrame, scope: str, branch: str, most: int = 256, step: float = 1e-4) -> DataFrame:
    """V2: (branch, state, profile_id, thickness, centre_length): the strip that a leader's contacts select among the closed outlines of its sheet.

    ``contacts`` (scope, branch, segment_id) are the segments that a branch's leader touches. An outline is supported if it is one strip (V1), an issue if it has dangling
    segments. An outline of over ``most`` sides is not looked at, and takes the selections of its whole scope back, earlier ones too.
    """
    faces = outline_faces(segments, scope, step)
    outlines = closed_outlines(faces, scope, most)
    probed = outlines.withColumn("strip", strip_profile("points"))
    touched = contacts.join(faces.select(scope, "segment_id", "face").distinct(), [scope, "segment_id"]).select(scope, branch, "face").distinct()
    issue = F.when(F.col("open_sides") > 0, "open")
    candidates = touched.join(probed, [scope, "face"]).select(branch, F.col("face").alias("profile_id"), F.col(scope).alias("group"), (F.col("strip.state") == "UNIQUE").alias("supported"), issue.alias("issue"), "truncated")
    every = contacts.select(branch).distinct()
    chosen = every.join(selected_profiles(candidates, branch), branch, "left").withColumn("state", F.coalesce("state", F.lit("none")))
    return chosen.join(probed.select(F.col("face").alias("profile_id"), "strip.thickness", "strip.centre_length"), "profile_id", "left").select(branch, "state", "profile_id", "thickness", "centre_length")
