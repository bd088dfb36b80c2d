"""Recognisers on native geometry."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sibling_codes(attributes: DataFrame, scope: list[str], parent: str, tag: str, value: str, code_tag: str, view_tag: str) -> DataFrame:
    """Per group of sibling attributes its code and view, if it has exactly one of each; else null and the reason."""
    of = lambda t: F.collect_set(F.when(F.upper(tag) == t, F.trim(value)))
    groups = attributes.groupBy(*scope, parent).agg(of(code_tag).alias("codes"), of(view_tag).alias("views"))
    reason = F.when(F.size("codes") == 0, "no_code").when(F.size("codes") > 1, "several_codes").when(F.size("views") == 0, "no_view").when(F.size("views") > 1, "several_views")
    return groups.select(*scope, parent, reason.alias("reason"), F.when(reason.isNull(), F.col("codes")[0]).alias("code"), F.when(reason.isNull(), F.col("views")[0]).alias("view"))


def trusted_groups(groups: DataFrame, edges: DataFrame, sheet: str, code: str) -> DataFrame:
    """On sheets that an explicit edge names, the one leader-backed group of a code; codes with several are left out."""
    trusted = groups.join(edges.where("explicit").select(F.col("target").alias(sheet)).distinct(), sheet, "left_semi").where("leader_backed")
    return trusted.groupBy(sheet, code).agg(F.count("*").alias("n"), F.min("group_id").alias("group_id")).where("n = 1").drop("n")


def _cells(x: str, y: str, size: float) -> F.Column:
    """The cell of a point and the eight around it, as an array of structs."""
    at = lambda c, d: F.floor(F.col(c) / size) + d
    return F.array(*[F.struct(at(x, i).alias("i"), at(y, j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def _met(left: DataFrame, right: DataFrame, scope: list[str], a: tuple[str, str], b: tuple[str, str], tolerance: float) -> DataFrame:
    """Rows of both sides whose points a and b lie within ``tolerance`` in x and in y: b meets a in its cell or one beside it."""
    own = left.withColumn("__c", F.struct(F.floor(F.col(a[0]) / tolerance).alias("i"), F.floor(F.col(a[1]) / tolerance).alias("j")))
    near = right.withColumn("__c", F.explode(_cells(*b, tolerance)))
    close = [F.abs(F.col(p) - F.col(q)) <= tolerance for p, q in zip(a, b)]
    return own.join(near, [*scope, "__c"]).where(close[0] & close[1]).drop("__c")


def rectangles(lines: DataFrame, scope: list[str], tolerance: float = 0.5) -> DataFrame:
    """Frames of two horizontal and two vertical lines whose ends meet within ``tolerance``.

    Lines have id, x0, y0, x1 and y1. Each corner is a join on grid cells and their neighbours with the distance verified. A frame's box has the y of its
    horizontal and the x of its vertical sides; boxes that are equal to ``tolerance`` are one, with the least ids of its sides. Closed outlines are
    given as their four lines.
    """
    t = tolerance
    ends = lines.select(*scope, "id", F.least("x0", "x1").alias("a"), F.least("y0", "y1").alias("b"), F.greatest("x0", "x1").alias("c"), F.greatest("y0", "y1").alias("d"))
    flat = ends.where(f"d - b <= {t} and c - a > {t}").groupBy(*scope, "a", "b", "c", "d").agg(F.min("id").alias("id"))  # equal lines are one
    tall = ends.where(f"c - a <= {t} and d - b > {t}").groupBy(*scope, "a", "b", "c", "d").agg(F.min("id").alias("id"))
    side = lambda df, n: df.select(*scope, *[F.col(c).alias(f"{n}_{c}") for c in ("a", "b", "c", "d", "id")])
    bottom, top, left, right = side(flat, "bottom"), side(flat, "top"), side(tall, "left"), side(tall, "right")
    corner = _met(bottom, left, scope, ("bottom_a", "bottom_b"), ("left_a", "left_b"), t)
    three = _met(corner, top, scope, ("left_c", "left_d"), ("top_a", "top_b"), t)
    four = _met(three, right, scope, ("bottom_c", "bottom_d"), ("right_a", "right_b"), t)
    four = four.where(f"abs(right_c - top_c) <= {t} and abs(right_d - top_d) <= {t}")
    box = {"x0": F.col("left_a"), "y0": F.col("bottom_b"), "x1": F.col("right_a"), "y1": F.col("top_b")}
    found = four.select(*scope, *[c.alias(n) for n, c in box.items()], *[F.col(f"{n}_id").alias(n) for n in ("bottom", "top", "left", "right")])
    cell = [F.round(F.col(n) / t).alias(f"__{n}") for n in box]
    one = found.groupBy(*scope, *cell).agg(*[F.min(c).alias(c) for c in (*box, "bottom", "top", "left", "right")])
    return one.select(*scope, *box, "bottom", "top", "left", "right")


def border_leaders(leaders: DataFrame, borders: DataFrame, scope: list[str], tolerance: float = 1e-6, cell: float = 1000.0) -> DataFrame:
    """V6: each leader's border whose outline has the leader's end (x, y) within ``tolerance``; ends on several borders are ambiguous, all branches kept.

    Borders are boxes with border_id. Borders with equal boxes meet leaders as one, listed in the grid cells of the boxes; their ids are joined last, so only the result has all pairs.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - tolerance) / cell), F.floor((F.col(b) + tolerance) / cell)))
    own_boxes = borders.groupBy(*scope, "border_id").agg(F.array_sort(F.collect_set(F.struct("x0", "y0", "x1", "y1"))).alias("__boxes"))
    shapes = own_boxes.groupBy(*scope, "__boxes").agg(F.count("*").alias("__n"))
    listed = shapes.select("*", F.inline("__boxes")).withColumn("__cx", spread("x0", "x1")).withColumn("__cy", spread("y0", "y1"))
    own = leaders.select(*scope, "leader_id", "x", "y", F.floor(F.col("x") / cell).alias("__cx"), F.floor(F.col("y") / cell).alias("__cy"))
    t = tolerance
    inside = f"x >= x0 - {t} and x <= x1 + {t} and y >= y0 - {t} and y <= y1 + {t}"
    edge = f"(abs(x - x0) <= {t} or abs(x - x1) <= {t} or abs(y - y0) <= {t} or abs(y - y1) <= {t})"
    hits = own.join(listed, [*scope, "__cx", "__cy"]).where(f"{inside} and {edge}").select(*scope, "leader_id", "__boxes", "__n").distinct()
    counts = hits.groupBy(*scope, "leader_id").agg(F.sum("__n").alias("borders"))
    counted = hits.drop("__n").join(counts, [*scope, "leader_id"]).withColumn("state", F.when(F.col("borders") > 1, "ambiguous").otherwise("branch"))
    return counted.join(own_boxes, [*scope, "__boxes"]).select(*scope, "leader_id", "border_id", "borders", "state")


def _spread(c: F.Column, tolerance: float, cell: float) -> F.Column:
    """The grid cells, one or two, in which a value may lie that is within ``tolerance``."""
    return F.explode(F.sequence(F.floor((c - tolerance) / cell), F.floor((c + tolerance) / cell)))


def bind_dimensions(dimensions: DataFrame, segments: DataFrame, scope: list[str], tolerance: float = 1e-6, cell: float = 1.0) -> DataFrame:
    """V3: each dimension's segment: both its points are the segment's ends (rank 1) or project onto them along an axis (rank 2).

    Dimensions have dim_id, ax, ay, bx, by and value; segments seg_id, sx, sy, tx and ty. They meet on the grid cells of their lower ends and, along an axis,
    of both bounds. The best rank counts; several segments at it are ambiguous, a value that differs from the segment's length is a conflict, else bound.
    """
    bounds = lambda p, q: {"lx": F.least(f"{p}x", f"{q}x"), "ly": F.least(f"{p}y", f"{q}y"), "gx": F.greatest(f"{p}x", f"{q}x"), "gy": F.greatest(f"{p}y", f"{q}y")}
    dims = dimensions.withColumns({f"__{n}": c for n, c in bounds("a", "b").items()})
    segs = segments.withColumns({f"{n}_": c for n, c in bounds("s", "t").items()})
    same = lambda p, q: f"abs({p}x - {q}x) <= {tolerance} and abs({p}y - {q}y) <= {tolerance}"
    tests = {
        ("lx", "ly"): (1, f"({same('a', 's')} and {same('b', 't')}) or ({same('a', 't')} and {same('b', 's')})"),
        ("lx", "gx"): (2, f"abs(__lx - lx_) <= {tolerance} and abs(__gx - gx_) <= {tolerance} and abs(sy - ty) <= {tolerance}"),
        ("ly", "gy"): (2, f"abs(__ly - ly_) <= {tolerance} and abs(__gy - gy_) <= {tolerance} and abs(sx - tx) <= {tolerance}"),
    }
    pairs = None
    for (p, q), (rank, test) in tests.items():
        own = dims.withColumns({"__p": F.floor(F.col(f"__{p}") / cell), "__q": F.floor(F.col(f"__{q}") / cell)})
        near = segs.withColumn("__p", _spread(F.col(f"{p}_"), tolerance, cell)).withColumn("__q", _spread(F.col(f"{q}_"), tolerance, cell))
        length = F.sqrt((F.col("sx") - F.col("tx")) ** 2 + (F.col("sy") - F.col("ty")) ** 2)
        met = own.join(near, [*scope, "__p", "__q"]).where(test).select(*scope, "dim_id", "value", "seg_id", F.lit(rank).alias("rank"), length.alias("length"))
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.groupBy(*scope, "dim_id", "value", "seg_id", "length").agg(F.min("rank").alias("rank"))
    per_rank = pairs.groupBy(*scope, "dim_id", "value", "rank").agg(F.count("*").alias("n"), F.min(F.struct("seg_id", "length")).alias("seg"))
    best = per_rank.groupBy(*scope, "dim_id", "value").agg(F.min(F.struct("rank", "n", "seg")).alias("b"))
    state = F.when(F.col("b.n") > 1, "ambiguous").when(F.abs(F.col("b.seg.length") - F.col("value")) > 0.5, "conflict").otherwise("bound")
    return best.select(*scope, "dim_id", F.col("b.rank").alias("rank"), state.alias("state"), F.when(state != "ambiguous", F.col("b.seg.seg_id")).alias("seg_id"))


def covered_spans(spans: DataFrame, views: DataFrame, scope: list[str], tolerance: float = 1e-6, cell: float = 500.0) -> DataFrame:
    """V4: whether each span (span_id, y, a, b) is covered by the union of its scope's boxes without a gap: covered, gap or outside (an end lies in no box).

    Spans and boxes meet in the grid cells that both touch; a pair counts in the first of them. Equal boxes cover the same and are one.
    """
    at = lambda c, d=0.0: F.floor((c + d) / cell)
    x0, x1, y0, y1, a, b = (F.col(c) for c in ("x0", "x1", "y0", "y1", "a", "b"))
    boxes = views.select(*scope, "x0", "x1", "y0", "y1").distinct()
    listed = boxes.withColumn("__i", F.explode(F.sequence(at(x0, -tolerance), at(x1, tolerance)))).withColumn("__j", F.explode(F.sequence(at(y0, -tolerance), at(y1, tolerance))))
    own = spans.withColumn("__i", F.explode(F.sequence(at(F.least(a, b)), at(b)))).withColumn("__j", at(F.col("y")))
    first = F.col("__i") == F.greatest(at(x0, -tolerance), at(a))
    met = own.join(listed, [*scope, "__i", "__j"]).where(first).where(f"y0 - {tolerance} <= y and y <= y1 + {tolerance} and x1 >= a - {tolerance} and x0 <= b + {tolerance}")
    order = Window.partitionBy(*scope, "span_id").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = met.withColumn("__gap", F.coalesce(F.col("x0") > reach + tolerance, F.lit(False)))
    sums = gaps.groupBy(*scope, "span_id").agg(F.bool_or("__gap").alias("gap"), F.min("x0").alias("low"), F.max("x1").alias("high"))
    out = spans.join(sums, [*scope, "span_id"], "left")
    outside = F.col("low").isNull() | (F.col("low") > F.col("a") + tolerance) | (F.col("high") < F.col("b") - tolerance)
    return out.select(*scope, "span_id", F.when(outside, "outside").when(F.col("gap"), "gap").otherwise("covered").alias("state"))


def trace_paths(segments: DataFrame, starts: DataFrame, scope: str, tolerance: float = 1e-6, most: int = 64) -> DataFrame:
    """V5: from each start the chain of segments that meet end to end, until none follows; a fork, a return or ``most`` segments end it with a reason.

    Segments have seg_id, sx, sy, tx, ty; starts have start_id, x, y. Ends meet within ``tolerance`` of the first end at a place. A scope is one
    sheet. Crossings without common ends never join.
    """

    def trace(key, segs: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple, list] = {}

        def place(x: float, y: float) -> tuple:
            i, j = math.floor(x / tolerance), math.floor(y / tolerance)
            for near in ((i + a, j + b) for a in (0, -1, 1) for b in (0, -1, 1)):
                for p in cells.get(near, ()):
                    if abs(p[0] - x) <= tolerance and abs(p[1] - y) <= tolerance:
                        return p
            cells.setdefault((i, j), []).append((x, y))
            return x, y

        ends: dict[tuple, list] = {}
        for r in segs.sort_values("seg_id").to_dict("records"):
            a, b = place(r["sx"], r["sy"]), place(r["tx"], r["ty"])
            ends.setdefault(a, []).append((r["seg_id"], b))
            ends.setdefault(b, []).append((r["seg_id"], a))
        out = []
        for r in begins.sort_values("start_id").to_dict("records"):
            at, used, seen, reason = place(r["x"], r["y"]), {}, set(), "end"
            while True:
                seen.add(at)
                ahead = [(s, p) for s, p in ends.get(at, []) if s not in used]
                if not ahead:
                    break
                if len(ahead) > 1:
                    reason = "branch"
                    break
                if len(used) >= most:
                    reason = "too_long"
                    break
                used[ahead[0][0]] = True
                at = ahead[0][1]
                if at in seen:
                    reason = "rejoin"
                    break
            out.append((key[0], r["start_id"], len(used), reason if used else "no_stem", ",".join(map(str, used))))
        return pd.DataFrame(out, columns=[scope, "start_id", "length", "reason", "path"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"{scope} {kind(starts, scope)}, start_id {kind(starts, 'start_id')}, length int, reason string, path string"
    return segments.groupBy(scope).cogroup(starts.groupBy(scope)).applyInPandas(trace, schema)


def index_direction(symbols: DataFrame) -> DataFrame:
    """The direction of an index symbol: from the centre of its circle (cx, cy, r) to the tip of its wedge (tx, ty).

    The tip must lie outside the circle and within two radii; tolerance max(1e-5 r, 1e-7). Else null and the reasons.
    """
    dx, dy = F.col("tx") - F.col("cx"), F.col("ty") - F.col("cy")
    d = F.sqrt(dx * dx + dy * dy)
    tolerance = F.greatest(F.col("r") * 1e-5, F.lit(1e-7))
    reasons = F.array_compact(F.array(F.when(F.col("r") <= 0, "no_circle"), F.when(d < F.col("r") - tolerance, "tip_inside"), F.when(d > 2 * F.col("r") + tolerance, "tip_far")))
    good = F.size(reasons) == 0
    return symbols.withColumns({"reasons": F.array_join(reasons, ","), "ux": F.when(good, F.round(F.try_divide(dx, d), 9)), "uy": F.when(good, F.round(F.try_divide(dy, d), 9))})


def reference_page(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The page of each reference: its frame's code if all frames around it agree (else conflict), otherwise the nearest by (distance, code, id).

    Candidates have code, page_id, distance, diagonal and framed. Two codes within a hundredth of the diagonal of the nearest are ambiguous.
    """
    framed = candidates.where("framed").groupBy(*keys).agg(F.count_distinct("code").alias("codes"), F.min("code").alias("framed_code"))
    near = candidates.groupBy(*keys).agg(F.min(F.struct("distance", "code", "page_id", "diagonal")).alias("n"))
    close = candidates.join(near, keys).where("distance - n.distance <= 0.01 * n.diagonal").groupBy(*keys).agg(F.count_distinct("code").alias("close"))
    out = near.join(framed, keys, "left").join(close, keys)
    state = F.when(F.col("codes") > 1, "conflict").when(F.col("codes") == 1, "frame").when(F.col("close") > 1, "ambiguous").otherwise("nearest")
    return out.select(*keys, state.alias("state"), F.when(state == "frame", F.col("framed_code")).when(state == "nearest", F.col("n.code")).alias("code"))


def rank_subviews(views: DataFrame, keys: list[str], top_k: int = 3) -> DataFrame:
    """Additive scores of detail views: code 4 (1 if only in part), names up to 3, material 1, view reference 3, reference entity 5, leader .8, frame .4, dimensions up to .8."""
    one = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    score = F.when(F.col("code_exact"), 4.0).when(F.col("code_partial"), 1.0).otherwise(0.0) + F.least(F.col("names").cast("double"), F.lit(3.0)) + one("material", 1.0) + one("view_reference", 3.0) + one("reference_entity", 5.0) + one("leader", 0.8) + one("frame", 0.4) + F.least(F.col("dimensions") * 0.2, F.lit(0.8))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "view_id")
    return views.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(*keys, "view_id", "score", "rank")
