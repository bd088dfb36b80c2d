"""Radius, containment and smallest-box joins on grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.plans.checkpoints import cut

#: Pairs that a task compares, pairs from which a cell is dealt to several tasks, and rows of a task, all about; tasks at most; pairs in memory at once; boxes tried at once.
TASK, CELL, ROWS, TASKS, BLOCK, STEP = 5_000_000, 20_000_000, 100_000, 4096, 1_000_000, 64


def _dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with ``__part``, and for how many tasks: the left rows of a cell (``keys``) with very many pairs are dealt to parts by hash, its right ones stand in each part.

    Spark takes listed rows for as few as their table has and would give them to a handful of tasks, so the number goes by the pairs of all cells.
    """
    count = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    cells = cut(count(left, "__l").join(count(right, "__r"), keys).withColumn("__w", F.col("__l").cast("double") * F.col("__r")))
    pairs, rows = cells.agg(F.coalesce(F.sum("__w"), F.lit(0.0)), F.coalesce(F.sum(F.col("__l") + F.col("__r")), F.lit(0))).first()
    # a row for every CELL pairs at most
    large = F.broadcast(cells.where(F.col("__w") > CELL).select(*keys, F.ceil(F.col("__w") / CELL).cast("int").alias("__n")))
    parts = F.coalesce("__n", F.lit(1))
    one = left.join(large, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__n")
    two = right.join(large, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__n")
    return one, two, min(TASKS, 1 + int(pairs / TASK) + int(rows / ROWS))


def _met(points: DataFrame, items: DataFrame, keys: list[str], ready: Callable[[pa.Table], object], find: Callable[[object, pa.RecordBatch], pa.RecordBatch], schema: str, every: bool = False) -> DataFrame:
    """What ``find`` makes of points and the items of their cell (``keys``), which ``ready`` prepares; points of cells without items are left out unless ``every`` is set.

    A task reads its cells as one sorted stream: it holds the items of one cell and a block of its points, and no pair leaves it. Columns of points and items have names of their own, but the keys.
    """
    one, two, n = _dealt(points, items, keys)
    cell = F.xxhash64(*keys, "__part").alias("__cell")
    own = lambda df, is_point: df.select(cell, F.lit(is_point).alias("__point"), *[c for c in df.columns if c not in (*keys, "__part")])
    rows = own(two, False).unionByName(own(one, True), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, prepared = [], None, None
        for batch in batches:
            cells, is_point = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__cell", "__point"))
            ends = np.flatnonzero((cells[1:] != cells[:-1]) | (is_point[1:] != is_point[:-1])) + 1
            for a, b in pairwise([0, *ends.tolist(), len(cells)]):
                if b > a and not is_point[a]:
                    held = [*held, batch.slice(a, b - a)] if cells[a] == at else [batch.slice(a, b - a)]
                    at, prepared = cells[a], None
                elif b > a and (cells[a] == at or every):
                    if cells[a] != at:
                        held, at, prepared = [batch.slice(0, 0)], cells[a], None
                    prepared = ready(pa.Table.from_batches(held)) if prepared is None else prepared
                    step = max(1, BLOCK // max(1, sum(x.num_rows for x in held)))
                    for c in range(a, b, step):
                        yield find(prepared, batch.slice(c, min(step, b - c)))

    return rows.repartition(n, "__cell").sortWithinPartitions("__cell", "__point").mapInArrow(run, schema)


def _numbers(rows: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in names]


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _in_cells(points: DataFrame, boxes: DataFrame, scope: list[str], cell: float) -> tuple[DataFrame, DataFrame]:
    """Points in their grid cell and boxes in each cell that they cover (``__cx``, ``__cy``); rows with a null scope or place meet nothing and are left out."""
    at = lambda c: F.floor(F.col(c) / cell)
    there = lambda df, *cs: df.dropna(subset=[*scope, *cs])
    listed = there(boxes, "x0", "x1", "y0", "y1").withColumn("__cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("__cy", F.explode(F.sequence(at("y0"), at("y1"))))
    return there(points, "x", "y").withColumns({"__cx": at("x"), "__cy": at("y")}), listed


def _held(boxes: tuple, points: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For points (rows) and boxes (columns) whether a box holds a point: in its interior, and with the border."""
    x, y = (c[:, None] for c in _numbers(points, "x", "y"))
    x0, x1, y0, y1 = boxes
    return (x0 < x) & (x < x1) & (y0 < y) & (y < y1), (x0 <= x) & (x <= x1) & (y0 <= y) & (y <= y1)


def listed_boxes(points: DataFrame, boxes: DataFrame, scope: list[str], cell: float, point_id: str, box_id: str) -> DataFrame:
    """V7: for each point the number ``n`` of its boxes, the box ``v`` if it is one, and all their ids as text, sorted and joined by commas (``names``).

    A row for each point, those outside all boxes too; a point with a null scope, place or id is in none.
    """
    own, listed = _in_cells(points.select(*scope, point_id, "x", "y"), boxes.select(*scope, box_id, "x0", "x1", "y0", "y1"), scope, cell)
    keys = [*scope, "__cx", "__cy"]
    own = own.dropna(subset=[point_id]).select(*keys, F.struct(*scope, point_id).alias("__id"), "x", "y")
    listed = listed.withColumn("__name", F.col(box_id).cast("string"))

    def ready(items: pa.Table) -> tuple:
        items = items.take(pc.sort_indices(items.column("__name")))
        return _numbers(items, "x0", "x1", "y0", "y1"), items.column(box_id).combine_chunks(), items.column("__name").combine_chunks()

    def find(prepared: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        sides, ids, names = prepared
        _, inside = _held(sides, batch)
        n, col = inside.sum(1), np.nonzero(inside)[1]
        starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), names.take(pa.array(col))), ",")
        sole = ids.take(pa.array(np.append(col, 0)[starts[:-1]], mask=n != 1))
        return pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(n), sole, joined], names=["id", "n", "v", "names"])

    found = _met(own, listed, keys, ready, find, f"id {_kind(own, '__id')}, n long, v {_kind(boxes, box_id)}, names string", every=True)
    nowhere = points.where(F.greatest(*[F.col(c).isNull() for c in (*scope, point_id, "x", "y")]))
    return found.select("id.*", "n", "v", "names").unionByName(nowhere.select(*scope, point_id, F.lit(0).cast("long").alias("n")), allowMissingColumns=True)


def _around(left: DataFrame, right: DataFrame, scope: list[str], radius: float, left_xy=("x", "y"), right_xy=("x", "y")) -> tuple[DataFrame, DataFrame]:
    """Left rows in their cell of a grid of side ``radius`` and the eight around it, right ones in their own (``__cx``, ``__cy``), with their places as ``__lx``, ``__ly``, ``__rx``, ``__ry``; rows without a scope or place are left out."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / radius)
    near = left.dropna(subset=[*scope, *left_xy]).withColumn("__s", F.explode(steps)).withColumns({"__cx": cell(left_xy[0]) + F.col("__s.a"), "__cy": cell(left_xy[1]) + F.col("__s.b"), "__lx": F.col(left_xy[0]), "__ly": F.col(left_xy[1])}).drop("__s")
    own = right.dropna(subset=[*scope, *right_xy]).withColumns({"__cx": cell(right_xy[0]), "__cy": cell(right_xy[1]), "__rx": F.col(right_xy[0]), "__ry": F.col(right_xy[1])})
    return near, own


def within_radius(left: DataFrame, right: DataFrame, scope: list[str], radius: float, left_xy=("x", "y"), right_xy=("x", "y")) -> DataFrame:
    """Every pair of a scope within ``radius``, border included, with ``distance``.

    Points meet in the cells of a grid of side ``radius``: the right points once, the left ones in their own and the eight
    cells around. Columns of the right side but the scope must have names of their own. Tasks get about equal numbers of pairs.
    """
    near, own = _around(left, right, scope, radius, left_xy, right_xy)
    own = own.drop(*{*right_xy} & set(left.columns))
    keys = [*scope, "__cx", "__cy"]
    one, two, n = _dealt(near, own, keys)
    keys.append("__part")
    pairs = one.repartition(n, *keys).join(two.repartition(n, *keys), keys)
    distance = F.sqrt((F.col("__lx") - F.col("__rx")) ** 2 + (F.col("__ly") - F.col("__ry")) ** 2)
    return pairs.withColumn("distance", distance).where(F.col("distance") <= radius).drop("__cx", "__cy", "__part", "__lx", "__ly", "__rx", "__ry")


def nearest(left: DataFrame, right: DataFrame, scope: list[str], radius: float, left_id: str, right_id: str, left_xy=("x", "y"), right_xy=("x", "y")) -> DataFrame:
    """Each left row's nearest right row within the radius (ties: the least id), null if there is none, and how many are within it.

    A task keeps of a left row and a cell one nearest right row and a count, and no pairs.
    """
    own, near = _around(right, left, scope, radius, right_xy, left_xy)  # the right rows stand in nine cells, so a left one has all of its own in one cell
    keys = [*scope, "__cx", "__cy"]
    near, own = near.select(*keys, F.col(left_id).alias("__id"), "__rx", "__ry"), own.select(*keys, F.col(right_id).alias("__other"), "__lx", "__ly")
    ready = lambda items: items.take(pc.sort_indices(items.column("__other"))).combine_chunks()

    def find(items: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (c[:, None] for c in _numbers(batch, "__rx", "__ry"))
        sx, sy = _numbers(items, "__lx", "__ly")
        d = np.sqrt((x - sx) ** 2 + (y - sy) ** 2)
        inside = d <= radius
        d[~inside] = np.inf
        within, best = inside.sum(1), d.argmin(1)
        some = np.flatnonzero(within)
        other = items.column("__other").combine_chunks().take(pa.array(best[some]))
        return pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(some)), pa.array(d[some, best[some]]), other, pa.array(within[some])], names=["id", "distance", "other", "within"])

    found = _met(near, own, keys, ready, find, f"id {_kind(left, left_id)}, distance double, other {_kind(right, right_id)}, within long")
    best = found.groupBy(F.col("id").alias(left_id)).agg(F.min(F.struct("distance", "other")).alias("b"), F.sum("within").alias("within"))
    return left.join(best, left_id, "left").select(*left.columns, F.col("b.other").alias(right_id), F.col("b.distance").alias("distance"), F.coalesce("within", F.lit(0)).alias("within"))


def containing_boxes(points: DataFrame, boxes: DataFrame, scope: list[str], cell: float, box_id: str, strict: bool = False) -> DataFrame:
    """Every pair of a point (x, y) and a box (x0, y0, x1, y1) of its scope that holds it; strictly or with the border.

    A box is listed in each grid cell that it covers; choose ``cell`` near the usual side of a box.
    """
    one, two, n = _dealt(*_in_cells(points, boxes, scope, cell), keys := [*scope, "__cx", "__cy"])
    inside = "x0 < x and x < x1 and y0 < y and y < y1" if strict else "x0 <= x and x <= x1 and y0 <= y and y <= y1"
    keys.append("__part")
    return one.repartition(n, *keys).join(two.repartition(n, *keys), keys).where(inside).drop("__cx", "__cy", "__part")


def smallest_box(points: DataFrame, boxes: DataFrame, scope: list[str], cell: float, point_id: str, box_id: str) -> DataFrame:
    """Each point's smallest box (ties: the least id), null outside all boxes.

    A cell's boxes are tried from the smallest on, until each of its points has one.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    own, listed = _in_cells(points.select(*scope, F.col(point_id).alias("__id"), "x", "y"), boxes.select(*scope, box_id, "x0", "x1", "y0", "y1", area.alias("area")), scope, cell)

    def ready(items: pa.Table) -> pa.Table:
        return items.take(pc.sort_indices(items, [("area", "ascending"), (box_id, "ascending")])).combine_chunks()

    def find(items: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
        sides, at, left = _numbers(items, "x0", "x1", "y0", "y1"), np.full(batch.num_rows, -1), np.arange(batch.num_rows)
        for start in range(0, items.num_rows, STEP):
            _, inside = _held(tuple(c[start : start + STEP] for c in sides), batch.take(pa.array(left)))
            some = inside.any(1)
            at[left[some]] = start + inside[some].argmax(1)
            if not len(left := left[~some]):
                break
        has = np.flatnonzero(at >= 0)
        best = items.take(pa.array(at[has]))
        return pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(has)), *(best.column(c).combine_chunks() for c in ("area", box_id))], names=["id", "area", box_id])

    found = _met(own, listed, [*scope, "__cx", "__cy"], ready, find, f"id {_kind(points, point_id)}, area double, {box_id} {_kind(boxes, box_id)}")
    best = found.groupBy(F.col("id").alias(point_id)).agg(F.min(F.struct("area", box_id)).alias("b"))
    return points.join(best, point_id, "left").select(*points.columns, F.col(f"b.{box_id}").alias(box_id), F.col("b.area").alias("area"))


def unique_owner(points: DataFrame, boxes: DataFrame, scope: list[str], cell: float, point_id: str, box_id: str) -> DataFrame:
    """The one box whose interior holds a point while no other box even touches it; else null and the state none, ambiguous or contact."""
    own, listed = _in_cells(points.select(*scope, F.col(point_id).alias("__id"), "x", "y"), boxes.select(*scope, box_id, "x0", "x1", "y0", "y1"), scope, cell)
    ready = lambda items: (_numbers(items, "x0", "x1", "y0", "y1"), items.column(box_id).combine_chunks())

    def find(items: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        inner, touched = _held(items[0], batch)
        some = np.flatnonzero(touched.any(1))
        inner, touched = inner[some], touched[some]
        owners = inner.sum(1)
        b = items[1].take(pa.array(inner.argmax(1), mask=owners == 0))
        return pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(some)), pa.array(owners), pa.array(touched.sum(1) - owners), b], names=["id", "owners", "contacts", "b"])

    found = _met(own, listed, [*scope, "__cx", "__cy"], ready, find, f"id {_kind(points, point_id)}, owners long, contacts long, b {_kind(boxes, box_id)}")
    counts = found.groupBy(F.col("id").alias(point_id)).agg(F.sum("owners").alias("owners"), F.sum("contacts").alias("contacts"), F.min("b").alias("b"))
    out = points.join(counts, point_id, "left")
    state = F.when(F.col("owners").isNull(), "none").when(F.col("contacts") > 0, "contact").when(F.col("owners") > 1, "ambiguous").otherwise("owned")
    return out.withColumn("state", state).select(*points.columns, "state", F.when(F.col("state") == "owned", F.col("b")).alias(box_id))


def inherited_code(orphans: DataFrame, frames: DataFrame, scope: list[str], least_gap: float = 5000.0) -> DataFrame:
    """The code of the frame with the least (vertical gap, horizontal distance, id) of its scope within max(5000, two heights).

    Orphans have id, x, y and h; frames have frame_id, code, fx and fy. Null without one. The nearest lines of frames above and below an orphan, then the nearest frames
    left and right on them, are found by sorted windows, so no pairs are listed.
    """
    reach = F.greatest(F.lit(least_gap), 2 * F.coalesce(F.col("h"), F.lit(0.0)))
    known = lambda df, *cs: df.dropna(subset=[*scope, *cs])
    framed = known(frames, "fy").where("not isnan(fy)").withColumn("f", F.struct("frame_id", "code"))
    # a line: the frames of one height; its first frame serves where no horizontal distance is known
    lines = framed.groupBy(*scope, "fy").agg(F.min("f").alias("f")).select(*scope, F.col("fy").alias("at"), F.struct("fy", "f").alias("line"))
    heights = known(orphans, "y").where("not isnan(y)").select(*scope, F.col("y").alias("at")).distinct()
    both = _beside(heights.withColumn("orphan", F.lit(True)).unionByName(lines, allowMissingColumns=True), scope, "at", "line").where("orphan")
    gap = lambda c: F.abs(F.col("at") - F.col(f"{c}.fy"))
    nearer = F.when(F.col("low").isNull() | (gap("high") < gap("low")), F.array("high")).when(F.col("high").isNull() | (gap("low") < gap("high")) | (F.col("low.fy") == F.col("high.fy")), F.array("low")).otherwise(F.array("low", "high"))
    on = both.select(*scope, F.col("at").alias("y"), F.explode(nearer).alias("line")).where("line is not null")
    sought = orphans.join(on, [*scope, "y"]).withColumn("gap", F.abs(F.col("y") - F.col("line.fy"))).where(F.col("gap") <= reach)
    sought = sought.select(*scope, "id", "gap", F.col("line.fy").alias("fy"), F.col("line.f").alias("any"), F.when(~F.isnan("x"), F.col("x")).alias("at"))
    placed = known(framed, "fx").where("not isnan(fx)").groupBy(*scope, "fy", "fx").agg(F.min("f").alias("f"))
    placed = placed.select(*scope, "fy", F.col("fx").alias("at"), F.struct("fx", "f").alias("place"))
    ends = _beside(sought.withColumn("orphan", F.lit(True)).unionByName(placed, allowMissingColumns=True), [*scope, "fy"], "at", "place").where("orphan")
    side = lambda c: F.abs(F.col("at") - F.col(f"{c}.fx"))
    there = lambda c: F.when(side(c).isNotNull(), F.struct("gap", F.lit(False).alias("unknown"), side(c).alias("side"), F.col(f"{c}.f").alias("f")))
    best = F.least(there("low"), there("high"), F.struct("gap", F.lit(True).alias("unknown"), F.lit(0.0).alias("side"), F.col("any").alias("f")))
    found = ends.groupBy("id").agg(F.min(best).alias("b"))
    return orphans.join(found, "id", "left").select(*orphans.columns, F.col("b.f.code").alias("code"), F.col("b.f.frame_id").alias("frame_id"))


def _beside(rows: DataFrame, scope: list[str], at: str, value: str) -> DataFrame:
    """``rows`` with the non-null ``value`` that is next at or before their place (``low``) and at or after it (``high``)."""
    window = Window.partitionBy(*scope)
    low, high = (F.last(value, ignorenulls=True).over(window.orderBy(order)) for order in (F.asc(at), F.desc(at)))
    return rows.withColumn("low", low).withColumn("high", high)
