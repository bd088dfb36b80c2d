"""Dense input: right rows, and plans that list no pairs where a row for each point is asked for."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import catalog, evidence, pricing, sequential, spatial
from tallyforge.plans import checkpoints
from tallyforge.plans.queries import QUERIES


def joins(df) -> list[str]:
    """The plan's lines with a join."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]


def dense(spark, n, seed):
    """Points, some of one place, some with nulls, and boxes that nearly all hold many of them."""
    rng = random.Random(seed)
    points = [(i, "s" if i % 2 else "t", float(rng.randrange(40)), float(rng.randrange(40))) for i in range(n)] + [(n, None, 1.0, 1.0), (n + 1, "s", None, 1.0), (n + 2, "s", 500.0, 1.0)]
    boxes = [(i, "s" if i % 3 else "t", x := float(rng.randrange(-10, 40)), x + rng.randrange(1, 30), y := float(rng.randrange(-10, 40)), y + rng.randrange(1, 30)) for i in range(n // 4)]
    return points, boxes, spark.createDataFrame(points, "p int, s string, x double, y double"), spark.createDataFrame(boxes, "b int, s string, x0 double, x1 double, y0 double, y1 double")


def holding(point, boxes):
    _, s, x, y = point
    return [b for b in boxes if None not in (s, x) and b[1] == s and b[2] <= x <= b[3] and b[4] <= y <= b[5]]


def test_owned_points_lists_no_pairs(spark):
    points, boxes, p, b = dense(spark, 400, 1)
    out = evidence.owned_points(p.withColumnRenamed("p", "point_id"), b.withColumnRenamed("b", "view_id"), ["s"], cell=9.0)
    assert not [x for x in joins(out) if "__cx" in x and "Inner" in x]
    got = {r["point_id"]: (r["owner"], r["views"], r["issue"]) for r in out.collect()}
    for q in points:
        ids = [x[0] for x in holding(q, boxes)]
        assert got[q[0]] == (ids[0] if len(ids) == 1 else None, ",".join(sorted(map(str, ids))), "outside" if not ids else "several" if len(ids) > 1 else None)


def test_points_of_one_id_share_their_views(spark):
    p = spark.createDataFrame([(1, "s", 1.0, 1.0), (1, "s", 9.0, 9.0), (2, "s", 1.0, 1.0)], "point_id int, s string, x double, y double")
    v = spark.createDataFrame([(3, "s", 0.0, 2.0, 0.0, 2.0), (10, "s", 8.0, 10.0, 8.0, 10.0)], "view_id int, s string, x0 double, x1 double, y0 double, y1 double")
    got = sorted((r["point_id"], r["owner"], r["views"], r["issue"]) for r in evidence.owned_points(p, v, ["s"], cell=5.0).collect() if r["point_id"] == 2) + sorted((r["point_id"], r["views"]) for r in evidence.owned_points(p, v, ["s"], cell=5.0).collect() if r["point_id"] == 1)
    assert got == [(2, 3, "3", None), (1, "10,3"), (1, "10,3")]


def test_smallest_box_and_owner_list_no_pairs(spark):
    points, boxes, p, b = dense(spark, 400, 2)
    smallest, owner = spatial.smallest_box(p, b, ["s"], 9.0, "p", "b"), spatial.unique_owner(p, b, ["s"], 9.0, "p", "b")
    assert not [x for x in joins(smallest) + joins(owner) if "__cx" in x and "Inner" in x]
    got = {r["p"]: (r["area"], r["b"]) for r in smallest.collect()}
    states = {r["p"]: (r["state"], r["b"]) for r in owner.collect()}
    for q in points:
        held = holding(q, boxes)
        assert got[q[0]] == min((((x[3] - x[2]) * (x[5] - x[4]), x[0]) for x in held), default=(None, None))
        inner = [x[0] for x in held if x[2] < q[2] < x[3] and x[4] < q[3] < x[5]]
        want = "none" if not held else "contact" if len(held) > len(inner) else "ambiguous" if len(inner) > 1 else "owned"
        assert states[q[0]] == (want, inner[0] if want == "owned" else None)


def test_radius_join_is_dealt_by_its_pairs(spark, monkeypatch):
    """One cell with nearly all pairs goes to several tasks, and the number of tasks goes by the pairs."""
    monkeypatch.setattr(spatial, "TASK", 1000)
    monkeypatch.setattr(spatial, "CELL", 2000)
    rng = random.Random(4)
    a = [(i, rng.uniform(0, 8), rng.uniform(0, 8)) for i in range(150)] + [(150, None, 1.0)]
    b = [(i, rng.uniform(0, 8), rng.uniform(0, 8)) for i in range(150)] + [(150, 1.0, None)]
    left = spark.createDataFrame(a, "a long, x double, y double").withColumn("s", F.lit(1))
    right = spark.createDataFrame(b, "b long, u double, v double").withColumn("s", F.lit(1))
    pairs = spatial.within_radius(left, right, ["s"], 9.0, right_xy=("u", "v"))
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    want = {(i, j) for i, x, y in a[:-1] for j, u, v in b[:-1] if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 9.0}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    most = max(sum(r["task"] == t for r in got) for t in {r["task"] for r in got})
    assert most < len(want) / 3


def test_nearest_lists_no_pairs(spark):
    rng = random.Random(5)
    a = [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(200)] + [(200, None, 1.0), (201, 99.0, 99.0)]
    b = [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(200)]
    left = spark.createDataFrame(a, "a long, x double, y double").withColumn("s", F.lit("s"))
    right = spark.createDataFrame(b, "b long, u double, v double").withColumn("s", F.lit("s"))
    out = spatial.nearest(left, right, ["s"], 5.0, "a", "b", right_xy=("u", "v"))
    assert not [x for x in joins(out) if "__cx" in x and "Inner" in x]
    got = {r["a"]: (r["distance"], r["b"], r["within"]) for r in out.collect()}
    for i, x, y in a:
        near = [] if x is None else [(d, j) for j, u, v in b if (d := ((x - u) ** 2 + (y - v) ** 2) ** 0.5) <= 5.0]
        assert got[i] == (*min(near, default=(None, None)), len(near))


def test_inherited_code_lists_no_pairs(spark):
    rng = random.Random(7)
    orphans = [(i, "s", float(rng.randrange(20)), float(rng.randrange(0, 40000, 500)), rng.choice([10.0, None, 4000.0])) for i in range(300)] + [(300, "s", None, 1000.0, 1.0), (301, "s", 1.0, None, 1.0), (302, "t", 1.0, 1.0, 1.0)]
    frames = [(i, "s", f"c{i}", float(rng.randrange(20)), float(rng.randrange(0, 40000, 1000))) for i in range(200)]
    o, f = spark.createDataFrame(orphans, "id int, s string, x double, y double, h double"), spark.createDataFrame(frames, "frame_id int, s string, code string, fx double, fy double")
    out = spatial.inherited_code(o, f, ["s"])
    assert not [x for x in joins(out) if "__band" in x]
    got = {r["id"]: r["frame_id"] for r in out.collect()}
    for i, s, x, y, h in orphans:
        near = [(abs(y - fy), abs((x or 0) - fx) if x is not None else 0, n) for n, t, _, fx, fy in frames if s == t and abs(y - fy) <= max(5000.0, 2 * (h or 0))] if y is not None else []
        assert got[i] == (min(near)[2] if near else None)


def test_conflicts_shuffle_a_row_for_each_key(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (1, None, "z"), (2, "a", "x"), (2, "a", "y"), (3, "a", "x"), (3, "b", "x"), (4, "a", None), (4, "b", "y"), (5, "b", "y"), (5, "a", "x"), (5, "c", "y"), (None, "a", "x"), (None, "b", "y")]
    out = pricing.cross_source_conflicts(spark.createDataFrame(rows, "k int, v string, s string"), "k", "v", "s")
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"] or 0, r["values"], r["sources"], r["status"]) for r in out.collect()) == [(0, 2, "x|y", "BLOCK"), (1, 2, "x|y", "BLOCK"), (5, 3, "x|y", "BLOCK")]


def test_phrases_of_one_first_word_are_not_compared(spark):
    """Whole phrases are looked up, however many begin with one word; odd spaces and phrases without codes count as in SQL."""
    phrases = [(f"red {i}", f"c{i}") for i in range(300)] + [("Red 1", "c1"), ("red 2 b", "d"), (" lead", "e"), ("x\ty", "f"), ("none", None), (None, "g"), ("", "h")]
    mentions = [(1, "a RED 1 b"), (2, "red 2 b"), (3, "xred 1"), (4, "red 17"), (5, "  lead"), (6, "x\ty z"), (7, "none"), (8, None), (9, "red 1 and red 5"), (10, "red 3 red 3")]
    p, m = spark.createDataFrame(phrases, "phrase string, code string"), spark.createDataFrame(mentions, "mention int, text string")
    out = catalog.phrase_codes(m, p)
    assert "Contains" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "contains(" not in plan.lower()
    got = {r["mention"]: (r["code"], r["status"]) for r in out.collect()}
    for i, text in mentions:
        codes = {c for q, c in phrases if text is not None and q is not None and c is not None and f" {q} ".lower() in f" {text} ".lower()}
        assert got[i] == (min(codes) if len(codes) == 1 else None, "REVIEW" if len(codes) == 1 else "BLOCK" if codes else None), i


def tasks(spark, df) -> int:
    return df.withColumn("task", F.spark_partition_id()).select("task").distinct().count()


def test_outlines_are_dealt_to_tasks_by_their_rows(spark, tmp_path, monkeypatch):
    spark.range(600).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(checkpoints, "ROWS", 100, raising=False)
    out = QUERIES["strip_profiles"](spark, str(tmp_path))
    assert tasks(spark, out) == 7 and out.where("state = 'UNIQUE'").count() == 400


def test_expressions_are_dealt_to_tasks_by_their_rows(spark, tmp_path, monkeypatch):
    spark.range(600).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(checkpoints, "ROWS", 100, raising=False)
    out = QUERIES["safe_arithmetic"](spark, str(tmp_path))
    assert tasks(spark, out) == 7 and sorted(r["derived"] for r in out.collect()) == sorted(2.0 * (i % 50) - 1 for i in range(600))


def test_assignments_of_whole_scopes_are_those_of_the_graph(spark):
    rng = random.Random(9)
    pairs = [(s, a, b) for s in (1, 2, None) for a in range(60) for b in range(60) if rng.random() < 0.018]
    pairs += pairs[:20] + [(3, 5, 5), (3, 6, None), (4, 1, 1), (4, 1, 2), (4, 2, 1), (4, 2, 2)]
    df = spark.createDataFrame(pairs, "s int, l int, r int")
    listed = lambda out: sorted(map(str, out.collect()))
    found = sequential.unique_assignment(df, "s", "l", "r")
    assert not joins(found)
    assert len(listed(found)) == 40 and len({r["state"] for r in found.collect()}) >= 3
    assert listed(found) == listed(sequential.unique_assignment(df, "s", "l", "r", whole=0)) == listed(sequential.unique_assignment(df, "s", "l", "r", whole=30))
    plan = QUERIES["viewport_matching"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
