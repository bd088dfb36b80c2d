"""Chains of views, closed outlines, strips rebuilt with mitred corners."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions.polygons import crosses_itself, difference_area, mitred, polygon_area
from tallyforge.operators import evidence, viewports

VIEW = "sheet long, view_id long, scale double, x0 double, y0 double, x1 double, y1 double, mx0 double, my0 double, mx1 double, my1 double"


def plain_edge(a, b, ratio=0.06):
    """The rule for two views, written out."""
    if not math.isclose(a["scale"], b["scale"], rel_tol=1e-7):
        return None
    for axis, along, across in (("x", "x", "y"), ("y", "y", "x")):
        p, q = sorted((a, b), key=lambda v: v[along + "0"])
        edge = min(p[across + "1"] - p[across + "0"], q[across + "1"] - q[across + "0"])
        eps = max(1e-6, edge * 1e-7)
        gap, model_gap = q[along + "0"] - p[along + "1"], q[f"m{along}0"] - p[f"m{along}1"]
        level = all(abs(p[across + k] - q[across + k]) <= eps and abs(p[f"m{across}{k}"] - q[f"m{across}{k}"]) <= eps / p["scale"] for k in "01")
        if eps < gap <= ratio * edge and level and model_gap > eps / p["scale"]:
            return p["view_id"], q["view_id"], axis
    return None


def test_chains_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for sheet in range(12):
        for k in range(30):
            col, row, big = rng.randrange(6), rng.randrange(3), rng.choice([1, 1, 2, 0.25])
            w, h, gap = 100 * big, 64 * big, rng.choice([3.8, 3.85, 0.5, 5, 1e-9]) * big
            x0, y0 = col * (w + gap) - 200, row * (h + gap) - 64
            scale = rng.choice([0.1, 0.1, 0.2])
            mx, my = col * rng.choice([1500, 1500, 900]) * big, row * 900 * big
            rows.append((sheet, sheet * 100 + k, scale, *map(float, (x0, y0 + rng.choice([0, 0, 1e-7, 1e-3]), x0 + w, y0 + h, float(mx), float(my), mx + 1000.0 * big, my + 640.0 * big))))
    views = spark.createDataFrame(rows + [(1, 999, 0.1, 5.0, 5.0, 5.0, 6.0, 0.0, 0.0, 1.0, 1.0), (None, 998, 0.1, None, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0)], VIEW)
    data = [r.asDict() for r in spark.createDataFrame(rows, VIEW).collect()]
    want = {e for a, b in itertools.combinations(data, 2) if a["sheet"] == b["sheet"] and (e := plain_edge(a, b))}
    got = viewports.fragment_edges(views, "sheet").collect()
    assert {(r["first"], r["second"], r["axis"]) for r in got} == want
    assert len(got) == len(want) > 15
    root = {r["view_id"]: r["view_id"] for r in data}
    for _ in range(40):
        for a, b, _axis in want:
            root[a] = root[b] = min(root[a], root[b])
    chains = {r["view_id"]: r for r in viewports.view_chains(views, "sheet").collect()}
    assert {i: chains[i]["chain"] for i in root} == root and chains[999]["chain"] == 999
    for i, r in root.items():
        members = [d for d in data if root[d["view_id"]] == r]
        assert chains[i]["parts"] == len(members) and chains[i]["x1"] == max(d["x1"] for d in members) and chains[i]["y0"] == min(d["y0"] for d in members)


def test_titles_of_chains(spark):
    views = spark.createDataFrame([(1, 10, 0.1, 0.0, 0.0, 100.0, 80.0, 0.0, 0.0, 1000.0, 800.0), (1, 11, 0.1, 104.0, 0.0, 204.0, 80.0, 1500.0, 0.0, 2500.0, 800.0), (1, 20, 0.1, 1000.0, 0.0, 1100.0, 80.0, 0.0, 0.0, 1000.0, 800.0)], VIEW)
    pts = lambda *xs: [{"x": x, "y": y} for x, y in xs]
    titles = spark.createDataFrame([(1, 1, pts((100.0, -20.0), (150.0, -20.0))), (1, 2, pts((1110.0, 5.0))), (1, 3, pts((500.0, -20.0))), (1, 4, [])], "sheet long, title_id long, points array<struct<x:double,y:double>>")
    found = {(r["chain"], r["title_id"], r["place"]) for r in viewports.chain_titles(viewports.view_chains(views, "sheet"), titles, "sheet").collect()}
    assert found == {(10, 1, "below"), (20, 2, "bottom_right")}
    assert {(r["chain"], r["title_id"], r["state"]) for r in viewports.titled_chains(views, titles, "sheet").collect()} == {(10, 1, "unique"), (20, 2, "unique")}
    two = titles.unionByName(titles.where("title_id = 1").withColumn("title_id", F.lit(5).cast("long")))
    assert {(r["component"], r["state"]) for r in viewports.titled_chains(views, two, "sheet").collect()} == {(10, "unequal"), (20, "unique")}


def square(x, y, w, h, first):
    c = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return [(first + k, *map(float, c[k]), *map(float, c[(k + 1) % 4])) for k in range(4)]


def test_faces_of_nested_and_touching_outlines(spark):
    rows = square(0, 0, 10, 10, 0) + square(2, 2, 3, 3, 10) + square(10, 10, 4, 4, 20)  # nested, and touching in a corner
    rows += square(100, 0, 6, 4, 30)[:3] + [(34, 100.0, 4.0, 100.0, 0.0), (35, 103.0, 0.0, 103.0, 4.0)]
    rows = [r for r in rows if r[0] not in (30, 32)] + [(40, 100.0, 0.0, 103.0, 0.0), (41, 103.0, 0.0, 106.0, 0.0), (42, 106.0, 4.0, 103.0, 4.0), (43, 103.0, 4.0, 100.0, 4.0)]  # two that share a wall
    rows += [(50, 5.0, 0.0, 5.0, -3.0), (60, 0.0, 0.0, 0.0, 0.0), (61, 2.0, 2.0, 5.0, 2.0), (62, 10.0, 10.0, 9.0, 9.0)]  # dangling, without length, repeated, dangling inside
    segments = spark.createDataFrame([(1, *r) for r in rows] + [(2, *r) for r in square(0, 0, 1, 1, 0)], "sheet long, segment_id long, x0 double, y0 double, x1 double, y1 double")
    out = viewports.closed_outlines(viewports.outline_faces(segments, "sheet"), "sheet").collect()
    assert sorted((r["sheet"], round(r["area"], 6), r["sides"], r["open_sides"]) for r in out) == [(1, 9.0, 4, 0), (1, 12.0, 4, 0), (1, 12.0, 4, 0), (1, 16.0, 4, 0), (1, 100.0, 6, 2), (2, 1.0, 4, 0)]
    for r in out:
        assert abs(polygon_area([(p["x"], p["y"]) for p in r["points"]]) - r["area"]) < 1e-6


def test_truncation_takes_selections_back(spark):
    strip = [(0, 0), (50, 0), (50, 30), (48, 30), (48, 2), (0, 2)]
    sides = [(k, *map(float, strip[k]), *map(float, strip[(k + 1) % 6])) for k in range(6)]
    many = [(100 + k, 200 + 20 * math.cos(k * math.pi / 10), 20 * math.sin(k * math.pi / 10), 200 + 20 * math.cos((k + 1) * math.pi / 10), 20 * math.sin((k + 1) * math.pi / 10)) for k in range(20)]
    segments = spark.createDataFrame([(1, *r) for r in sides] + [(2, *r) for r in sides + many], "sheet long, segment_id long, x0 double, y0 double, x1 double, y1 double")
    contacts = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "c", 105), (1, "d", 77)], "sheet long, branch string, segment_id long")
    wide = {r["branch"]: (r["state"], r["thickness"]) for r in viewports.probe_profiles(segments, contacts, "sheet", "branch").collect()}
    assert wide["a"][0] == wide["b"][0] == "selected" and abs(wide["b"][1] - 2) < 1e-6 and wide["c"][0] == "none" and wide["d"][0] == "none"
    few = {r["branch"]: r["state"] for r in viewports.probe_profiles(segments, contacts, "sheet", "branch", most=12).collect()}
    assert few == {"a": "selected", "b": "truncated", "c": "truncated", "d": "none"}


def test_strips_are_built_anew():
    path = [(0.0, 0.0), (40.0, 0.0), (40.0, 25.0), (70.0, 55.0)]
    outline = mitred(path, 1.5)
    assert abs(polygon_area(outline) - 3 * sum(math.dist(a, b) for a, b in zip(path, path[1:]))) < 1e-9
    assert mitred([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], 1.0) is None and mitred([(0.0, 0.0), (0.0, 0.0)], 1.0) is None
    assert crosses_itself([(0, 0), (10, 0), (10, 10), (5, -5)]) and not crosses_itself(path) and crosses_itself([(0, 0), (5, 0), (2, 0)])


def test_difference_area_equals_a_raster():
    rng = random.Random(3)
    assert difference_area([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 1), (6, 1), (6, 3), (2, 3)]) == 16 + 8 - 2 * 4
    assert difference_area([(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 2), (0, 2), (0, 0), (2, 0)]) == 0
    grid = (np.arange(600) + 0.5) / 60
    for _ in range(20):
        star = lambda: [(5 + r * math.cos(a), 5 + r * math.sin(a)) for a, r in zip(sorted(rng.uniform(0, 2 * math.pi) for _ in range(9)), (rng.uniform(1, 5) for _ in range(9)))]
        one, two = star(), star()

        def inside(p):
            hit = np.zeros((600, 600), bool)
            for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]):
                spans = (y0 > grid) != (y1 > grid)
                x = x0 + (grid - y0) * (x1 - x0) / (y1 - y0 or 1)
                hit ^= spans[:, None] & (grid[None, :] < x[:, None])
            return hit

        assert abs(difference_area(one, two) - (inside(one) ^ inside(two)).sum() / 3600) < 0.2


def test_outlines_that_are_no_strips(spark):
    good = mitred([(0.0, 0.0), (40.0, 0.0), (40.0, 25.0)], 1.0)
    rows = [(1, good), (2, [(0, 0), (40, 0), (40, 25), (0, 25)]), (3, [(0, 0), (10, 0), (10, 1), (6, 1), (6, 0.5), (5, 0.5), (5, 1), (0, 1)]), (4, None), (5, good[::-1]), (6, good[2:] + good[:2])]
    df = spark.createDataFrame([(i, None if p is None else [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in rows], "id long, points array<struct<x:double,y:double>>")
    out = {r["id"]: r["s"] for r in df.select("id", evidence.strip_profile("points").alias("s")).collect()}
    assert out[1]["state"] == out[5]["state"] == out[6]["state"] == "UNIQUE" and abs(out[1]["thickness"] - 2) < 1e-9 and abs(out[1]["centre_length"] - 65) < 1e-6
    assert [out[i]["state"] for i in (3, 4)] == ["NONE", "NONE"]


def test_faces_of_whole_scopes_equal_those_of_the_graph(spark):
    """faces found scope by scope are those of the components, and no join broadcasts the sides."""
    lines = [(s, 10 * s + i, *xy) for s in range(3) for i, xy in enumerate([(0, 0, 4, 0), (4, 0, 4, 3), (4, 3, 0, 3), (0, 3, 0, 0), (2, 0, 2, 3), (1, 1, 2, 2), (9, 9, 8 + s, 8)])]
    segments = spark.createDataFrame([(s, i, *map(float, xy)) for s, i, *xy in lines], "s int, segment_id int, x0 double, y0 double, x1 double, y1 double")
    rows = [sorted(map(tuple, viewports.outline_faces(segments, "s", whole=whole).select("s", "segment_id", "forward", "face", "other", "side", "twin", "after", "ax", "by").collect())) for whole in (0, 50_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 42


def test_chains_of_whole_sheets_are_those_of_the_graph(spark):
    rng = random.Random(5)
    rows = []
    for k in range(600):
        x, y, scale = rng.randrange(6) * 104.0, rng.randrange(6) * 83.0, rng.choice((0.1, 0.1, 0.2))
        jitter = rng.choice((0.0, 0.0, 4e-6, 1.0))
        mx, my = x * 15, y * 11
        rows.append((k % 7, k if k % 50 else k + 1, scale, x + jitter, y, x + 100.0, y + 80.0, mx, my, mx + 1000.0, my + 800.0))
    rows += [(1, 1000, 0.1, None, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0), (2, 1001, 0.1, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 1.0, 1.0), (None, 1002, 0.1, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0), (3, 1003, 0.1, float("nan"), 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0)]
    views = spark.createDataFrame(rows, "sheet long, view_id long, scale double, x0 double, y0 double, x1 double, y1 double, mx0 double, my0 double, mx1 double, my1 double")
    many = viewports.view_chains(views, "sheet")
    assert "FlatMapGroupsInPandas" in many._jdf.queryExecution().executedPlan().toString()
    listed = lambda df: sorted(map(str, df.collect()))
    found = listed(many)
    assert found == listed(viewports.view_chains(views, "sheet", whole=0))
    assert len(found) == 603 and max(r["parts"] for r in many.collect()) > 5
