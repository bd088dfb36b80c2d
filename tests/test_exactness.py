"""Exact matching, frames, ids and blocked joins against brute force, on cases where shortcuts go wrong."""

import hashlib
import itertools
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import evidence, geometry, graphs, matching, sequential, spatial
from tallyforge.sources import workbooks


def complete(lefts, rights, allowed):
    return [p for p in itertools.permutations(rights) if all(x in allowed for x in zip(lefts, p))]


def test_staircase_has_one_assignment(spark):
    pairs = [("s", i, j) for i in range(9) for j in range(9) if j in (i, i + 1)] + [("s", 100, 100), ("s", 100, 101), ("s", 101, 100), ("s", 101, 101)]
    out = sequential.unique_assignment(spark.createDataFrame(pairs, "s string, l int, r int"), "s", "l", "r").collect()
    assert sorted((r["l"], r["r"]) for r in out if r["state"] == "unique") == [(i, i) for i in range(9)]  # the other component doesn't spoil it
    assert [(r["component"], r["l"]) for r in out if r["state"] == "ambiguous"] == [(100, None)]


def test_assignments_equal_all_permutations(spark):
    rng = random.Random(5)
    rows = []
    for s in range(120):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        rows += [(s, 10 * s + a, 10 * s + b) for a in range(n) for b in range(m) if rng.random() < 0.45]
    rows += [(500, 5001, 5001), (500, 5002, 5001), (500, 5003, 5001), (500, 5003, 5002), (500, 5003, 5003)]  # equal sides, and no assignment
    want = {}
    for s in [*range(120), 500]:
        mine = {(a, b) for x, a, b in rows if x == s}
        while mine:
            part, size = {next(iter(mine))}, 0
            while size != len(part):
                size = len(part)
                part |= {p for p in mine if any(p[0] == q[0] or p[1] == q[1] for q in part)}
            mine -= part
            lefts, rights = sorted({a for a, _ in part}), sorted({b for _, b in part})
            found = complete(lefts, rights, part) if len(lefts) == len(rights) else None
            state = "unequal" if found is None else {0: "none", 1: "unique"}.get(len(found), "ambiguous")
            want[lefts[0]] = (state, sorted(zip(lefts, found[0])) if state == "unique" else [])
    got = {}
    for r in sequential.unique_assignment(spark.createDataFrame(rows + rows[:50] + [(1, None, 3)], "s int, l int, r int"), "s", "l", "r").collect():
        state, pairs = got.setdefault(r["component"], (r["state"], []))
        if r["l"] is not None:
            pairs.append((r["l"], r["r"]))
    assert {k: (s, sorted(p)) for k, (s, p) in got.items()} == want
    assert {s for s, _ in want.values()} == {"unequal", "none", "unique", "ambiguous"}


def test_frames_within_tolerance(spark):
    rng = random.Random(8)
    lines, want = [], 0
    for k in range(60):
        x, y, w, h = k * 100.0, rng.uniform(0, 50), rng.uniform(5, 40), rng.uniform(5, 40)
        off = lambda: rng.uniform(-0.24, 0.24)
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        for i in range(4):
            (a, b), (c, d) = corners[i], corners[(i + 1) % 4]
            lines.append(("s", 10 * k + i, a + off(), b + off(), c + off(), d + off()))
        want += 1
    lines += [("s", 5000, 0.0, 500.0, 10.0, 500.0), ("s", 5001, 0.0, 500.0, 0.0, 510.0), ("s", 5002, 10.8, 500.0, 10.8, 510.0), ("s", 5003, 0.0, 510.0, 10.0, 510.0)]  # 0.8 is too far
    lines += [("s", 6000, 0.0, 600.0, 10.26, 600.0), ("s", 6001, 0.0, 600.0, 0.0, 610.0), ("s", 6002, 10.0, 600.0, 10.0, 610.0), ("s", 6003, 0.0, 610.0, 10.0, 610.0)]  # 0.26 isn't
    out = geometry.rectangles(spark.createDataFrame(lines, "s string, id long, x0 double, y0 double, x1 double, y1 double"), ["s"]).collect()
    assert len(out) == want + 1 and [r["bottom"] for r in out if r["bottom"] >= 5000] == [6000]


def test_paths_meet_within_tolerance(spark):
    segments = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.4999999999, 0.0), ("s", 2, 0.5000000001, 0.0, 1.0, 0.0), ("s", 3, 1.0, 0.01, 2.0, 0.0)], "s string, seg_id int, sx double, sy double, tx double, ty double")
    starts = spark.createDataFrame([("s", 1, 0.0, 0.0)], "s string, start_id int, x double, y double")
    assert [(r["length"], r["reason"], r["path"]) for r in geometry.trace_paths(segments, starts, "s").collect()] == [(2, "end", "1,2")]


def test_ids_are_those_of_canonical_json(spark):
    values = ["plain", 'a "b" c', "back\\slash", "new\nline\ttab\r", "\x00\x01\x1f\x7f", "\b\f", "材料 \u2028", None, "", '\\"', "\\u000b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = {r["i"]: r["id"] for r in df.select("i", text.content_id("p", {"b": F.col("v"), "a": F.lit("x"), 'q"': F.lit("y")}).alias("id")).collect()}
    for i, v in enumerate(values):
        canonical = json.dumps({"b": v, "a": "x", 'q"': "y"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert out[i] == "p:" + hashlib.sha256(canonical.encode()).hexdigest()[:24], repr(v)


def test_round_robin_holds_few_rows(spark):
    rng = random.Random(4)
    rows = [("s", p, rng.randrange(300), i) for p in "abc" for i in range(2000)]
    rows = list({(s, p, i): (s, p, i, o) for s, p, i, o in rows}.values())
    out = sequential.round_robin(spark.createDataFrame(rows, "s string, pool string, item int, o int"), "s", "pool", "item", "o", 40).orderBy("turn").collect()
    queues = {p: [i for _, q, i, _ in sorted(rows, key=lambda r: (r[3], r[2])) if q == p] for p in "abc"}
    seen, want = set(), []
    while len(want) < 40:
        for p in "abc":
            item = next(i for i in queues[p] if i not in seen)
            if len(want) < 40:
                seen.add(item)
                want.append((p, item))
    assert [(r["pool"], r["item"]) for r in out] == want


@pytest.mark.parametrize("hub", [5, 100_000])
def test_components_of_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graphs, "HUB", hub)
    edges = [(0, i) for i in range(1, 80)] + [(i, i + 1000) for i in range(1, 80)] + [(5000 + i, 6000) for i in range(60)] + [(7000, 7001)]
    roots = {r["node"]: r["root"] for r in graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == roots[i + 1000] == 0 for i in range(1, 80)) and roots[6000] == roots[5059] == 5000 and roots[7001] == 7000


def test_blocked_joins_equal_all_pairs(spark):
    rng = random.Random(6)
    spans = [("s", i, rng.uniform(-900, 900), a := rng.uniform(-3000, 2000), a + rng.choice([0.0, 10.0, rng.uniform(0, 3000)])) for i in range(150)]
    views = [("s", x := rng.uniform(-3000, 3000), x + rng.uniform(10, 1500), y := rng.uniform(-900, 500), y + rng.uniform(10, 900)) for _ in range(60)]
    got = {r["span_id"]: r["state"] for r in geometry.covered_spans(spark.createDataFrame(spans, "s string, span_id int, y double, a double, b double"), spark.createDataFrame(views, "s string, x0 double, x1 double, y0 double, y1 double"), ["s"], cell=170.0).collect()}
    for _, i, y, a, b in spans:
        met = sorted((x0, x1) for _, x0, x1, y0, y1 in views if y0 <= y <= y1 and x1 >= a and x0 <= b)
        reach, gap = None, False
        for x0, x1 in met:
            gap |= reach is not None and x0 > reach + 1e-6
            reach = x1 if reach is None else max(reach, x1)
        want = "outside" if not met or min(x for x, _ in met) > a or reach < b else "gap" if gap else "covered"
        assert got[i] == want

    orphans = [(i, "s", rng.uniform(0, 9000), rng.uniform(-40000, 40000), rng.choice([10.0, 4000.0, 9000.0])) for i in range(100)]
    frames = [(i, "s", f"c{i}", rng.uniform(0, 9000), rng.uniform(-40000, 40000)) for i in range(40)]
    got = {r["id"]: r["frame_id"] for r in spatial.inherited_code(spark.createDataFrame(orphans, "id int, s string, x double, y double, h double"), spark.createDataFrame(frames, "frame_id int, s string, code string, fx double, fy double"), ["s"]).collect()}
    for i, _, x, y, h in orphans:
        near = [(abs(y - fy), abs(x - fx), f) for f, _, _, fx, fy in frames if abs(y - fy) <= max(5000.0, 2 * h)]
        assert got[i] == (min(near)[2] if near else None)

    points = [(i, "s", rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(100)]
    boxes = [(i, "s", x := rng.uniform(-100, 2500), x + rng.uniform(1, 900), y := rng.uniform(-100, 2500), y + rng.uniform(1, 900)) for i in range(40)]
    got = {r["point_id"]: r["views"] for r in evidence.owned_points(spark.createDataFrame(points, "point_id int, s string, x double, y double"), spark.createDataFrame(boxes, "view_id int, s string, x0 double, x1 double, y0 double, y1 double"), ["s"], cell=333.0).collect()}
    for i, _, x, y in points:
        assert sorted(filter(None, got[i].split(","))) == sorted(str(v) for v, _, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)

    texts = [(i, "s", rng.uniform(0, 500), rng.uniform(0, 60), rng.uniform(1, 4), f"MT-{i}" if i % 6 == 0 else "x") for i in range(120)]
    got = {r["id"]: r["seed"] for r in workbooks.row_associations(spark.createDataFrame(texts, "id int, s string, x double, y double, h double, text string"), ["s"], "^MT-").collect()}
    heights = sorted(t[4] for t in texts)
    median = (heights[59] + heights[60]) / 2
    for i, _, x, y, h, _ in texts:
        near = [(x - u, j) for j, _, u, v, g, t in texts if t != "x" and x > u and abs(y - v) <= max(0.5, min(2 * median, 2.5 * g))]
        assert got.get(i) == (min(near)[1] if near else None)


def test_dimensions_equal_all_pairs(spark):
    rng = random.Random(9)
    at = lambda: float(rng.choice([0, 1, 2, 3, 7]))
    segs = [("s", i, at(), at(), at(), at()) for i in range(40)]
    dims = [("s", i, at(), at(), at(), at(), float(rng.randint(1, 4))) for i in range(60)] + [("s", 100, segs[0][2] + 9e-7, segs[0][3], segs[0][4], segs[0][5] - 9e-7, 1.0)]
    got = {r["dim_id"]: (r["rank"], r["state"], r["seg_id"]) for r in geometry.bind_dimensions(spark.createDataFrame(dims, "s string, dim_id int, ax double, ay double, bx double, by double, value double"), spark.createDataFrame(segs, "s string, seg_id int, sx double, sy double, tx double, ty double"), ["s"]).collect()}
    near = lambda p, q: abs(p - q) <= 1e-6
    want = {}
    for _, d, ax, ay, bx, by, value in dims:
        ranks = {1: [], 2: []}
        for _, g, sx, sy, tx, ty in segs:
            ends = [(sx, sy), (tx, ty)]
            if any(near(ax, p[0]) and near(ay, p[1]) and near(bx, q[0]) and near(by, q[1]) for p, q in (ends, ends[::-1])):
                ranks[1].append(g)
            elif near(sy, ty) and near(min(ax, bx), min(sx, tx)) and near(max(ax, bx), max(sx, tx)) or near(sx, tx) and near(min(ay, by), min(sy, ty)) and near(max(ay, by), max(sy, ty)):
                ranks[2].append(g)
        for rank, found in ranks.items():
            if found:
                _, _, sx, sy, tx, ty = segs[min(found)]
                length = ((sx - tx) ** 2 + (sy - ty) ** 2) ** 0.5
                want[d] = (rank, "ambiguous", None) if len(found) > 1 else (rank, "conflict" if abs(length - value) > 0.5 else "bound", found[0])
                break
    assert got == want


def test_ambiguous_top2_rounds_as_its_sql(spark, tmp_path):
    """scores of values such as 28.5 / 100 are rounded as doubles, not by their decimal text."""
    rows = [(2 * n + i, n, "a", v) for n, (v, d) in enumerate((v, d) for v in (28.5, 57.5, 102.5, 103.5, 125.5) for d in range(10, 15)) for i, v in enumerate((v, v - d - 0.2))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    from tallyforge.plans.queries import QUERIES, SQL

    got = {tuple(r) for r in QUERIES["ambiguous_top2"](spark, str(tmp_path)).select("user_id", "event_type", "chosen", "ambiguous").collect()}
    with duckdb.connect() as c:
        c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        assert got == set(c.execute(SQL["ambiguous_top2"]).fetchall())


def test_anchor_matches_equal_listed_pairs(spark):
    """matches by counts are those of the listed pairs, whatever the bound; equal rows wait for ever."""
    rng = random.Random(3)
    some = lambda k: rng.choice([None, *"abcd"[:k]])
    side = lambda n, sign: [(sign * i, rng.choice(["m", "n", None]), some(4), some(4), some(3), some(2)) for i in range(1, n)]
    anchors = ["p", "q", "u", "v"]
    kinds = ", mt string, p string, q string, u string, v string"
    for n in (30,):
        left, right = spark.createDataFrame(side(n, 1), "l long" + kinds), spark.createDataFrame(side(n, -1), "r long" + kinds)
        pairs = matching.anchor_pairs(left, right, "mt", anchors)
        want = {(x["l"], x["r"]) for x in matching.mutual_best(pairs).collect()}
        for listed in (0, 8):
            assert {tuple(x) for x in matching.anchor_matches(left, right, "mt", anchors, listed=listed).collect()} == want
        assert want


def test_scopes_in_order_are_streamed(spark):
    """scopes that go on over Arrow batches, null ones too, are whole; no Python call a scope."""
    rows = spark.createDataFrame([(k, float(v), i) for i, (k, v) in enumerate((k, v) for k in (None, 1, 2) for v in (0, 1, 2, 10, 11, 30))], "k int, v double, h int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = sequential.cluster_values(rows, ["k"], "v", "h")
        assert "InPandas" not in out._jdf.queryExecution().toString()
        assert sorted(map(tuple, out.where("k is null").collect()), key=lambda r: r[1]) == [(None, 0, 1.0, 3, True), (None, 1, 10.5, 2, True), (None, 2, 30.0, 1, False)]
        assert out.count() == 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_boxes_meet_as_one(spark):
    """Rows with equal boxes don't multiply the join of leaders or spans; borders are counted and named each."""
    borders = spark.createDataFrame([(1, i, 0.0, 0.0, 4.0, 4.0) for i in range(50)] + [(1, 7, 0.0, 0.0, 4.0, 2.0), (1, 60, 4.0, 0.0, 8.0, 4.0)], "s int, border_id int, x0 double, y0 double, x1 double, y1 double")
    leaders = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 1, 0.0, 3.0), (1, 2, 4.0, 4.0), (1, 3, 2.0, 2.0), (1, 4, 8.0, 1.0)], "s int, leader_id int, x double, y double")
    got = {}
    for r in geometry.border_leaders(leaders, borders, ["s"]).collect():
        got.setdefault((r["leader_id"], r["borders"], r["state"]), []).append(r["border_id"])
    every = [*range(50)]
    assert {k: sorted(v) for k, v in got.items()} == {(1, 50, "ambiguous"): every, (2, 51, "ambiguous"): [*every, 60], (3, 1, "branch"): [7], (4, 1, "branch"): [60]}
    out = geometry.covered_spans(spark.createDataFrame([(1, 1, 1.0, 0.0, 8.0)], "s int, span_id int, y double, a double, b double"), borders, ["s"])
    assert [r["state"] for r in out.collect()] == ["covered"]
