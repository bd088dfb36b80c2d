"""Drawings in their own encoding and in space: line ends, code pages, extrusion, arrays."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.plans.queries import QUERIES
from tallyforge.sources import drawings


def dxf(*pairs, head=(), codec="utf-8", end="\n"):
    pairs = [*head, 0, "SECTION", 2, "ENTITIES", *pairs, 0, "ENDSEC", 0, "EOF"]
    return end.join(map(str, pairs)).encode(codec)


def header(version, page):
    return (0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, version, 9, "$DWGCODEPAGE", 3, page, 0, "ENDSEC")


def texts(*values):
    return [x for k, v in enumerate(values) for x in (0, "TEXT", 5, f"T{k}", 1, v, 10, k, 20, 2 * k)]


def read(spark, content, depth=12):
    files = spark.createDataFrame([("f", bytearray(content)), ("none", None)], "path string, content binary")
    return drawings.drawing_entities(files, depth).collect()


@pytest.mark.parametrize("sign", [" ", " ", "\x85", "\x0c", "\x0b", "\x1c", "\x1e"])
def test_only_line_feeds_end_lines(spark, sign):
    rows = read(spark, dxf(*texts(f"one{sign}two", "second", "third")))
    assert sorted((r["handle"], r["text"], r["x"], r["y"]) for r in rows) == [("T0", f"one{sign}two", 0.0, 0.0), ("T1", "second", 1.0, 2.0), ("T2", "third", 2.0, 4.0)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends(spark, end):
    assert [r["text"] for r in read(spark, dxf(*texts("a"), end=end))] == ["a"]


def test_code_pages():
    chinese, french, japanese, polish = "不锈钢板 MT-01", "pièce", "図面", "żółw"
    for version, page, codec, text in (("AC1015", "ANSI_936", "gbk", chinese), ("AC1018", "ANSI_1252", "cp1252", french), ("AC1015", "ANSI_932", "cp932", japanese), ("AC1015", "ANSI_1250", "cp1250", polish), ("AC1009", "DOS850", "cp850", french), ("AC1027", "ANSI_936", "utf-8", chinese)):
        found = [v for c, v in drawings._pairs(dxf(*texts(text), head=header(version, page), codec=codec, end="\r\n")) if c == 1]
        assert found[-1] == text
    assert [v for c, v in drawings._pairs(b"\xef\xbb\xbf" + dxf(*texts(chinese))) if c == 1] == [chinese]
    assert [v for c, v in drawings._pairs(dxf(*texts("\\U+4E0D x"), head=header("AC1015", "ANSI_1252"))) if c == 1][-1] == "不 x"
    assert drawings.encoding(dxf(head=header("AC1015", "odd"))) == "cp1252" and drawings.encoding(b"") == "utf-8"


BLOCK = (0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "B", 10, 1, 20, 0, 0, "LINE", 5, "L", 10, 1, 20, 0, 11, 3, 21, 1, 0, "ENDBLK", 0, "ENDSEC")


def test_mirrored_and_tilted_planes(spark):
    mirrored = (0, "INSERT", 5, "M", 2, "B", 10, 10, 20, 5, 210, 0, 220, 0, 230, -1)
    circle = (0, "CIRCLE", 5, "C", 10, 4, 20, 6, 40, 1, 210, 0, 220, 0, 230, -1)
    line = (0, "LINE", 5, "W", 10, 4, 20, 6, 11, 5, 21, 6, 210, 0, 220, 0, 230, -1)
    tilted = (0, "TEXT", 5, "X", 1, "t", 10, 2, 20, 3, 30, 4, 210, 1, 220, 0, 230, 0)
    rows = {r["handle"]: r for r in read(spark, dxf(*mirrored, *circle, *line, *tilted, head=BLOCK))}
    assert (rows["M"]["x"], rows["M"]["y"]) == (-10.0, 5.0)
    # the block's line from its base point to (2, 1) behind it, mirrored in x
    assert (rows["M/L"]["x0"], rows["M/L"]["y0"], rows["M/L"]["x1"], rows["M/L"]["y1"]) == pytest.approx((-12, 5, -10, 6))
    assert (rows["C"]["x0"], rows["C"]["x1"], rows["C"]["y0"]) == (-5.0, -3.0, 5.0)
    assert rows["W"]["x"] == 4.0  # a line's ends stand in the drawing's own space
    assert (rows["X"]["x"], rows["X"]["y"]) == pytest.approx((4, 2))  # the plane's x axis is the drawing's y, its normal the x


def test_arrays_of_inserts(spark):
    array = (0, "INSERT", 5, "A", 2, "B", 10, 100, 20, 0, 41, 2, 42, 2, 50, 90, 70, 3, 71, 2, 44, 10, 45, 7)
    rows = read(spark, dxf(*array, head=BLOCK))
    got = sorted((r["handle"], round(r["x"], 6), round(r["y"], 6)) for r in rows if r["kind"] == "LINE")
    # steps aren't scaled, but turned: columns go up, rows to the left
    assert got == sorted((f"A[{c},{k}]/L", 100.0 - 7 * k, 10.0 * c) for c in range(3) for k in range(2))
    assert not any(r["truncated"] for r in rows)


def test_deep_nesting(spark):
    blocks = [0, "SECTION", 2, "BLOCKS"]
    for k in range(6):
        blocks += [0, "BLOCK", 2, f"B{k}", 10, 0, 20, 0, *((0, "INSERT", 5, f"I{k}", 2, f"B{k + 1}", 10, 1, 20, 0) if k < 5 else (0, "POINT", 5, "P", 10, 1, 20, 1)), 0, "ENDBLK"]
    content = dxf(0, "INSERT", 5, "S", 2, "B0", 10, 0, 20, 0, 42, -1, head=(*blocks, 0, "ENDSEC"))
    whole = read(spark, content)
    assert [(r["x"], r["y"], r["truncated"]) for r in whole if r["kind"] == "POINT"] == [(6.0, -1.0, False)]
    assert not any(r["kind"] == "POINT" for r in read(spark, content, 3)) and all(r["truncated"] for r in read(spark, content, 3))


def test_small_files_share_a_batch(spark):
    types = to_arrow_schema(T.StructType.fromDDL(drawings.RECORD))
    content = dxf(*texts("one", "two"), 0, "DIMENSION", 5, "D", 10, 1, 20, 3, 13, 1, 23, 1, 14, 11, 24, 1, 33, 5, 34, 6)
    given = [pa.RecordBatch.from_pylist([{"path": f"{b}/{k}", "content": content} for k in range(50)]) for b in range(2)]
    (out,) = drawings._read(iter(given), types)
    rows = out.to_pylist()
    assert [(r["path"], r["number"]) for r in rows] == [(f"{b}/{k}", n) for b in range(2) for k in range(50) for n in range(3)]
    assert all(r["points"] == [{"x": 1.0, "y": 3.0, "z": 0.0}] and r["style_points"] == [{"x": 1.0, "y": 1.0, "z": 5.0}, {"x": 11.0, "y": 1.0, "z": 6.0}] for r in rows[2::3])
    large = pa.RecordBatch.from_pylist([{"path": "l", "content": dxf(*texts(*"x" * drawings.BATCH))}])
    assert [b.num_rows for b in drawings._read(iter([large]), types)] == [drawings.BATCH // 2] * 2


def test_nested_arrays_and_missing_handles(spark):
    line = (0, "LINE", 5, "L", 10, 0, 20, 0, 11, 1, 21, 0)
    blocks = (0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "B", 10, 0, 20, 0, *line, 0, "POINT", 10, 1, 20, 1, 0, "LWPOLYLINE", 5, "P", *[x for k in range(6) for x in (10, k, 20, k * k)], 0, "ENDBLK")
    nested = (0, "BLOCK", 2, "N", 10, 1, 20, 0, 0, "INSERT", 5, "I", 2, "B", 10, 2, 20, 0, 70, 2, 44, 10, 0, "INSERT", 2, "B", 10, 0, 20, 5, 0, "INSERT", 5, "Q", 2, "none", 10, 0, 20, 0, 0, "ENDBLK", 0, "ENDSEC")
    inserts = (0, "INSERT", 5, "A", 2, "N", 10, 100, 20, 0, 0, "INSERT", 2, "N", 10, 0, 20, 100, 50, 90, 0, "INSERT", 5, "S", 2, "B", 10, -5, 20, 0, 41, 2)
    rows = read(spark, dxf(*inserts, head=(*blocks, *nested)))
    at = lambda kind: sorted((r["level"], r["handle"], round(r["x"], 6), round(r["y"], 6)) for r in rows if r["kind"] == kind)
    assert at("LINE") == sorted([(2, "A/I[0,0]/L", 101.0, 0.0), (2, "A/I[1,0]/L", 111.0, 0.0), (2, "A/L", 99.0, 5.0), (2, "I[0,0]/L", 0.0, 101.0), (2, "I[1,0]/L", 0.0, 111.0), (2, "L", -5.0, 99.0), (1, "S/L", -5.0, 0.0)])
    assert at("POINT")[0] == (1, "S", -3.0, 1.0) and len(at("POINT")) == 7
    (wide,) = [r for r in rows if r["handle"] == "S/P"]
    assert (wide["x0"], wide["x1"], wide["y0"], wide["y1"]) == (-5.0, 5.0, 0.0, 25.0)
    assert len([r for r in rows if r["text"] == "none"]) == 2


def test_filters_repeat_no_movement(spark):
    plan = QUERIES["region_probe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 2  # points and style_points, once each


def test_blocks_away_from_regions_are_left_out(spark):
    inner = (0, "LINE", 5, "L", 8, "wall", 10, 1, 20, 0, 11, 3, 21, 1, 0, "CIRCLE", 5, "C", 8, "round", 10, 2, 20, 2, 40, -5, 0, "LWPOLYLINE", 5, "P", 8, "path", *[x for k in range(6) for x in (10, k, 20, k * k)])
    nested = (0, "ENDBLK", 0, "BLOCK", 2, "N", 10, 2, 20, 1, 0, "INSERT", 5, "I", 8, "in", 2, "B", 10, 4, 20, -3, 41, -2, 50, 30, 0, "POINT", 5, "O", 8, "odd", 10, "nan", 20, 0, 0, "ENDBLK", 0, "ENDSEC")
    inserts = [x for k in range(60) for x in (0, "INSERT", 5, f"X{k}", 8, "view", 2, "BN"[k % 2], 10, 37 * k % 400, 20, 53 * k % 300, 41, k % 3 + 1, 42, -(k % 4) - 1, 50, 25 * k, 230, 1 - 2 * (k % 5 == 0))]
    content = bytearray(dxf(*inserts, head=(0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "B", 10, 1, 20, 0, *inner, *nested)))
    files = spark.createDataFrame([("f", content), ("g", content)], "path string, content binary")
    regions = spark.createDataFrame([(k, "f", 40.0 * k, 30.0 * k, 40.0 * k + 25, 30.0 * k + 20) for k in range(3)], "region int, path string, x0 double, y0 double, x1 double, y1 double")
    whole, near = drawings.drawing_entities(files).cache(), drawings.drawing_entities(files, regions=regions).cache()
    found = [sorted(map(tuple, drawings.probe_regions(df, regions, 50.0).collect())) for df in (whole, near)]
    assert found[0] == found[1] and all(n > 0 for _, n, _, _ in found[0])
    assert near.where("level > 0 and path = 'f'").count() < whole.where("level > 0 and path = 'f'").count() / 2 and near.where("level > 0 and path = 'g'").isEmpty()


def test_filters_repeat_no_boxes(spark):
    plan = QUERIES["region_probe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "array_m" in line for line in plan.split("\n"))


def test_stretches_cut_no_record(monkeypatch):
    content = dxf(*texts("one", "żółw", "\\U+4E0D"), 0, "LWPOLYLINE", *[x for k in range(40) for x in (10, k, 20, 2 * k)], end="\r\n")
    whole = list(drawings._records("f", content))
    assert len(whole) == 4 and whole[3][1] == 40 and [r[7] for r, _ in whole[:3]] == ["one", "żółw", "不"]
    for size in (1, 7, 40):
        monkeypatch.setattr(drawings, "CHUNK", size)
        assert list(drawings._records("f", content)) == whole
