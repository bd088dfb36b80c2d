"""Operators and functions that SQL can't express, against plain versions, and their edge cases."""

import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import boxes, numeric, text
from tallyforge.operators import assembly, catalog, geometry, graphs, matching, pricing, ranking, rules, sequential, spatial
from tallyforge.sources import drawings, files, sinks, workbooks


def values(spark, column, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


# ---- text


def test_text_keys(spark):
    rows = [("ＭＴ–01  a",), (" Straße ",), (None,)]
    assert values(spark, text.plain_text("t"), rows, "t string") == ["MT-01 a", "Straße", None]
    assert values(spark, text.folded_text("t"), rows, "t string") == ["mt-01 a", "strasse", None]
    assert values(spark, text.match_key("t"), rows, "t string") == ["mt-01a", "strasse", None]


def test_codes_and_ranges(spark):
    rows = [("MT 1, GC-SS-007 mt01; XMT-5 MT-123",), ("none",), (None,)]
    assert values(spark, text.material_codes(F.col("t"), ["MT", "GC-SS"]), rows, "t string") == [["MT-01", "GC-SS-007", "MT-123"], [], None]
    rows = [("A-08~A-11",), ("A-08~B-11",), ("A-09~07",), ("1~3",), ("A-12",), ("A-1~A-900",), ("x y",)]
    assert values(spark, text.expand_range(F.col("t")), rows, "t string") == [["A-08", "A-09", "A-10", "A-11"], None, None, ["1", "2", "3"], ["A-12"], None, None]


def test_markup_tokens_and_titles(spark):
    assert values(spark, text.clean_markup(F.col("t")), [("{\\fArial|b0;Steel\\P1\\S1#2; plate}",)], "t string") == ["Steel 1 1/2 plate".replace("1 1/2", "11/2")]
    assert values(spark, text.tokens(F.col("t")), [(" A-1 b ",)], "t string") == [["1", "a", "a-1 b", "b"]]
    assert values(spark, text.row_variant(F.col("t")), [("Panel 12-b",), ("Panel",)], "t string") == [("Panel 12", "B"), ("Panel", None)]
    assert values(spark, text.bigrams(F.col("t")), [("abab",), ("x",), (None,)], "t string") == [["ab", "ba"], ["x"], None]
    assert values(spark, text.code_key(F.col("t")), [("a-1/b",), ("abc",), ("12",)], "t string") == ["A1B", None, None]
    assert values(spark, text.key_list(F.col("t")), [("a, B ;b， c||A",)], "t string") == [["a", "B", "c"]]
    assert values(spark, text.attribute_role(F.col("t")), [("qty",), ("Other",)], "t string") == ["quantity", None]
    assert values(spark, text.count_token(F.col("t")), [("qty: 4",), ("panel x 12",), ("8pcs",), ("none",)], "t string") == [4, 12, 8, None]
    assert values(spark, text.excel_safe(F.col("t")), [("=1+1",), ("a",), (None,)], "t string") == ["'=1+1", "a", None]
    assert values(spark, text.similarity_bigrams(F.col("t"), F.lit("abc")), [("abc",), ("abd",), ("",)], "t string")[:2] == [1.0, pytest.approx(1 / 3)]


def test_text_repairs(spark):
    broken = ["中文".encode().decode("latin-1"), "图纸".encode().decode("latin-1"), "板".encode().decode("latin-1"), "plain"]
    df = spark.createDataFrame([("f1", t) for t in broken] + [("f2", broken[0]), ("f2", "café")], "file string, text string").withColumn("reading", text.utf8_reading("text"))
    out = {(r["file"], r["text"]): r["repaired"] for r in workbooks.text_repairs(df, "file", "text", "reading").collect()}
    assert out[("f1", broken[0])] == "中文" and out[("f1", "plain")] == "plain" and out[("f2", broken[0])] == broken[0]
    assert values(spark, text.has_cjk(F.col("t")), [("中",), ("a",)], "t string") == [True, False]


# ---- numbers


def test_arithmetic(spark):
    rows = [("(10+180)×2",), ("1/0",), ("__import__('os')",), ("2**9",), ("1e13",), ("-3 + +4",), ("1+" * 200 + "1",), (None,), ("a+1",)]
    assert values(spark, numeric.arithmetic("t"), rows, "t string") == [Decimal("380.000000000"), None, None, None, None, Decimal("1.000000000"), None, None, None]


def test_dimensional_expressions():
    assert numeric.dimensional("width_mm*length_mm*quantity/1000000", "㎡", 100.0, 2000.0, 3.0) == Decimal("0.6")
    assert numeric.dimensional("(length_mm+2*width_mm)*quantity/1000", "m", 100.0, 2000.0, 3.0) == Decimal("6.6")
    for bad in ("width_mm*length_mm/1000", "length_mm*quantity*quantity/1000", "(length_mm+quantity)/1000", "101*length_mm/1000", "length_mm/10", "length_mm**1/1000"):
        assert numeric.dimensional(bad, "m", 1.0, 2.0, 3.0) is None, bad
    assert numeric.dimensional("length_mm/1000", "m", 1.0, None, 3.0) is None


def test_formulas(spark):
    df = spark.createDataFrame([("2*a-b", {"a": 3.0, "b": 1.0}), ("200*a", {"a": 1.0}), ("c", {"a": 1.0})], "e string, m map<string,double>")
    assert [r[0] for r in df.select(numeric.formula(F.col("e"), F.col("m"))).collect()] == [Decimal("5.000000000"), None, None]
    assert values(spark, numeric.excel_formula("t"), [("width_mm*length_mm/1000000",), ("open('x')",)], "t string") == ["=((I{row}*J{row})/1000000)", None]


def test_small_numbers(spark):
    assert values(spark, numeric.unfolded_width(F.col("t")), [("10+180 + 10",), ("10*2+3",), ("10",), ("a+1",), (None,)], "t string") == [Decimal("200.0000"), None, None, None, None]
    assert values(spark, numeric.unit_of(F.col("t")), [("by Length",), ("area",), ("per set",), ("piece",), (None,)], "t string") == ["m", "㎡", "套", "件", None]
    rows = [("120", 5.0, "mm"), (None, 5.0, None), ("see", 5.0, "mm"), ("7", 5.0, "inch")]
    assert values(spark, numeric.display_value(F.col("o"), F.col("m"), F.col("u")), rows, "o string, m double, u string") == [120.0, 5.0, None, None]
    day = F.lit("2024-05-05").cast("date")
    rows = [("2024-05-05", "2024-05-05T23:00"), (None, None), ("2024-05-06", None), ("soon", None)]
    assert values(spark, numeric.valid_on(day, F.col("a"), F.col("b")), rows, "a string, b string") == [True, True, False, None]
    rows = [("2024-05-05T10:00:00+08:00",), ("2024-05-05T10:00:00",), ("2024-13-05T10:00:00Z",)]
    assert [x is not None for x in values(spark, numeric.review_time(F.col("t")), rows, "t string")] == [True, False, False]


def test_comparators(spark):
    rows = [(None, 1.0), (10.0, None), (10.0, 10.5), (10.0, 10.6), (0.0, 0.0), (0.0, 0.1)]
    ddl = "g double, p double"
    assert values(spark, numeric.compare_number(F.col("g"), F.col("p"), 0.05), rows, ddl) == ["UNRESOLVED", "FAIL", "PASS", "FAIL", "PASS", "FAIL"]
    assert values(spark, numeric.compare_number(F.col("g"), F.col("p"), 0.05, "absolute", 0.2), rows, ddl)[-1] == "PASS"
    assert values(spark, numeric.compare_number(F.col("g"), F.col("p"), 0.05, "unresolved"), rows, ddl)[-2:] == ["UNRESOLVED"] * 2


def test_geometry_scalars(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0))])
    row = spark.range(1).select(numeric.polygon_area(square).alias("a"), numeric.segment_distance(*[F.lit(float(x)) for x in (1, 2, 0, 0, 4, 0)]).alias("d"), numeric.bulge_length(F.lit(2.0), F.lit(1.0)).alias("b")).first()
    assert row["a"] == 6.0 and row["d"] == 2.0 and row["b"] == pytest.approx(3.14159265)
    b = boxes.box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))
    out = spark.range(1).select(boxes.holds_point(b, F.lit(2.0), F.lit(1.0)), boxes.holds_point_strictly(b, F.lit(2.0), F.lit(1.0)), boxes.point_distance(b, F.lit(5.0), F.lit(6.0)), boxes.intersects(b, boxes.box(F.lit(2.0), F.lit(0.0), F.lit(3.0), F.lit(1.0))), boxes.contains(b, b)).first()
    assert list(out) == [True, False, 5.0, True, True]


# ---- operators


def test_mutual_best_is_a_fixpoint(spark):
    rng = random.Random(1)
    pairs = [(a, b, round(rng.random(), 2)) for a in range(30) for b in range(30) if rng.random() < 0.3]
    left, done, number = list(pairs), set(), 0
    while True:
        number += 1
        best = lambda i, k: max((p[2] for p in left if p[i] == k), default=None)
        found = [p for p in left if p[2] == best(0, p[0]) == best(1, p[1]) and sum(q[0] == p[0] and q[2] == p[2] for q in left) == 1 and sum(q[1] == p[1] and q[2] == p[2] for q in left) == 1]
        if not found:
            break
        done |= {(*p[:2], number) for p in found}
        taken = [{p[i] for p in found} for i in (0, 1)]
        left = [p for p in left if p[0] not in taken[0] and p[1] not in taken[1]]
    df = spark.createDataFrame([*pairs, (None, 1, 2.0), (1, None, 2.0), (1, 1, None)], "l int, r int, score double")
    for whole in (10_000, 40):
        assert sorted(map(tuple, matching.mutual_best(df, whole=whole).collect())) == sorted(done), whole
    assert matching.mutual_best(spark.createDataFrame([], "l int, r int, score double")).count() == 0


def test_mutual_best_of_a_long_chain_beside_a_star(spark):
    n = 1000  # each row's best is the row before's second best, so each round frees one pair
    chain = [(i, i + d, float(2 * (n - i) - d)) for i in range(n) for d in (0, 1)]
    star = [(-1, -i, float(i)) for i in range(1, 3000)]
    out = matching.mutual_best(spark.createDataFrame([(f"{a}", b, s) for a, b, s in chain + star], "l string, r int, score double"))
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == sorted([(f"{i}", i, i + 1) for i in range(n)] + [("-1", -2999, 1)], key=str)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {i: i for i in range(400)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = graphs.components(spark.range(400), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in out.collect()} == {i: find(i) for i in range(400)}


def test_value_clusters(spark):
    rows = [("k", 100.0, 1), ("k", 101.0, 2), ("k", 102.4, 3), ("k", 200.0, 4), ("k", None, 5), ("j", 1.0, 6)]
    out = sequential.cluster_values(spark.createDataFrame(rows, "k string, v double, h long"), ["k"], "v", "h").collect()
    assert sorted((r["k"], r["cluster"], round(r["center"], 3), r["size"], r["corroborated"]) for r in out) == [("j", 0, 1.0, 1, False), ("k", 0, 101.133, 3, True), ("k", 1, 200.0, 1, False)]


def test_merged_occurrences(spark):
    rows = [("m", 1, ["a"], None, 0.0, 0.0, 0.5), ("m", 2, ["b"], "L", 9.0, 9.0, 0.9), ("m", 3, ["c"], "L", 5.0, 5.0, 0.8), ("m", 4, ["b", "c"], None, None, None, 0.1), ("m", 5, ["a"], None, 1.0, 1.0, 0.7)]
    out = sequential.merge_occurrences(spark.createDataFrame(rows, "mt string, id long, evidence array<string>, leader string, x double, y double, confidence double"), ["mt"]).collect()
    assert sorted((r["id"], r["merged"], tuple(r["evidence"])) for r in out) == [(2, 3, ("b", "c")), (5, 2, ("a",))]


def test_guarded_components(spark):
    rows = [("m", 1, "s1", "r1", None, "t"), ("m", 2, "s2", "r1", None, "t"), ("m", 3, "s3", "r2", None, "t"), ("m", 4, "s1", None, "n", "u"), ("m", 5, "s1", None, "n", "u")]
    out = sequential.guarded_components(spark.createDataFrame(rows, "mt string, id long, sheet string, room string, name string, title string"), "mt", [["title"]]).collect()
    assert {r["id"]: r["component"] for r in out} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_greedy_pairs_and_round_robin(spark):
    pairs = spark.createDataFrame([("s", "a", 1, 3.0), ("s", "a", 2, 1.0), ("s", "b", 2, 2.0), ("s", "b", 1, 4.0)], "s string, l string, r int, c double")
    assert {(r["l"], r["r"]) for r in sequential.greedy_pairs(pairs, "s", "l", "r", "c").collect()} == {("a", 2), ("b", 1)}
    rows = spark.createDataFrame([("s", p, i, o) for p, i, o in [("p", 1, 1), ("p", 2, 2), ("q", 1, 1), ("q", 3, 2), ("q", 4, 3)]], "s string, pool string, item int, o int")
    out = sequential.round_robin(rows, "s", "pool", "item", "o", 3).orderBy("turn").collect()
    assert [(r["pool"], r["item"]) for r in out] == [("p", 1), ("q", 3), ("p", 2)]


def test_unique_assignment(spark):
    pairs = spark.createDataFrame([("u", 1, 1), ("u", 1, 2), ("u", 2, 2), ("v", 1, 1), ("v", 2, 1), ("w", 1, 1), ("w", 1, 2)], "s string, l int, r int")
    out = sequential.unique_assignment(pairs, "s", "l", "r").collect()
    assert sorted((r["s"], r["state"], r["l"], r["r"]) for r in out if r["s"] == "u") == [("u", "unique", 1, 1), ("u", "unique", 2, 2)]
    assert {r["s"]: r["state"] for r in out if r["s"] != "u"} == {"v": "unequal", "w": "unequal"}


def test_geometry_operators(spark):
    segs = spark.createDataFrame([("s", 1, 0.0, 0.0, 10.0, 0.0), ("s", 2, 10.0, 0.0, 10.0, 5.0), ("s", 3, 10.0, 5.0, 20.0, 5.0), ("s", 4, 10.0, 5.0, 10.0, 9.0)], "s string, seg_id int, sx double, sy double, tx double, ty double")
    starts = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 50.0, 50.0), ("s", 3, 20.0, 5.0)], "s string, start_id int, x double, y double")
    out = {r["start_id"]: (r["length"], r["reason"]) for r in geometry.trace_paths(segs, starts, "s").collect()}
    assert out == {1: (2, "branch"), 2: (0, "no_stem"), 3: (1, "branch")}
    dims = spark.createDataFrame([("s", 1, 0.0, 0.0, 10.0, 0.0, 10.0), ("s", 2, 0.0, 7.0, 10.0, 7.0, 12.0), ("s", 3, 1.0, 1.0, 2.0, 2.0, 1.0)], "s string, dim_id int, ax double, ay double, bx double, by double, value double")
    out = {r["dim_id"]: (r["rank"], r["state"]) for r in geometry.bind_dimensions(dims, segs, ["s"]).collect()}
    assert out[1] == (1, "bound") and out[2] == (2, "conflict") and 3 not in out
    box = [("s", 1, 0.0, 0.0, 4.0, 0.0), ("s", 2, 0.0, 3.0, 4.0, 3.0), ("s", 3, 0.0, 0.0, 0.0, 3.0), ("s", 4, 4.0, 0.0, 4.0, 3.1), ("s", 5, 1.0, 1.0, 2.0, 1.0)]
    frames = geometry.rectangles(spark.createDataFrame(box, "s string, id int, x0 double, y0 double, x1 double, y1 double"), ["s"]).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in frames] == [(0.0, 0.0, 4.0, 3.0)]


def test_radius_join_is_exact(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)]
    b = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)]
    left = spark.createDataFrame(a, "a long, x double, y double").withColumn("s", F.lit(1))
    right = spark.createDataFrame(b, "b long, x double, y double").withColumn("s", F.lit(1))
    got = {(r["a"], r["b"]) for r in spatial.within_radius(left, right, ["s"], 9.0).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 9.0}


def test_rules_and_predicates(spark):
    df = spark.createDataFrame([("a.MT-01 x", "MT-01"), ("XMT-01", "MT-01"), ("MT-010", "MT-01"), (None, "MT-01")], "t string, c string")
    assert [r[0] for r in df.select(rules.standalone(F.col("t"), F.col("c"))).collect()] == [False, False, False, False]
    assert values(spark, rules.standalone(F.col("t"), F.lit("MT-01")), [("see MT-01.",)], "t string") == [True]
    assert values(spark, rules.evidence_list(F.col("e")), [(["a"],), ([],), (["a", " "],), (None,)], "e array<string>") == [True, False, False, False]
    assert values(spark, rules.generic_title(F.col("t"), ["plan", "section"]), [("Plan 1",), ("Plan of hall",)], "t string") == [True, False]
    assert values(spark, rules.contaminated(F.col("t"), ["answer"]), [('{"a": {"answer": 1}}',), ('{"a": 1}',)], "t string") == [True, False]
    c = spark.createDataFrame([(["x", "y"], "Red Wall")], "tags array<string>, name string")
    got = c.select(*[rules.matches(m) for m in ({"tags_all": ["x", "y"]}, {"tags_all": ["x", "z"]}, {"tags_none": ["z"]}, {"tags": ["y"]}, {"name_terms_all": ["red", "wall"]}, {"name_terms_none": ["red"]}, {})]).first()
    assert list(got) == [True, False, True, True, True, False, True]


def test_classification(spark):
    kinds = [("plan", "p", "plan", 3.0), ("plan", "p", "floor plan", 4.0), ("elevation", "e", "elev", 3.0)]
    rows = [("floor plan", "x"), ("plan elev", None), ("zzz", "zzz")]
    out = catalog.classify(spark.createDataFrame(rows, "f string, t string"), kinds, {"file": "f", "title": "t"}).collect()
    assert [r["kind"] for r in out] == ["plan", "unknown", "unknown"] and all(0 < r["confidence"] <= 0.96 for r in out)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k string, v double, s double, id long, a double, b double")
    assert ranking.merged_intervals(empty, ["k"], "a", "b").count() == 0
    assert ranking.top_candidates(empty, ["k"], [F.asc("id")]).count() == 0
    assert ranking.clear_best(empty, ["k"], "v", "s", "id").count() == 0
    assert pricing.conflicts(empty, "k", ["v"]).count() == 0
    assert graphs.components(empty.select("id"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_same_set(spark):
    rows = [(["a", "b"], ["b", "a", "a"]), (["a"], ["b"]), ([], [])]
    assert values(spark, assembly.same_set(F.col("a"), F.col("b")), rows, "a array<string>, b array<string>") == [True, False, True]


def test_policy_hash_and_ids(spark):
    assert text.policy_hash({"b": 1, "a": [2]}) == text.policy_hash({"a": [2], "b": 1})
    ids = values(spark, text.content_id("x", {"b": F.col("t"), "a": F.lit(1)}), [('q"\\',), (None,)], "t string")
    assert len(set(ids)) == 2 and all(i.startswith("x:") and len(i) == 26 for i in ids)


# ---- sources and sinks


def make_xlsx(path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
    rows = [["Code", "Unit Price", "Approved", "version"], ["MT-01", "10", "true", "v1"], ["MT-02", "12", "true", "v2"], ["Code", "note"], ["MT-03", "x"]]
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(cells))
        z.writestr("xl/media/image1.png", b"png")


def test_workbook_reader(spark, tmp_path):
    make_xlsx(tmp_path / "book.xlsx")
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    source = spark.read.format("binaryFile").load(str(tmp_path))
    cells = workbooks.workbook_cells(source)
    assert cells.where("problem is not null").count() == 1
    rows = workbooks.headed_rows(cells, {"code": [], "price": ["unit price"], "approved": [], "version": []}, required=3)
    book = workbooks.price_book(rows).collect()
    assert sorted((r["code"], r["price"]) for r in book if r["price"]) == [("Code", "note"), ("MT-01", "10"), ("MT-02", "12"), ("MT-03", "x")]
    assert {r["book_version"] for r in book} == {"v1+v2"}
    assert workbooks.image_assets(source).where("bytes = 3").count() == 1


def test_document_and_drawing_readers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para('hello')}<w:tbl><w:tr><w:tc>{para('MT-01')}</w:tc><w:tc>{para('steel')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    source = spark.read.format("binaryFile").load(str(tmp_path / "a.docx"))
    assert [(r["kind"], r["text"]) for r in workbooks.document_blocks(source).collect()] == [("paragraph", "hello"), ("row", "MT-01\tsteel")]
    dxf = ["0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", "B1", "0", "TEXT", "5", "9", "1", "in block", "10", "1", "20", "2", "0", "ENDBLK", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", "0", "TEXT", "5", "A", "8", "L", "1", "MT-01", "10", "3", "20", "4", "67", "1", "0", "INSERT", "5", "C", "2", "B1", "10", "100", "20", "200", "0", "ENDSEC", "0", "EOF"]
    (tmp_path / "x.dxf").write_text("\n".join(dxf))
    out = drawings.drawing_entities(spark.read.format("binaryFile").load(str(tmp_path / "x.dxf"))).collect()
    out.sort(key=lambda r: (r["level"], r["handle"]))
    assert [(r["kind"], r["handle"], r["text"], r["x"], r["y"], r["space"]) for r in out] == [("TEXT", "A", "MT-01", 3.0, 4.0, "paper"), ("INSERT", "C", "B1", 100.0, 200.0, "model"), ("TEXT", "C/9", "in block", 101.0, 202.0, "model")]


def test_inventory_and_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    with zipfile.ZipFile(tmp_path / "d" / "p.zip", "w") as z:
        for name in ("ok/a.dxf", "../up", "/abs", "Ok/A.dxf", "con.txt"):
            z.writestr(name, "x")
    (tmp_path / "d" / "bad.zip").write_bytes(b"zip?")
    found = files.inventory(spark, str(tmp_path / "d"))
    assert found.count() == 2 and files.tree_digest(found).first()[0] == files.tree_digest(found.repartition(3)).first()[0]
    source = spark.read.format("binaryFile").load(str(tmp_path / "d"))
    out = {r["member"]: r["problem"] for r in files.audit_members(files.zip_members(source)).collect()}
    assert out == {"ok/a.dxf": "collision", "Ok/A.dxf": "collision", "../up": "traversal", "/abs": "absolute", "con.txt": "reserved", None: "unreadable"}
    garbled = "中文.dwg".encode().decode("cp437")
    assert values(spark, files.repaired_name("n"), [(garbled,), ("café",)], "n string") == ["中文.dwg", "café"]
    attempts = spark.createDataFrame([("a", "t1", None, "e1"), ("a", "t2", "o2", None), ("b", "t1", None, "e1")], "drawing string, tool string, output string, error string")
    assert sorted((r["drawing"], r["tool"], r["error"]) for r in files.conversions(attempts, ["t1", "t2"]).collect()) == [("a", "t2", None), ("b", None, "e1")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "r" / "2.json").write_text('{"id": "b", "zz": 1}')
    (tmp_path / "r" / "3.json").write_text("nope")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    out = files.read_records(spark, str(tmp_path / "r"), schema).collect()
    assert sorted((r["id"], r["problem"]) for r in out if r["id"]) == [("a", None)] and {r["problem"] for r in out} == {None, "unknown keys: zz", "not an object"}
    (tmp_path / "m.json").write_text('{"schema_version": "1.0", "rows": [{"a": 5}, {"a": 6}]}')
    assert [(r["row_id"], r["a"]) for r in files.manifest_rows(spark, str(tmp_path / "m.json"), "a: int").collect()] == [(0, 5), (1, 6)]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("f1", 1), ("f2", 2)], "source_file_id string, v int")
    index = sinks.SourceIndex(spark, str(tmp_path / "t"))
    index.upsert(a)
    index.upsert(spark.createDataFrame([("f2", 9)], "source_file_id string, v int"))
    assert {(r["source_file_id"], r["v"]) for r in index.read().collect()} == {("f1", 1), ("f2", 9)}
    sinks.write_json(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.publish_catalog({"terms": a}, "t_", {"terms": (2, "source_file_id")})
    assert spark.table("t_terms").count() == 2
    spark.sql("drop table t_terms")
    pack = sinks.review_pack(spark.createDataFrame([("c", 2, "y"), ("c", 1, "x")], "c string, r int, v string"), "c", ["r"]).first()
    assert pack["document"] == '{"c":"c","candidates":[{"r":1,"v":"x"},{"r":2,"v":"y"}]}'
    assert [r["line"] for r in sinks.markdown_lines(spark.createDataFrame([("a|b", None)], "x string, y string"), ["x", "y"]).collect()] == ["| a\\|b |  |"]
    assert sinks.markdown_header(["x"]) == "| x |\n|---|"


def test_row_associations_and_specs(spark):
    rows = [("s", 1, 0.0, 0.0, 2.0, "MT-01"), ("s", 2, 5.0, 0.3, 2.0, "steel"), ("s", 3, 9.0, 0.0, 2.0, "1.2"), ("s", 4, 5.0, 40.0, 2.0, "far"), ("s", 5, 20.0, 0.0, 2.0, "MT-02"), ("s", 6, 22.0, 0.0, 2.0, "glass")]
    out = workbooks.row_associations(spark.createDataFrame(rows, "s string, id int, x double, y double, h double, text string"), ["s"], "^MT-").collect()
    assert {(r["code"], r["text"], r["position"]) for r in out} >= {("MT-01", "steel", 1), ("MT-01", "1.2", 2), ("MT-02", "glass", 1)}
    assert all(r["text"] != "far" for r in out)
    specs = spark.createDataFrame([("a", None, "p1"), ("a", None, "p2"), ("a", "x", "p3")], "n string, g string, loc string")
    assert sorted((r["g"] or "", r["locators"]) for r in workbooks.merged_specs(specs, ["n", "g"], "loc").collect()) == [("", ["p1", "p2"]), ("x", ["p3"])]


