"""Text drawing exchange files as an index of entities.

A thin reader turns group codes into flat records, file by file in bounded batches: lines end at line feeds alone, texts are decoded by the code page that the file declares,
and places that stand in a plane of their own (extrusion) are turned into the drawing's. Blocks are expanded by joins, one level of nesting a join: an insert's transformation in
space, one for each place of its array, is composed with that of the insert around it and applied to the points of the block's entities. Boxes, dimensions and leaders are
projections of those points.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.plans.checkpoints import stored

#: Levels of nested inserts that are expanded.
DEPTH = 12
#: Records and their places in a batch.
BATCH = 10_000
#: Bytes of a file that are split into lines at once.
CHUNK = 1 << 20

_POINTS = "array<struct<x:double,y:double,z:double>>"
RECORD = (
    f"path string, number long, kind string, block string, handle string, layer string, space string, text string, style_points {_POINTS}, points {_POINTS}, "
    "radius double, start_angle double, end_angle double, measured double, sx double, sy double, sz double, rotation double, axes array<double>, "
    "columns int, rows int, column_step double, row_step double"
)
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
#: Group codes of single numbers by record kind: radius, angles, measurement, scales and rotation. Fixed values.
_SINGLE = {40: "radius", 41: "sx", 42: "sy", 43: "sz", 50: "rotation", 51: "end_angle"}
#: Group codes of places: the place and its axis. Fixed values.
_PLACES = {10 * axis + place: (10 + place, axis - 1) for axis in (1, 2, 3) for place in (0, 1, 3, 4)}
#: Group codes of an insert's array. Fixed values.
_ARRAY = {70: "columns", 71: "rows", 44: "column_step", 45: "row_step"}
#: Kinds whose places stand in the plane of their extrusion, and the codes of places that do in a dimension. Fixed values.
_PLANAR = {"INSERT", "TEXT", "ATTRIB", "ATTDEF", "CIRCLE", "ARC", "LWPOLYLINE", "SOLID", "TRACE", "SHAPE"}
#: From this version on, files are UTF-8, whatever page they declare. Fixed value.
_UNICODE = "AC1021"
#: Declared pages whose codec isn't cp and their number. Fixed values.
_PAGES = {"ANSI_1361": "johab", "DOS932": "cp932", "UTF8": "utf-8", "UTF-8": "utf-8"}
#: The first bytes of a file in which its header is sought.
HEADER = 1 << 20


def encoding(content: bytes) -> str:
    """The codec of a file's texts: UTF-8 from AC1021 on and where neither version nor page is declared, else the declared page, or Windows' western one."""
    head = content[:HEADER]
    version = re.search(rb"\$ACADVER\s*\n\s*1\s*\n\s*(AC[0-9]+)", head)
    page = re.search(rb"\$DWGCODEPAGE\s*\n\s*3\s*\n\s*([A-Za-z0-9_-]+)", head)
    if version is None and page is None or version is not None and version[1].decode() >= _UNICODE:
        return "utf-8"
    name = page[1].decode().upper() if page else ""
    number = re.search("[0-9]+", name)
    try:
        return codecs.lookup(_PAGES.get(name) or f"cp{number[0]}" if number or name in _PAGES else "cp1252").name
    except LookupError:
        return "cp1252"


@functools.lru_cache(1024)
def _code(line: bytes) -> int | None:
    code = line.strip(b" \t\r")
    return int(code) if code.removeprefix(b"-").isdigit() else None


@functools.lru_cache(64)
def _plain(codec: str) -> bool:
    """Whether a codec reads ASCII as it is."""
    return bytes(range(128)).decode(codec, "replace") == bytes(range(128)).decode("ascii")


def _stretches(content: bytes) -> Iterator[tuple[list[int | None], list[str]]]:
    """The codes of a file's lines and their values, for about CHUNK bytes at once.

    Lines are ended by line feeds, or by carriage returns where there are no others; all other characters belong to texts. A last code without a value has an empty one.
    """
    codec, mark = encoding(content), b"\n" if b"\n" in content else b"\r"
    start = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    while start < len(content):
        end = content.find(mark, start + CHUNK)
        if end >= 0 and content.count(mark, start, end) % 2 == 0:  # a code's value is in its stretch
            end = content.find(mark, end + 1)
        end = len(content) if end < 0 else end
        part = content[start:end]
        lines = part.split(mark)
        if len(lines) % 2:
            lines.append(b"")
        codes = list(map(_code, lines[::2]))
        try:
            # valid UTF-8 and plain ASCII are the same decoded at once
            values = b"\n".join(lines[1::2]).decode("utf-8" if codec == "utf-8" else "ascii" if _plain(codec) else "none").split("\n")
            values = [v.strip(" \t\r") for v in values] if any(c in part for c in b" \t\r") else values
        except (UnicodeDecodeError, LookupError):
            values = [v.strip(b" \t\r").decode(codec, "replace") for v in lines[1::2]]
        if b"\\U+" in part or not _plain(codec):
            values = [re.sub(r"\\U\+([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), v) if "\\U+" in v else v for v in values]
        yield codes, values
        start = end + 1


def _runs(content: bytes) -> Iterator[tuple[list[int | None], list[str]]]:
    """The codes and values of a file from each code 0 to the next. Nothing stands before the first."""
    run = None
    for codes, values in _stretches(content):
        starts = [k for k, code in enumerate(codes) if code == 0]
        if run is not None:
            first = starts[0] if starts else len(codes)
            run[0].extend(codes[:first])
            run[1].extend(values[:first])
        for start, end in itertools.pairwise([*starts, len(codes)]):
            if run is not None:
                yield run
            run = codes[start:end], values[start:end]
    if run is not None:
        yield run


def _pairs(content: bytes) -> Iterator[tuple[int, str]]:
    return ((code, value) for run in _runs(content) for code, value in zip(*run) if code is not None)


def _axes(normal: tuple[float, float, float]) -> list[float] | None:
    """The plane of an extrusion: its x, y and z axis as columns of a matrix, row by row; None for the drawing's own plane and for a normal without length."""
    x, y, z = normal
    size = math.sqrt(x * x + y * y + z * z)
    if not size or not math.isfinite(size) or (x, y) == (0, 0) and z > 0:
        return None
    n = (x / size, y / size, z / size)
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    along = cross((0.0, 1.0, 0.0) if max(abs(n[0]), abs(n[1])) < 1 / 64 else (0.0, 0.0, 1.0), n)
    size = math.sqrt(sum(c * c for c in along))
    one = tuple(c / size for c in along)
    two = cross(n, one)
    return [v for row in zip(one, two, n) for v in row]


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def _entity(kind: str, codes: Sequence[int | None], values: Sequence[str]) -> tuple[str | None, tuple, int]:
    """What the lines of a record say: its name (a block's, or a section's), its values in the order of RECORD from the handle on, and how many places it has; places as tuples."""
    name, r, points = None, {"space": "model"}, {}
    for code, value in zip(codes, values):
        if code in _PLACES:
            key, axis = _PLACES[code]
            if key not in points:
                points[key] = ([], [], [])
            points[key][axis].append(_number(value))
        elif code in _SINGLE:
            if code == 42 and kind == "DIMENSION":
                r["measured"] = _number(value)
            elif code == 50 and kind == "ARC":
                r["start_angle"] = _number(value)
            else:
                r.setdefault(_SINGLE[code], _number(value))
        elif code == 8:
            r["layer"] = value
        elif code == 5:
            r["handle"] = value
        elif code == 2:
            if kind == "INSERT":
                r["text"] = value
            elif kind == "BLOCK" or name is None:
                name = value
        elif code == 67:
            r["space"] = "paper" if value == "1" else "model"
        elif code in (1, 3):
            r["text"] = (r.get("text") or "") + value
        elif code in (210, 220, 230):
            r.setdefault("normal", [0.0, 0.0, 1.0])[code // 10 - 21] = _number(value) or 0.0
        elif code == 38:
            r["elevation"] = _number(value)
        elif code in _ARRAY and kind == "INSERT":
            number = _number(value)
            r[_ARRAY[code]] = number if code in (44, 45) else int(number) if number is not None and math.isfinite(number) else None
    axes = _axes(tuple(r["normal"])) if "normal" in r else None
    level = r.get("elevation") or 0.0

    def at(codes: tuple[int, ...]) -> list[tuple]:
        out = []
        for c in codes:
            if c not in points:
                continue
            xs, ys, zs = points[c]
            zs = [z or 0.0 for z in zs] if len(zs) == len(xs) else [level] * len(xs)
            for p in zip(xs, ys, zs):
                if p[0] is not None and p[1] is not None:
                    if axes and (kind in _PLANAR or kind == "DIMENSION" and c == 11):
                        p = tuple(sum(axes[3 * i + k] * p[k] for k in range(3)) for i in range(3))
                    out.append((p[0] + 0.0, p[1] + 0.0, p[2] + 0.0))
        return out

    r |= {"style_points": at((13, 14)), "points": at((10, 11)), "axes": axes if kind == "INSERT" else None}
    return name, tuple(map(r.get, _NAMES[4:])), len(r["points"]) + len(r["style_points"])


#: Codes that a record has at most once where its values are taken by its layout, in the order of RECORD from the handle on: texts and numbers. Fixed values.
_ONCE = {5: "handle", 8: "layer", **_SINGLE}


@functools.lru_cache(1024)
def _layout(kind: str, codes: tuple[int | None, ...]) -> tuple | None:
    """Where the values of a record stand that has these codes: texts and numbers as (column, line), the line of its space and those of its places; None where they aren't one plain value a code."""
    if len(set(codes)) < len(codes) or any(c not in _ONCE and c not in _PLACES and c not in (0, 2, 67) for c in codes) or 2 in codes and kind != "INSERT":
        return None
    at, lines = {name: k for k, name in enumerate(_NAMES[4:])}, {c: k for k, c in enumerate(codes)}
    named = {c: "measured" if c == 42 and kind == "DIMENSION" else "start_angle" if c == 50 and kind == "ARC" else n for c, n in _ONCE.items() if c in lines}
    texts = [(at[n], lines[c]) for c, n in named.items() if c in (5, 8)] + ([(at["text"], lines[2])] if 2 in lines else [])
    places = [(at[n], [[lines.get(p + 10 * k) for k in range(3)] for p in ps if p in lines or p + 10 in lines or p + 20 in lines]) for n, ps in (("style_points", (13, 14)), ("points", (10, 11)))]
    # a place has its x and y
    places = [(k, [ls for ls in rows if ls[0] is not None and ls[1] is not None]) for k, rows in places]
    return texts, [(at[n], lines[c]) for c, n in named.items() if c not in (5, 8)], lines.get(67), at["space"], places


def _short(kind: str, codes: tuple[int | None, ...], values: Sequence[str]) -> tuple[str | None, tuple, int]:
    """``_entity`` for a record of few lines: by its layout where it has one."""
    layout = _layout(kind, codes)
    if layout is None:
        return _entity(kind, codes, values)
    texts, numbers, space, space_at, places = layout
    row, count = [None] * len(_NAMES[4:]), 0
    row[space_at] = "paper" if space is not None and values[space] == "1" else "model"
    for k, line in texts:
        row[k] = values[line]
    for k, line in numbers:
        row[k] = _number(values[line])
    for k, rows in places:
        row[k] = found = []
        for x, y, z in rows:
            x, y, z = _number(values[x]), _number(values[y]), z is not None and _number(values[z]) or 0.0
            if x is not None and y is not None:
                found.append((x + 0.0, y + 0.0, z + 0.0))
        count += len(found)
    return None, tuple(row), count


#: Lines of a record that is kept for others with the same lines, as in symbols that many files have, and such records of a task.
SHORT, KEPT = 32, 4096
_kept = functools.lru_cache(KEPT)(_short)


def _records(path: str, content: bytes) -> Iterator[tuple[tuple, int]]:
    """Flat records of a file, in the order of RECORD, with their number of places: the entities of its blocks and of its layouts, and a BLOCK record with the base point of each block."""
    section, block, number = "", None, 0
    for codes, values in _runs(content):
        kind = values[0]
        if kind == "ENDBLK":
            block = None
        elif kind == "SECTION" or section in ("ENTITIES", "BLOCKS") and kind not in ("ENDSEC", "EOF", "SEQEND"):
            if len(codes) > SHORT:
                name, said, places = _entity(kind, codes, values)
            else:
                name, said, places = _kept(kind, tuple(codes), tuple(values)) if block is not None else _short(kind, tuple(codes), values)
            if kind == "SECTION":
                section = section if name is None else name
                continue
            if kind == "BLOCK":
                block = name or ""
            yield (path, number, kind, block, *said), places
            number += 1


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    """Records as one batch, column by column: places as one array of coordinates and its offsets."""

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
            return pa.array(values, kind)
        fields = list(zip(*itertools.chain.from_iterable(values))) or [()] * kind.value_type.num_fields
        places = pa.StructArray.from_arrays([pa.array(f, pa.float64()) for f in fields], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(itertools.accumulate(map(len, values), initial=0), pa.int32()), places, type=kind)

    return pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(zip(*rows), types)], schema=types)


def _read(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The records of files (path, content); small files share a batch, and a large one has several."""
    rows, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for row, places in _records(path.as_py(), content.as_py()):
                rows.append(row)
                held += 1 + places
                if held >= BATCH:
                    yield _batch(rows, types)
                    rows, held = [], 0
    if rows:
        yield _batch(rows, types)


def drawing_records(files: DataFrame) -> DataFrame:
    """The flat records of text drawing exchange files (path, content): entities of layouts (block null) and of blocks, and blocks with their base point.

    ``points`` are the entity's own (codes 10 and 11), ``style_points`` a dimension's measured ends (13, 14). A file is read in one task and its
    records leave in batches, so no file is held as a list; one that isn't text gives no records.
    """
    types = to_arrow_schema(T.StructType.fromDDL(RECORD))
    return files.where("content is not null").select("path", "content").mapInArrow(lambda batches: _read(batches, types), RECORD)


#: A transformation in space, row by row, and its shift: x' = m0 x + m1 y + m2 z + t0 and so on.
_M, _T = [f"m{k}" for k in range(9)], [f"t{k}" for k in range(3)]


def _times(left: list[Column], right: list[Column]) -> list[Column]:
    return [left[3 * i] * right[k] + left[3 * i + 1] * right[3 + k] + left[3 * i + 2] * right[6 + k] for i in range(3) for k in range(3)]


def _applied(m: list[Column], p: list[Column]) -> list[Column]:
    return [m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] for i in range(3)]


def _insert_matrix() -> dict[str, Column]:
    """An insert's transformation of a block whose base point is its origin: it goes to the insert's point, or to the place of its array (``column``, ``row``)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    angle = F.radians(F.coalesce("rotation", zero))
    cos, sin = F.cos(angle), F.sin(angle)
    scale = [F.coalesce(c, one) for c in ("sx", "sy", "sz")]
    plane = [F.coalesce(F.get("axes", k), one if k in (0, 4, 8) else zero) for k in range(9)]
    turned = _times(plane, [cos, -sin, zero, sin, cos, zero, zero, zero, one])
    shift = _applied(turned, [F.col("column") * F.coalesce("column_step", zero), F.col("row") * F.coalesce("row_step", zero), zero])
    at = F.get("points", 0)
    return {f"_m{k}": v * scale[k % 3] for k, v in enumerate(turned)} | {f"_t{k}": F.coalesce(at[c], zero) + s for k, (c, s) in enumerate(zip("xyz", shift))}


def _places(inserts: DataFrame) -> DataFrame:
    """``inserts`` with their transformation (_m0 to _t2) and name in a chain of handles (``_chain``): a row for each place of their arrays."""
    many = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) - 1))
    name = F.when((F.coalesce("columns", F.lit(1)) > 1) | (F.coalesce("rows", F.lit(1)) > 1), F.concat(F.col("handle"), F.lit("["), "column", F.lit(","), "row", F.lit("]"))).otherwise(F.col("handle"))
    placed = inserts.withColumn("column", many("columns")).withColumn("row", many("rows"))
    return placed.withColumns(_insert_matrix() | {"_chain": name})


def _composed(outer: list[str], inner: list[str]) -> dict[str, Column]:
    """The transformation ``inner`` followed by ``outer``, both named by their columns."""
    m, t = [F.col(c) for c in outer[:9]], [F.col(c) for c in outer[9:]]
    shift = _applied(m, [F.col(c) for c in inner[9:]])
    return dict(zip(_M + _T, _times(m, [F.col(c) for c in inner[:9]]) + [v + c for v, c in zip(shift, t)]))


#: Places of an entity that are moved by plain expressions; entities with more take a function over their array.
FEW = 4


def _moved(points: str) -> Column:
    def move(p: Column) -> Column:
        to = _applied([F.col(c) for c in _M], [p["x"], p["y"], F.coalesce(p["z"], F.lit(0.0))])
        return F.struct(*[(v + F.col(t)).alias(c) for c, v, t in zip("xyz", to, _T)])

    out = F.when(F.size(points) == 1, F.array(move(F.get(points, 0))))
    for n in range(2, FEW + 1):
        out = out.when(F.size(points) == n, F.array(*[move(F.get(points, k)) for k in range(n)]))
    return out.otherwise(F.transform(points, move))


def _contents(records: DataFrame, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """The blocks that a layout's insert shows (path, root), nested ones too, with the transformation from the place of the root's base point; and the files in which inserts below ``depth`` levels are left.

    Only the inserts of blocks are followed here, not what else the blocks hold. ``outer`` is what follows the handle of the layout's insert in those of the block's entities.
    """
    identity = {n: F.lit(float(n in ("m0", "m4", "m8"))) for n in _M}
    first = F.get("points", 0)
    bases = records.where("kind = 'BLOCK'").groupBy("path", "block").agg(*[(-F.coalesce(F.min_by(first[c], "number"), F.lit(0.0))).alias(f"b{k}") for k, c in enumerate("xyz")])
    bases = stored(bases)
    nested = records.where("block is not null and kind = 'INSERT'").withColumn("handle", F.coalesce(F.concat(F.lit("/"), "handle"), F.lit("")))
    # transformation of each insert from the base point of its own block
    links = _places(nested).withColumnsRenamed({"block": "around", "text": "block"}).join(bases.hint("merge"), ["path", "block"])
    links = links.withColumns({f"_t{k}": v + F.col(f"_t{k}") for k, v in enumerate(_applied([F.col(f"_{c}") for c in _M], [F.col(f"b{k}") for k in range(3)]))})
    links = stored(links.select("path", "around", F.col("block").alias("inside"), "_chain", *[f"_{c}" for c in _M + _T]))
    roots = records.where("block is null and kind = 'INSERT'").select("path", F.col("text").alias("block")).distinct()
    whole = roots.join(bases.hint("merge"), ["path", "block"]).withColumns({"root": F.col("block"), "outer": F.lit(""), "level": F.lit(1), **identity, **{t: F.col(f"b{k}") for k, t in enumerate(_T)}}).drop("b0", "b1", "b2")
    out = whole = stored(whole)
    for level in range(2, depth + 2):
        # then that of the inserts around it
        met = whole.withColumnRenamed("block", "around").hint("merge").join(links, ["path", "around"])
        moved = _composed(_M + _T, [f"_{c}" for c in _M + _T])
        whole = stored(met.select("path", F.col("inside").alias("block"), "root", F.concat("outer", "_chain").alias("outer"), F.lit(level).alias("level"), *[v.alias(c) for c, v in moved.items()]))
        if whole.isEmpty():
            return out, None
        if level <= depth:
            out = out.unionByName(whole)
    return out, whole.select("path").distinct()


#: Half a box and its middle, by axis.
_H, _C = [f"h{k}" for k in range(3)], [f"c{k}" for k in range(3)]
#: Share of a place's size that its rounding may take, by far.
ROUNDING = 1e-9


def _sum(terms: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, terms)


def _root_boxes(contents: DataFrame, inner: DataFrame) -> DataFrame:
    """``contents`` with the box of what each block holds itself, as its root shows it: half and middle for each axis, rounding included, and the largest radius."""
    pts = F.concat("points", "style_points")
    ends = {k: (F.min(F.array_min(pts[c])), F.max(F.array_max(pts[c]))) for k, c in enumerate("xyz")}
    radius = F.max(F.when(F.col("kind").isin("CIRCLE", "ARC"), F.abs(F.coalesce("radius", F.lit(0.0)))).otherwise(0.0))
    boxes = inner.groupBy("path", "block").agg(*[((hi - lo) / 2).alias(f"h_{k}") for k, (lo, hi) in ends.items()], *[((hi + lo) / 2).alias(f"c_{k}") for k, (lo, hi) in ends.items()], radius.alias("r_"))
    m, axes = [F.col(c) for c in _M], range(3)
    half = {h: _sum([F.abs(m[3 * i + k]) * F.col(f"h_{k}") for k in axes]) for i, h in enumerate(_H)}
    middle = {c: _sum([m[3 * i + k] * F.col(f"c_{k}") for k in axes]) + F.col(_T[i]) for i, c in enumerate(_C)}
    slack = [ROUNDING * (half[_H[i]] + _sum([F.abs(m[3 * i + k] * F.col(f"c_{k}")) for k in axes]) + F.abs(F.col(_T[i]))) for i in axes]
    columns = [F.sqrt(_sum([m[3 * i + k] ** 2 for i in axes])) for k in (0, 1)]
    sizes = {h: v + s for (h, v), s in zip(half.items(), slack)} | middle | {"r": F.col("r_") * F.greatest(*columns) * (1 + ROUNDING)}
    return contents.hint("merge").join(boxes, ["path", "block"]).withColumns(sizes).drop("r_", *[f"{c}_{k}" for c in "hc" for k in axes])


def _near() -> Column:
    """Whether a block's box, moved by an insert of its root, may meet a region of the file. NaN is above all numbers here, so that a box without known ends may."""
    sides = []
    for i, axis in enumerate("xy"):
        m = [F.col(f"_m{3 * i + k}") for k in range(3)]
        middle = _sum([a * F.col(c) for a, c in zip(m, _C)])
        far = _sum([F.abs(a) * F.col(h) for a, h in zip(m, _H)]) + F.col("_size") * F.col("r")
        sides += [far - middle - F.col(f"_t{i}") + F.col(f"_slack{i}") >= F.col(f"below_{axis}"), middle + far + F.col(f"_t{i}") + F.col(f"_slack{i}") >= F.col(f"above_{axis}")]
    return F.coalesce(functools.reduce(lambda a, b: a & b, sides), F.lit(True))


def expanded(records: DataFrame, depth: int = DEPTH, regions: DataFrame | None = None) -> DataFrame:
    """The entities of layouts, and those of the blocks that their inserts show, in drawing coordinates, with ``level`` and the chain of handles as ``handle``; a place of an insert's array is named [column,row].

    Blocks are followed once a file and block, however many inserts show them; then each insert of a layout meets the blocks that it shows, and those what they hold.
    ``truncated`` marks the entities of a file in which inserts below ``depth`` levels weren't expanded, so that nobody takes a part for the whole. An insert of a
    block that the file lacks shows nothing. With ``regions`` (path, x0, y0, x1, y1), what a block holds is left out where the block's own box, as shown, meets none of
    the file's regions: none of its entities can.
    """
    records = stored(records)
    contents, cutoff = _contents(records, depth)
    inner = records.where("block is not null and kind <> 'BLOCK'")
    own = records.where("block is null and kind <> 'BLOCK'").withColumn("level", F.lit(0))
    placed = _places(own.where("kind = 'INSERT'")).select("path", F.col("text").alias("root"), "_chain", F.col("space").alias("_space"), *[f"_{c}" for c in _M + _T])
    inside = [f"i_{c}" for c in _M + _T]
    named = contents.withColumnsRenamed(dict(zip(_M + _T, inside)))
    near = F.lit(True)
    if regions is not None:
        ends = {f"above_{c}": F.min(f"{c}0") for c in "xy"} | {f"below_{c}": -F.nanvl(F.max(f"{c}1"), F.lit(float("inf"))) for c in "xy"}
        reach = regions.groupBy("path").agg(*[v.alias(c) for c, v in ends.items()])
        named = _root_boxes(contents, inner).hint("merge").join(reach, "path").withColumnsRenamed(dict(zip(_M + _T, inside)))
        sizes = {"_size": F.sqrt(_sum([F.col(f"_m{k}") ** 2 for k in range(6)])) * (1 + ROUNDING)} | {f"_slack{k}": ROUNDING * F.abs(F.col(f"_t{k}")) for k in (0, 1)}
        placed, near = placed.withColumns(sizes), _near()
    views = placed.hint("merge").join(named, ["path", "root"]).where(near)
    views = views.select("path", "block", "_chain", "_space", "outer", "level", *[v.alias(c) for c, v in _composed([f"_{c}" for c in _M + _T], inside).items()])
    follows = F.concat("outer", F.coalesce(F.concat(F.lit("/"), "handle"), F.lit("")))
    handle = F.when(F.col("_chain").isNull(), F.substring(follows, 2, 1 << 30)).otherwise(F.concat("_chain", follows))
    shown = views.hint("merge").join(inner, ["path", "block"]).withColumns({"handle": handle, "space": F.col("_space")})
    radius = F.col("radius") * F.greatest(F.sqrt(F.col("m0") ** 2 + F.col("m3") ** 2), F.sqrt(F.col("m1") ** 2 + F.col("m4") ** 2))
    shown = shown.withColumns({"points": _moved("points"), "style_points": _moved("style_points"), "radius": radius})
    out = own.unionByName(shown.select(*own.columns))
    if cutoff is None:
        return out.withColumn("truncated", F.lit(False))
    return out.join(cutoff.withColumn("truncated", F.lit(True)).hint("merge"), "path", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def entity_index(entities: DataFrame) -> DataFrame:
    """The index: place (x, y), box, a dimension's measured ends and value, a leader's target (first point) and landing (last), beside the entity's own columns.

    A circle's box, and an arc's, is that of its whole circle; an entity without points has none.
    """
    flat = lambda p: F.when(p.isNotNull(), F.struct(p["x"].alias("x"), p["y"].alias("y")))
    r = F.when(F.col("kind").isin("CIRCLE", "ARC"), F.coalesce("radius", F.lit(0.0))).otherwise(0.0)
    side = lambda f, c, s: (F.least if s < 0 else F.greatest)(f(F.col("points")[c]), f(F.col("style_points")[c])) + s * r
    dimension, leader = F.col("kind") == "DIMENSION", F.col("kind") == "LEADER"
    return entities.select(
        "path", "level", "kind", "handle", "layer", "space", "text", "block", F.get("points", 0)["x"].alias("x"), F.get("points", 0)["y"].alias("y"),
        side(F.array_min, "x", -1).alias("x0"), side(F.array_min, "y", -1).alias("y0"), side(F.array_max, "x", 1).alias("x1"), side(F.array_max, "y", 1).alias("y1"),
        F.when(dimension, flat(F.get("style_points", 0))).alias("from"), F.when(dimension, flat(F.get("style_points", 1))).alias("to"), F.when(dimension, F.col("measured")).alias("measured"),
        F.when(leader, flat(F.get("points", 0))).alias("target"), F.when(leader, flat(F.get("points", F.size("points") - 1))).alias("landing"), "truncated",
    )


def drawing_entities(files: DataFrame, depth: int = DEPTH, regions: DataFrame | None = None) -> DataFrame:
    """The entity index of drawing files (path, content), blocks expanded; with ``regions``, without blocks that are shown away from all regions of their file."""
    return entity_index(expanded(drawing_records(files), depth, regions))


def probe_regions(index: DataFrame, regions: DataFrame, cell: float = 1000.0) -> DataFrame:
    """V8: per region (region, path, x0, y0, x1, y1) the entities whose boxes meet it: how many, their layers, and whether their file was truncated.

    Boxes meet in the grid cells that both touch, and count in the first of them.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    spread = lambda df, p: df.withColumn("__i", F.explode(F.sequence(at(f"{p}x0"), at(f"{p}x1")))).withColumn("__j", F.explode(F.sequence(at(f"{p}y0"), at(f"{p}y1"))))
    own = spread(regions.select("region", "path", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]), "r_")
    # behind a generator of one row, so that no filter above repeats the boxes and the movement beneath
    boxes = index.select("path", "layer", "truncated", F.inline(F.array(F.struct("x0", "y0", "x1", "y1"))))
    boxes = spread(boxes.where("x0 is not null"), "")
    first = (F.col("__i") == F.greatest(at("x0"), at("r_x0"))) & (F.col("__j") == F.greatest(at("y0"), at("r_y0")))
    met = own.join(boxes, ["path", "__i", "__j"]).where(first).where("x0 <= r_x1 and r_x0 <= x1 and y0 <= r_y1 and r_y0 <= y1")
    found = met.groupBy("region").agg(F.count("*").alias("entities"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), F.bool_or("truncated").alias("truncated"))
    return regions.select("region").join(found, "region", "left").select("region", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("layers", F.lit("")).alias("layers"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
