"""Number, unit, date and expression functions."""

from __future__ import annotations

import ast
from decimal import Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTITY = T.DecimalType(38, 9)
#: Bounds of the safe arithmetic (M1): characters, nodes, literals, values. Fixed values.
LONGEST, NODES, LITERAL, VALUE = 256, 64, Decimal(10) ** 12, Decimal(10) ** 15

_OPERATIONS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}


def _walk(node: ast.AST, names: dict[str, Decimal], constant) -> Decimal:
    match node:
        case ast.Constant(value=v) if type(v) in (int, float):
            number = constant(Decimal(repr(v)))
        case ast.Name(id=name) if name in names:
            number = names[name]
        case ast.UnaryOp(op=ast.USub(), operand=x):
            number = -_walk(x, names, constant)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            number = _walk(x, names, constant)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATIONS:
            number = _OPERATIONS[type(op)](_walk(a, names, constant), _walk(b, names, constant))
        case _:
            raise ValueError("not arithmetic")
    if abs(number) > VALUE:
        raise ValueError("too large")
    return number


def _literal(x: Decimal) -> Decimal:
    if abs(x) > LITERAL:
        raise ValueError("literal too large")
    return x


def evaluate(text: str | None, names: dict[str, Decimal] | None = None, constant=_literal) -> Decimal | None:
    """The value of + - * / (also the signs for times and divided by), brackets, numbers and ``names``; None if it isn't that."""
    if text is None or len(text) > LONGEST:
        return None
    try:
        tree = ast.parse(text.replace("\u00d7", "*").replace("\u00f7", "/").strip(), mode="eval")
        if sum(1 for _ in ast.walk(tree)) > NODES:
            return None
        with localcontext() as context:
            context.prec = 28
            return _walk(tree.body, names or {}, constant)
    except (SyntaxError, ValueError, ArithmeticError, InvalidOperation, RecursionError, MemoryError):
        return None


def binary_round(c: Column | str, places: int) -> Column:
    """A double rounded as SQL engines on doubles do: the scaled double's nearest whole number, halves away from zero. Spark's ``round`` goes by the decimal text: 0.285 is 0.29 there and 0.28 here."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * float(10**places)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / float(10**places)).otherwise(c)


def _rounded(x: Decimal | None) -> Decimal | None:
    try:
        return None if x is None else x.quantize(Decimal("1e-9"))
    except InvalidOperation:
        return None


@F.pandas_udf(QUANTITY)
def arithmetic(s: pd.Series) -> pd.Series:
    """M1: value of a safe arithmetic expression, null where it is none; each distinct text is parsed once a batch."""
    return s.map({t: _rounded(evaluate(t)) for t in s.dropna().unique()}).where(s.notna(), None)


def _degree(node: ast.AST, dims: dict[str, int]) -> int:
    """The dimension of an expression in lengths; sums need equal ones."""
    match node:
        case ast.Constant():
            return 0
        case ast.Name(id=name):
            return dims[name]
        case ast.UnaryOp(operand=x):
            return _degree(x, dims)
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            return _degree(a, dims) + _degree(b, dims)
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            return _degree(a, dims) - _degree(b, dims)
        case ast.BinOp(left=a, right=b) if (d := _degree(a, dims)) == _degree(b, dims):
            return d
    raise ValueError("mixed dimensions")


#: The divisor that ends a quantity's expression, and its dimension, by unit (M2).
UNIT_ENDS = {"m": (1000, 1), "\u33a1": (1_000_000, 2)}


def _multiplier(x: Decimal) -> Decimal:
    if x != int(x) or not 1 <= x <= 100:
        raise ValueError("multipliers are whole numbers from 1 to 100")
    return x


def dimensional(text: str | None, unit: str | None, width: float | None, length: float | None, quantity: float | None) -> Decimal | None:
    """M2: quantity in ``unit`` of an expression in width_mm, length_mm and quantity that ends in /1000 or /1000000."""
    if text is None or unit not in UNIT_ENDS:
        return None
    divisor, degree = UNIT_ENDS[unit]
    try:
        body = ast.parse(text.replace("\u00d7", "*").strip(), mode="eval").body
        if not (isinstance(body, ast.BinOp) and isinstance(body.op, ast.Div) and isinstance(body.right, ast.Constant) and body.right.value == divisor):
            return None
        uses = [n.id for n in ast.walk(body.left) if isinstance(n, ast.Name)]
        if uses.count("quantity") > 1 or any(isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Sub)) and "quantity" in {m.id for m in ast.walk(n) if isinstance(m, ast.Name)} for n in ast.walk(body.left)):
            return None
        if _degree(body.left, {"width_mm": 1, "length_mm": 1, "quantity": 0}) != degree:
            return None
        names = {k: Decimal(repr(v)) for k, v in (("width_mm", width), ("length_mm", length), ("quantity", quantity)) if v is not None and not pd.isna(v)}
        with localcontext() as context:
            context.prec = 28
            return _walk(body.left, names, _multiplier) / divisor
    except (SyntaxError, ValueError, KeyError, ArithmeticError, RecursionError):
        return None


@F.pandas_udf(QUANTITY)
def dimensional_quantity(text: pd.Series, unit: pd.Series, width: pd.Series, length: pd.Series, quantity: pd.Series) -> pd.Series:
    """M2 as a column function; null where the expression isn't valid for its unit or a value is missing."""
    rows = list(zip(text, unit, width, length, quantity))
    known = {row: _rounded(dimensional(*row)) for row in set(rows)}  # each distinct row is parsed once a batch
    return pd.Series([known[row] for row in rows], dtype=object)


def formula(expression: Column, symbols: Column) -> Column:
    """M7 and M9: a reviewer's or a profile's expression over ``symbols`` (map<string,double>); literals are 1 to 100."""

    @F.pandas_udf(QUANTITY)
    def apply(text: pd.Series, names: pd.Series) -> pd.Series:
        rows = [(t, frozenset((k, v) for k, v in (dict(m) if m is not None else {}).items() if v is not None)) for t, m in zip(text, names)]
        known = {row: _rounded(evaluate(row[0], {k: Decimal(repr(v)) for k, v in row[1]}, _multiplier)) for row in set(rows)}  # each distinct row is parsed once a batch
        return pd.Series([known[row] for row in rows], dtype=object)

    return apply(expression, symbols)


@F.pandas_udf(T.StringType())
def excel_formula(text: pd.Series) -> pd.Series:
    """A dimensional expression as a spreadsheet formula over the columns I (width), J (length) and K (quantity) of ROW; null if unsafe."""
    cells = {"width_mm": "I{row}", "length_mm": "J{row}", "quantity": "K{row}"}

    def build(node: ast.AST) -> str:
        match node:
            case ast.Constant(value=v) if type(v) in (int, float):
                return repr(v)
            case ast.Name(id=name) if name in cells:
                return cells[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATIONS:
                sign = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}[type(op)]
                return f"({build(a)}{sign}{build(b)})"
        raise ValueError("not a formula")

    def compile_one(t: str) -> str | None:
        try:
            return "=" + build(ast.parse(t, mode="eval").body)
        except (SyntaxError, ValueError, RecursionError):
            return None

    return text.map({t: compile_one(t) for t in text.dropna().unique()}).where(text.notna(), None)


def unit_of(method: Column) -> Column:
    """M3: the unit that a pricing method names: by length, by area, by set, else by piece."""
    m = F.lower(method)
    return F.when(m.contains("length") | m.contains("linear"), "m").when(m.contains("area") | m.contains("square"), "\u33a1").when(m.contains("set"), "\u5957").when(m.isNotNull(), "\u4ef6")


def unfolded_width(spec: Column) -> Column:
    """M4: the sum of a ``a+b+c`` specification, null without a plus, with a product sign, or with a part that is no number."""
    parts = F.transform(F.split(spec, r"\+"), lambda x: F.trim(x).try_cast("decimal(12,4)"))
    total = F.aggregate(parts, F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + x).cast("decimal(18,4)"))
    return F.when(spec.contains("+") & ~spec.rlike("[*xX\u00d7]"), total)


def confidence(base: Column, distance: Column, radius: float) -> Column:
    """The base and up to a quarter for nearness, .95 at most; without a distance .45 at most."""
    near = F.least(F.lit(0.95), base + 0.25 * F.greatest(F.lit(0.0), 1 - distance / radius))
    return F.round(F.when(distance.isNull(), F.least(base, F.lit(0.45))).otherwise(near), 6)


def display_value(override: Column, measured: Column, unit: Column) -> Column:
    """The number that a dimension shows: its override beats the measurement, the unit must be mm, a bad override gives null."""
    number = F.regexp_extract(override, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:mm)?\s*$", 1).try_cast("double")
    own = F.when(override.isNull() | F.trim(override).isin("", "<>"), measured).otherwise(number)
    return F.when(F.coalesce(F.lower(F.trim(unit)), F.lit("mm")) == "mm", own)


def price_date(c: Column) -> Column:
    """The date in the first ten characters, null if they are none."""
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Whether a price holds on a day, both bounds included; a bound that is missing is open, an unreadable one gives null."""
    lower, upper = price_date(start), price_date(end)
    unreadable = (start.isNotNull() & lower.isNull()) | (end.isNotNull() & upper.isNull()) | day.isNull()
    return F.when(~unreadable, (lower.isNull() | (lower <= day)) & (upper.isNull() | (day <= upper)))


def review_time(c: Column) -> Column:
    """An ISO 8601 instant that names its offset, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), c.try_cast("timestamp"))


def compare_text(gold: Column, predicted: Column, strict: bool = False) -> Column:
    """M8: PASS or FAIL, UNRESOLVED without a gold value; a missing prediction fails. Not strict: case and spaces don't matter."""
    key = (lambda c: c) if strict else (lambda c: F.lower(F.regexp_replace(c, r"\s+", "")))
    return F.when(gold.isNull(), "UNRESOLVED").when(predicted.isNull(), "FAIL").when(key(gold) == key(predicted), "PASS").otherwise("FAIL")


def compare_number(gold: Column, predicted: Column, tolerance: float | None, zero: str = "exact", absolute: float = 0.0) -> Column:
    """M8: PASS within the relative tolerance, bound included. A gold of zero passes an exact zero, one within ``absolute``, or stays UNRESOLVED."""
    at_zero = {"exact": F.when(predicted == 0, "PASS").otherwise("FAIL"), "absolute": F.when(F.abs(predicted) <= absolute, "PASS").otherwise("FAIL"), "unresolved": F.lit("UNRESOLVED")}[zero]
    if tolerance is None:
        return F.when(gold.isNull() | predicted.isNotNull(), "UNRESOLVED").otherwise("FAIL")
    near = F.when(F.abs(predicted - gold) <= F.abs(gold) * tolerance, "PASS").otherwise("FAIL")
    return F.when(gold.isNull(), "UNRESOLVED").when(predicted.isNull(), "FAIL").when(gold == 0, at_zero).otherwise(near)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(px - ax - t * dx, F.lit(2)) + F.pow(py - ay - t * dy, F.lit(2)))


def polygon_area(points: Column) -> Column:
    """Area of a polygon, an array of structs with x and y, by the shoelace formula."""
    n = F.size(points)
    cross = F.transform(points, lambda p, i: p["x"] * F.element_at(points, (i + 1) % n + 1)["y"] - F.element_at(points, (i + 1) % n + 1)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def bulge_length(chord: Column, bulge: Column) -> Column:
    """Length of an arc from its chord and bulge (tangent of a quarter of its angle)."""
    angle = 4 * F.atan(F.abs(bulge))
    return F.when(bulge == 0, chord).otherwise(chord * angle / (2 * F.sin(angle / 2)))
