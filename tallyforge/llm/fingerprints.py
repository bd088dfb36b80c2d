"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash of its inner s-mers is at its first or last place.
Whether it is one depends on its own characters alone, so equal passages have equal anchors wherever they stand.
A fingerprint keeps the ``size`` least distinct anchor hashes of the whole text, in the order in which they first
occur; likeness counts the anchors that two fingerprints share in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import blocks, bound_batches, cut, if_few, with_arrow

#: Code points of an anchor and of its inner substrings: of 6 inner ones each, the least is at an edge in a third of all cases.
K, S = 10, 5
#: Anchors that a fingerprint keeps, 8 hexadecimal digits each.
SIZE = 64
#: Code points hashed at a time.
STEP = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each run of ``width`` code points, by doubling the run's length."""
    h, have, power = codes, 1, _ODD
    out, done, at = None, 0, 0
    while True:
        if width & have:
            n = len(codes) - width + 1
            piece = h[at : at + n]
            out = piece.copy() if out is None else out * power + piece
            done, at = done + have, at + have
        if done == width:
            return out
        h = h[:-have] * power + h[have:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        have *= 2


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of a run of code points (uint64)."""
    inner = _mix(_rolled(codes, s))
    span = k - s + 1
    low, have = inner, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    n = len(low)
    at = np.flatnonzero((inner[:n] == low) | (inner[span - 1 : span - 1 + n] == low))
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * _ODD + codes[at + j]
    return at, _mix(h)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def sketch(text: str, k: int = K, s: int = S, size: int = SIZE) -> np.ndarray:
    """The ``size`` least distinct anchor hashes (32 bits) of the text in the order of their first places.

    A text of fewer than k code points has one anchor, its own hash; the empty text has none.
    """
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) < k:
        codes = _codes(text)
        return (_mix(_rolled(codes, len(codes)) + np.uint64(len(codes))) >> np.uint64(32)).astype(np.uint32)
    best, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for start in range(0, len(text) - k + 1, STEP):
        at, h = anchors(_codes(text[start : start + STEP + k - 1]), k, s)
        h >>= np.uint64(32)
        if len(best) == size and len(h):
            keep = h <= best[-1]
            at, h = at[keep], h[keep]
        elif len(h) > 8 * size:
            bound = np.partition(h, 4 * size)[4 * size]  # distinct values are wanted: on too many repeats all are sorted
            keep = h <= bound
            if len(np.unique(h[keep])) >= size:
                at, h = at[keep], h[keep]
        best, places = np.unique(np.concatenate([best, h]), return_index=True)
        first = np.concatenate([first, at + start])[places][:size]
        best = best[:size]
    return best[np.argsort(first)].astype(np.uint32)


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Likeness of two fingerprints, 0 to 1: twice the shared share over the whole (Dice), as the least anchors estimate it.

    Of the anchors below the greatest that either could keep, those count as shared that both have, up to the longest
    run of them in one order. Equal fingerprints have 1, two empty ones too.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = np.union1d(a, b)
    bound = min((int(x.max()) for x in (a, b) if len(x) >= size), default=1 << 32)  # below it both are whole
    both = both[both <= bound]
    if not len(both):
        return 0.0
    place = {h: i for i, h in enumerate(a.tolist())}
    tails: list[int] = []
    for h in b.tolist():
        if h <= bound and h in place:
            i = place[h]
            at = bisect_left(tails, i)
            tails[at : at + 1] = [i]
    jaccard = len(tails) / len(both)
    return 2 * jaccard / (1 + jaccard)


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """``df`` with ``out``: the fingerprint of each whole text as hexadecimal text; a null text is an empty one and has an empty fingerprint."""

    def make():
        return lambda batch: [pa.array([as_text(sketch(x or "", k, s, size)) for x in batch.column(text).to_pylist()], pa.string())]

    return with_arrow(df, text, [T.StructField(out, T.StringType())], make)


def shared_anchors(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, position, anchor) of every closed syncmer, for positional matching by joins on ``anchor``; a text below k code points has none."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start in range(0, len(x or "") - k + 1, STEP):
                    at, h = anchors(_codes(x[start : start + STEP + k - 1]), k, s)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at + start), pa.array(h.view(np.int64))], names=["doc_id", "position", "anchor"])

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, position long, anchor long")


#: Rows of a range, about, and how often the order is cut: at that many quantiles, and into that many equal parts between two of them, at most. A range
#: is streamed, not held; at 2e10 documents it has 76,000 rows.
ROWS_A_RANGE, CUTS = 1000, 512


def with_next(df: DataFrame, order: str, tie: str) -> DataFrame:
    """``df`` dealt and sorted into ranges of ``order`` (nulls first; ties by ``tie``), so that a task sees a row and its successor.

    Adds ``__range`` and ``__tail``. The number of ranges grows with the rows: approximate quantiles of ``order``, a whole number, are cut
    into equal parts. The first row of each range also goes, marked by ``__tail``, to the end of the range before that has rows, that of the first
    range to the end of the last: a row's successor is the next row of its range. More tails than one, from ties, are to be passed over.
    The driver sees the quantiles and a row for each.
    """
    rows = df.select(F.col(order).cast("double").alias("x"))
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    ranges = max(1, n // ROWS_A_RANGE)
    cuts = min(CUTS, ranges)
    parts = min(CUTS, -(-ranges // cuts))
    marks = sorted(set(rows.approxQuantile("x", [i / cuts for i in range(1, cuts)], 0.1 / cuts))) if cuts > 1 else []
    ranged = df.withColumn("__x", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))))
    if marks:
        ranged = Bucketizer(splits=[float("-inf"), *marks, float("inf")], inputCol="__x", outputCol="__cut").transform(ranged).withColumn("__cut", F.col("__cut").cast("int"))
        ends = [low, *marks, high]
        start, end = (F.get(F.array(*[F.lit(float(x)) for x in xs]), F.col("__cut")) for xs in (ends[:-1], ends[1:]))
        part = F.floor(F.try_divide(F.col("__x") - start, end - start) * parts)
        part = F.when(F.col("__x") > start, F.least(F.coalesce(part, F.lit(0)), F.lit(parts - 1))).otherwise(0)
        ranged = ranged.withColumn("__range", F.col("__cut").cast("long") * parts + part)
    else:
        ranged = ranged.withColumns({"__cut": F.lit(0), "__range": F.lit(0).cast("long")})
    ranged = ranged.drop("__x")
    first = F.min(F.struct(F.col(order).isNotNull().alias("some"), F.col(order).cast("long").alias("first")))
    firsts = cut(ranged.groupBy("__cut", "__range").agg(first.alias("f")).select("__cut", "__range", "f.first"))
    lasts = {r["__cut"]: r["last"] for r in firsts.groupBy("__cut").agg(F.max("__range").alias("last")).collect()}  # CUTS rows at most
    found = sorted(lasts)
    before = F.get(F.array(*[F.lit(lasts[found[i - 1]]).cast("long") for i in range(len(found))]), F.array_position(F.array(*map(F.lit, found)), F.col("__cut")).cast("int") - 1) if found else F.lit(0).cast("long")
    to = F.coalesce(F.lag("__range").over(Window.partitionBy("__cut").orderBy("__range")), before)
    tails = if_few(cut(firsts.select(F.col("__range").alias("__r"), F.col("first").alias("__first"), to.alias("__to"))))
    met = (F.col("__range") == F.col("__r")) & F.col(order).cast("long").eqNullSafe(F.col("__first"))
    tail = ranged.join(tails, met).drop("__r", "__first", "__range").withColumnRenamed("__to", "__range")
    both = ranged.withColumn("__tail", F.lit(False)).unionByName(tail.withColumn("__tail", F.lit(True)))
    return both.drop("__cut").repartition("__range").sortWithinPartitions("__range", "__tail", F.col(order).asc_nulls_first(), tie)


def edited_halves(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has its last half (rounded down, in code points) replaced by the first as many, or all, code points
    of the next row's text; rows are in ascending id, nulls first, ties by text, and the first follows the last. A null
    text is an empty one. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    An empty table gives no rows.
    """
    bound_batches(df.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def row(i, text, own, after, other):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = own if edited == text else sketch(edited, k, s, size)
        return i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(near), likeness(own, near, size), likeness(own, other, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, where = None, None  # the row that waits for its successor, and its range
        for batch in batches:
            for part in blocks(batch, "text"):
                out = []
                for i, x, at, tail in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "__range", "__tail"))):
                    x = x or ""
                    if tail and last is None:
                        continue
                    own = sketch(x, k, s, size)
                    if last is not None:
                        assert at == where
                        out.append(row(*last, x, own))
                    last, where = None if tail else (i, x, own), at
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds)], names=names)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_next(rows, "doc_id", "text").select("doc_id", "text", "__range", "__tail").mapInArrow(run, schema)
