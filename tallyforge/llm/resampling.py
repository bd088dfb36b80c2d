"""Importance resampling towards a target: hashed runs of words weigh documents, and seeded Gumbel noise draws them.

A document's features are its runs of 1 to n words. The CRC of a run is that of the run without its last word, extended
by a space and that word, so a scan keeps the running states of the last n starts and makes n of each word. Steps of a
megabyte hand their last states on, so a text of any length is scanned once, in bounded memory.

Counts of both sides are sums of one array a task. The gains of all buckets are one small array, which the second scan
adds up per document: to scan twice is cheaper than to store three buckets for each word of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import bound_batches, cut, if_few, with_arrow

#: Bytes of a text that one step of the scan splits into words.
STEP = 1 << 20

_LETTERS = bytes(range(48, 58)) + bytes(range(97, 123))
#: Lower case of A to Z; digits, letters and all bytes of other characters as they are; a space for the rest.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _LETTERS else 32 for b in range(256))


def word_steps(text: str) -> Iterator[list[bytes]]:
    """The words of a text in steps of about STEP bytes."""
    data = text.encode().translate(_FOLDED)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + STEP)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def feature_crcs(text: str, n: int) -> Iterator[np.ndarray]:
    """The CRCs of all runs of 1 to ``n`` words, in arrays of one step and length each."""
    ring: list[list[int]] = [[] for _ in range(n - 1)]  # for each length but the longest the state of the run that ends at the last word so far
    for words in word_steps(text):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        states = list(map(crc32, words))
        yield np.array(states, np.int64)
        for k in range(n - 1):
            running = (ring[k] + states)[:-1]  # of the runs that end before a word; a text's first words have none
            ring[k] = states[-1:]
            states = list(map(crc32, spaced[len(spaced) - len(running) :], running))
            yield np.array(states, np.int64)


def bucket_counts(df: DataFrame, text: str = "text", n: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket that has any; nulls are empty texts."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        waiting, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                for crcs in feature_crcs(value.as_py() or "", n):
                    waiting.append(crcs)
                    size += len(crcs)
                    if size > STEP:
                        total += np.bincount(np.concatenate(waiting) % buckets, minlength=buckets)
                        waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting) % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Each bucket's gain from the counts (bucket, n) of both sides: a thousand times the log ratio of smoothed shares, rounded down."""
    s, t = ([0] * buckets, [0] * buckets)
    for side, counts in ((s, source), (t, target)):
        for r in counts.collect():  # ``buckets`` rows at most
            side[r["bucket"]] = r["n"]
    of_s, of_t = sum(s) + buckets, sum(t) + buckets
    return np.array([floor(1000 * log(float((b + 1) * of_s) / float((a + 1) * of_t))) for a, b in zip(s, t)], np.int64)


def with_weights(df: DataFrame, gain: np.ndarray, text: str = "text", n: int = 3) -> DataFrame:
    """``df`` with n_words, n_features and weight (the sum of the gains of all features) in place of its text; columns of ``df`` with these names go."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def make():
        gain_ = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            found = []
            for x in batch.column(text).to_pylist():
                words = features = weight = 0
                for k, crcs in enumerate(feature_crcs(x or "", n)):
                    words += len(crcs) if k % n == 0 else 0
                    features += len(crcs)
                    weight += int(gain_[crcs % len(gain_)].sum())
                found.append((words, features, weight))
            return [pa.array(x, pa.int64()) for x in (zip(*found) if found else ((), (), ()))]

        return step

    return with_arrow(df, text, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")], make, drop=(text,))


def noise(doc_id: str | F.Column, seed: int) -> F.Column:
    """Gumbel noise of an id, in thousandths, rounded down; a null id is an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, order: list[F.Column], out: str = "rank") -> DataFrame:
    """``df`` with ``out``: each row's place, from 1, in ``order``.

    Rows are sorted in ranges and numbered within each, and the ranges' sizes give the rest, so no task holds all. Rows that are equal in
    ``order`` are dealt over ranges by their number.
    """
    names = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField("__range", T.IntegerType()), T.StructField("__place", T.LongType())])
    sort = df.withColumn("__n", F.monotonically_increasing_id()).orderBy(*order, "__n").drop("__n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(at + 1, at + 1 + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(np.full(batch.num_rows, own, np.int32)), pa.array(place)], names=names + ["__range", "__place"])

    placed = cut(sort.mapInArrow(run, schema))
    sizes = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    offsets = df.sparkSession.createDataFrame(sorted(before.items()), "__range int, __before long") if before else None
    if offsets is None:
        return placed.withColumn(out, F.col("__place")).drop("__range", "__place")
    return placed.join(F.broadcast(offsets), "__range").withColumn(out, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 5, n: int = 3, buckets: int = 10_000, seed: int = 42, least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``.

    Of the N rows with ``least_words`` words or more, the floor(percent * N / 100) of the highest scores get ranks from 1, ties going to
    the smaller id; the others have none. A null text has no words, a null id counts as an empty one in the noise and comes first among ties, repeated
    rows are rows like others, texts of any length are scanned in steps, other columns are left out, and empty tables are allowed on both sides.
    """
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, text, n, buckets), buckets)
    weighed = with_weights(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), gain, "text", n)
    fits = F.col("n_words") >= least_words
    scored = cut(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise("doc_id", seed)).alias("score"), fits.alias("__fits")))  # the sort reads it twice
    placed = ranked(scored, [F.desc("__fits"), F.desc("score"), F.asc_nulls_first("doc_id")])
    able = placed.where("__fits").count()
    drawn = F.col("__fits") & (F.col("rank") <= percent * able // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))
