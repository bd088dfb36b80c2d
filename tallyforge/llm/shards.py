"""Two-pass external shuffle into shards.

Pass one scatters whole records over buckets by a seeded hash; there are as many as keep the mean bucket at
``bucket_bytes``. Pass two holds one bucket at a time, shuffles it by Fisher-Yates and writes it. The buckets in a
row are one random order of all rows, and shard s takes the rows from ceil(s * rows / shards) on. Rows that are equal are
scattered as well, by their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import bound_batches, cut, if_few

#: Text bytes of a bucket, on average.
BUCKET_BYTES = 8 << 20


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random order of 0 to n - 1, the same for the same seed."""
    order = list(range(n))
    picks = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def bucket_offsets(counts: DataFrame, group: int = 4096) -> DataFrame:
    """(bucket, rows) with ``before``, the rows of all lower buckets: sums within groups of buckets, then over the groups."""
    grouped = counts.withColumn("g", F.expr(f"bucket div {group}"))
    inner = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 4096 buckets
    sums = grouped.groupBy("g").agg(F.sum("rows").alias("s")).withColumn("over", F.coalesce(F.sum("s").over(outer), F.lit(0))).select("g", "over")
    inside = grouped.withColumn("inside", F.coalesce(F.sum("rows").over(inner), F.lit(0)))
    return inside.join(sums, "g").select("bucket", (F.col("over") + F.col("inside")).alias("before"))


def equal_rows(data: DataFrame, doc_id: str, seed: int, buckets: int, bucket_bytes: int) -> DataFrame | None:
    """(doc_id, crc) of the rows that make a bucket too large because they are equal in both; None if there are none.

    Only keys in buckets of more than twice the mean size are counted. A key that is split has more than an eighth of a bucket's bytes, so there
    are at most eight such keys a bucket.
    """
    sizes = data.groupBy("__bucket").agg(F.sum("__size").alias("bytes")).where(F.col("bytes") > 2 * bucket_bytes)
    large = cut(sizes.select("__bucket"))
    if large.isEmpty():
        return None
    keys = data.join(if_few(large), "__bucket").groupBy(F.col(doc_id).alias("__id"), F.col("__crc").alias("__key")).agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"))
    found = cut(keys.where((F.col("bytes") > bucket_bytes // 8) & (F.col("n") > 1)).select("__id", "__key"))
    return None if found.isEmpty() else if_few(found)


def scattered(data: DataFrame, doc_id: str, seed: int, buckets: int, keys: DataFrame | None, chunk: int = 10_000) -> DataFrame:
    """``data`` with its ``__bucket``: by id and checksum, and for the rows of ``keys`` by the row's number among the equal ones as well.

    Rows that are equal in all columns are counted and written out again from their number, in chunks that are dealt out, so no task
    holds or sorts all of them.
    """
    bucket = lambda *more: F.pmod(F.xxhash64(F.lit(seed), doc_id, "__crc", *more), F.lit(buckets))
    if keys is None:
        return data
    met = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__crc") == F.col("__key"))
    names = [c for c in data.columns if c != "__bucket"]
    copies = data.drop("__bucket").join(keys, met, "left_semi").groupBy(*names).agg(F.count("*").alias("__n"))
    chunks = copies.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {chunk}"))).alias("__c"))
    chunks = chunks.repartition(doc_id, "__crc", "__c")
    last = F.least(F.col("__n"), (F.col("__c") + 1) * chunk) - 1
    numbered = chunks.select(*names, F.explode(F.sequence(F.col("__c") * chunk, last)).alias("__i")).withColumn("__bucket", bucket("__i")).drop("__i")
    return data.join(keys, met, "left_anti").unionByName(numbered)


def shuffled_shards(df: DataFrame, shards: int = 40, seed: int = 0, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` in random order, with ``shard`` and ``slot``: shard sizes differ by one row at most, slots run from 0.

    The bucket hash takes the id and the text's checksum; a bucket is sorted by both before its seeded shuffle, so a
    lost task gives the same rows again. Rows equal in both are alike and may swap; where so many are that they would fill a bucket, their
    number is hashed too. Null ids and texts are values like others. An empty table gives no rows; columns named shard or slot are replaced.
    """
    bound_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in ("shard", "slot")]
    names = [f.name for f in keep]
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    data = df.select(*names, F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("__crc"))
    total, n = df.agg(F.sum(size), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    data = data.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), doc_id, "__crc"), F.lit(buckets)))
    data = scattered(data, doc_id, seed, buckets, equal_rows(data.withColumn("__size", size), doc_id, seed, buckets, bucket_bytes))
    counts = data.groupBy(F.col("__bucket").alias("bucket")).agg(F.count("*").alias("rows"))
    offsets = cut(bucket_offsets(counts)).select(F.col("bucket").alias("__bucket"), F.col("before").alias("__before"))

    def shuffle(bucket: pa.Table) -> pa.Table:
        by_key = pc.sort_indices(bucket, [(doc_id, "ascending"), ("__crc", "ascending")])
        first = bucket.column("__before")[0].as_py()
        order = fisher_yates(len(bucket), [seed, bucket.column("__bucket")[0].as_py()])
        out = bucket.take(by_key).take(pa.array(order)).select(names)
        at = first + np.arange(len(out), dtype=np.int64)
        shard = at * shards // n
        slot = at - -(-shard * n // shards)
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    schema = T.StructType([*keep, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return data.join(if_few(offsets), "__bucket").groupBy("__bucket").applyInArrow(shuffle, schema)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes the shards as Parquet folders ``shard=s`` under ``path``; a bucket's rows go to one shard or two, in slot order."""
    shuffled_shards(df, **options).write.partitionBy("shard").parquet(path)
