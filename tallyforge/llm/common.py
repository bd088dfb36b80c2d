"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.plans.checkpoints import checkpoint_root, cut

__all__ = ["bound_batches", "blocks", "cut", "few", "if_few", "if_small", "labelled_sample", "shared_folder", "sieve_bits", "sieved", "stored", "table", "texts_of_sample", "with_arrow", "word_count"]

#: Text bytes that one numpy or Python step holds at a time inside a task.
BLOCK_BYTES = 1 << 19

#: Bytes of an Arrow batch between the JVM and a Python worker. Rows of text are long: Spark's default of 10,000 rows would hold tens of MB on both sides.
BATCH_BYTES = 4 << 20

#: The ASCII white space that separates words in every contract of this package.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the context's checkpoint folder, for tables that a job writes and reads again."""
    return f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Has the session cut its Arrow batches at BATCH_BYTES, unless the job's configuration sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` that hold about ``limit`` bytes of ``column`` each, one row at least."""
    sizes = batch.column(column).nbytes if batch.num_rows else 0
    step = max(1, int(batch.num_rows * limit / max(sizes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def with_arrow(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``fields`` that the function made by ``make`` computes from each block.

    ``make`` runs once a task. A column of ``df`` with an output's name is replaced; those in ``drop`` go.
    """
    bound_batches(df.sparkSession)
    new = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    schema = T.StructType(kept + fields)
    out_names = names + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in blocks(batch, column):
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + step(part), names=out_names)

    return df.mapInArrow(run, schema)


def word_count(text: str | F.Column) -> F.Column:
    """Words of a text, separated by ASCII white space; a null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(f"[^{SPACE}]+")).cast("long"), F.lit(0).cast("long"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the job's folder under ``spark.checkpoint.dir`` and read back, for tables that are read in parts."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows that may be broadcast after a count: the driver collects them, makes a hashed table of them and keeps its blocks, about 25 MB in all.
FEW = 100_000


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` (checkpointed or stored, of a few numbers a row) marked for broadcast if it has up to ``most`` rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def few(rows: int, times: int = 1) -> bool:
    return rows <= times * FEW


def if_small(df: DataFrame, rows: int, times: int = 1) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, a bound of its rows that is known without another count, is few; ``times`` as many where texts would be shuffled else."""
    return F.broadcast(df) if few(rows, times) else df


def labelled_sample(labels: DataFrame, label: str, sample: int, seed: int) -> tuple[DataFrame | None, dict[int, int]]:
    """(doc_id, y) of about ``sample`` ids of each label, 0 and 1, or of all there are, chosen by a seeded hash of the id, and how many ids each label has; None without both labels."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None, counts
    share = F.when(F.col("y") == 1, F.lit(sample / counts[1])).when(F.col("y") == 0, F.lit(sample / counts[0]))
    return cut(known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)), counts


def texts_of_sample(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text): one row for each of ``chosen`` (doc_id, y) that ``docs`` has, however often it repeats the id: the least of its texts, a null being empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(if_few(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


#: Bits of a sieve at most: 8 MB as a broadcast table at any size of the input, of which the driver holds several copies while it is made. Bits for each key below that.
SIEVE_BITS, SIEVE_SHARE = 1 << 26, 64


def sieve_bits(keys: int) -> int:
    """Bits of a sieve for so many keys: one in SIEVE_SHARE of the other rows or fewer passes it, and more only beyond the sieve's own bound; the exact join drops those."""
    return min(SIEVE_BITS, max(1 << 15, 1 << (SIEVE_SHARE * keys).bit_length()))


def sieved(df: DataFrame, columns: list[str | F.Column], keys: DataFrame, names: list[str], out: str = "__maybe", bits: int = SIEVE_BITS) -> DataFrame:
    """``df`` with ``out``: false only where ``columns`` are surely none of ``keys`` (``names``), true for all that are and a few others.

    The keys' hashes make a bitmap, whose pieces of 4 KB are broadcast: rows of long texts that no key names needn't be shuffled for a join. Nulls are
    values. An exact join has to follow.
    """
    place = lambda cs: F.pmod(F.xxhash64(*cs), F.lit(bits))
    piece = lambda c: F.bitmap_bucket_number(c)
    pieces = keys.select(place(names).alias("__p")).groupBy(piece(F.col("__p")).alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("__p"))).alias("__map"))
    placed = df.withColumn("__p", place(columns)).withColumn("__n", piece(F.col("__p")))
    bit = F.expr("cast(conv(hex(substring(__map, cast(bitmap_bit_position(__p) div 8 + 1 as int), 1)), 16, 10) as int) >> cast(bitmap_bit_position(__p) % 8 as int) & 1")
    joined = placed.join(F.broadcast(cut(pieces)), F.col("__n") == F.col("__piece"), "left")
    return joined.withColumn(out, F.coalesce(bit == 1, F.lit(False))).drop("__p", "__n", "__piece", "__map")
