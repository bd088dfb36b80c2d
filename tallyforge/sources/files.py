"""File inventories, archives and their checks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Limits:
    """What a package may hold. Fixed values."""

    members: int = 20_000
    file_bytes: int = 2 << 30
    total_bytes: int = 20 << 30
    archive_bytes: int = 5 << 30
    ratio: int = 200
    path_length: int = 1024
    depth: int = 64


RESERVED = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file below ``folder``: path, bytes, suffix, sha256. Contents stay in the readers' tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", F.col("length").alias("bytes"), suffix.alias("suffix"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame, key: str = "path", digest: str = "sha256", groups: int = 256) -> DataFrame:
    """One digest of all files: hashes of the sorted (path, NUL, digest) lines of each of ``groups`` hash groups, hashed again."""
    line = F.concat(F.col(key), F.lit("\0"), F.col(digest))
    parts = files.groupBy(F.pmod(F.crc32(key), F.lit(groups)).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n"), 256).alias("tree"))


def path_problem(path: F.Column, limits: Limits = Limits()) -> F.Column:
    """S3: why a member's path is refused, null if it isn't."""
    parts = F.split(path, "/")
    return (
        F.when(F.coalesce(F.trim(path), F.lit("")) == "", "empty")
        .when(path.rlike(r"^[A-Za-z]:") | path.rlike(r"^[/\\]"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(F.exists(parts, lambda p: p == ".."), "traversal")
        .when(path.rlike(r"[\x00-\x1f<>:\"|?*]"), "character")
        .when(path.rlike(RESERVED), "reserved")
        .when(F.length(path) > limits.path_length, "too_long")
        .when(F.size(parts) > limits.depth, "too_deep")
    )


@F.pandas_udf(T.StringType())
def repaired_name(name: pd.Series) -> pd.Series:
    """S3: a member's name whose CP437 reading is UTF-8 with CJK characters, read as that; else the name itself."""

    def repair(x: str) -> str:
        try:
            out = x.encode("cp437").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return x
        return out if re.search("[㐀-鿿]", out) else x

    return name.map(repair, na_action="ignore")


def zip_members(archives: DataFrame) -> DataFrame:
    """(path, member, bytes, packed, encrypted, link) of each member of ZIP files (path, content); an unreadable archive gives one row with a null member."""
    schema = "path string, member string, bytes long, packed long, encrypted boolean, link boolean"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, i.filename, i.file_size, i.compress_size, bool(i.flag_bits & 1), (i.external_attr >> 28) == 0xA) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, ValueError, OSError):
                    rows.append((path, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return archives.select("path", "content").mapInPandas(read, schema)


def audit_members(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The members with ``problem``, the first reason to refuse them, null for good ones. Sums and collisions are grouped, so one archive's members meet by hash only."""
    sums = members.groupBy("path").agg(F.count("member").alias("__n"), F.sum("bytes").alias("__total"))
    same = members.groupBy("path", F.lower("member").alias("__low")).agg(F.count("*").alias("__same"))
    joined = members.withColumn("__low", F.lower("member")).join(sums, "path").join(same, ["path", "__low"], "left")
    ratio = F.try_divide(F.col("bytes"), F.greatest(F.col("packed"), F.lit(1)))
    problem = (
        F.when(F.col("member").isNull(), "unreadable").when(F.col("__n") > limits.members, "too_many").when(F.col("__total") > limits.total_bytes, "total_too_large")
        .when(F.col("encrypted"), "encrypted").when(F.col("link"), "link").when(path_problem(F.col("member"), limits).isNotNull(), path_problem(F.col("member"), limits))
        .when(F.col("__same") > 1, "collision").when(F.col("bytes") > limits.file_bytes, "too_large").when(ratio > limits.ratio, "ratio")
    )
    return joined.withColumn("problem", problem).drop("__n", "__total", "__same", "__low")


def conversions(attempts: DataFrame, preference: list[str]) -> DataFrame:
    """Per drawing its first successful conversion by the order of ``preference``, or the last error; attempts have drawing, tool, output and error."""
    rank = F.array_position(F.array(*[F.lit(t) for t in preference]), F.col("tool"))
    ranked = attempts.withColumn("__r", F.when(rank > 0, rank).otherwise(len(preference) + 1))
    best = ranked.groupBy("drawing").agg(F.min(F.when(F.col("output").isNotNull(), F.struct("__r", "tool", "output"))).alias("b"), F.max(F.struct("__r", "error"))["error"].alias("error"), F.count("*").alias("attempts"))
    return best.select("drawing", "attempts", F.col("b.tool").alias("tool"), F.col("b.output").alias("output"), F.when(F.col("b").isNull(), F.col("error")).alias("error"))


def read_records(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """JSON rows of a strict schema: a row that can't be read or has unknown keys has them in ``problem``, and nulls elsewhere."""
    text = spark.read.text(path, wholetext=multiline)
    extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(f.name) for f in schema.fields]))
    record = F.from_json("value", schema)
    problem = F.when(F.json_object_keys("value").isNull(), "not an object").when(F.size(extra) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(extra), ",")))
    return text.select(problem.alias("problem"), F.when(problem.isNull(), record).alias("r")).select("problem", "r.*")


def manifest_rows(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """The rows of a payload {"schema_version": "1.0", "rows": [...]}, with their stable positions; other versions give none."""
    payload = spark.read.text(path, wholetext=True).select(F.from_json("value", f"schema_version string, rows array<struct<{row_schema}>>").alias("p"))
    return payload.where("p.schema_version = '1.0'").select(F.posexplode("p.rows").alias("row_id", "r")).select("row_id", "r.*")
