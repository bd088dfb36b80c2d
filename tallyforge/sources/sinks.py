"""Sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import excel_safe


def write_json(df: DataFrame, path: str) -> None:
    """K1, K7: JSON lines; the committer publishes whole files or none."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


class SourceIndex:
    """K2: a table in a folder, whose sources are replaced one run at a time and whose versions are whole.

    ``data`` has the rows of each run in files of any sources; a run's ``manifest`` names the files that hold a source's rows; ``current/version=n``, written last
    in one file, names version n's manifest. Readers take the latest published version, so a run that fails at any point, or is still going, leaves the one before.
    Sources need no folder, bucket or file of their own: a file may hold rows of sources that a later version takes elsewhere. Two runs that start from
    one version don't both publish the next: the second fails on the version's folder.
    """

    def __init__(self, spark: SparkSession, path: str, source: str = "source_file_id"):
        self.spark, self.path, self.source = spark, path, source

    def version(self) -> int:
        """The latest published version; 0: none."""
        published = self._published()
        return 0 if published is None else published.agg(F.max("version")).first()[0] or 0

    def _published(self) -> DataFrame | None:
        """(version, manifest) of all published versions."""
        try:
            return self.spark.read.schema("manifest string, version long").parquet(f"{self.path}/current")
        except AnalysisException:
            return None

    def _manifest(self, version: int) -> DataFrame:
        name = self._published().where(F.col("version") == version).first()["manifest"]
        return self.spark.read.parquet(f"{self.path}/manifest/{name}")

    def upsert(self, df: DataFrame, removed: DataFrame | None = None) -> int:
        """Publishes a version with the rows of ``df`` in place of all rows of its sources, and without those of the sources in ``removed``; its number.

        A null source is a source like others. Without rows nothing but the removal changes.
        """
        version = self.version()
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(run)
        rows = self.spark.read.schema(df.schema).parquet(run)
        held = rows.select(F.col(self.source).alias("source"), F.input_file_name().alias("file")).distinct()
        if version:
            gone = rows.select(F.col(self.source).alias("source")).distinct()
            if removed is not None:
                gone = gone.union(removed.select(F.col(self.source).alias("source"))).distinct()
            before, gone = self._manifest(version).alias("b"), gone.alias("g")
            held = before.join(gone, F.col("b.source").eqNullSafe(F.col("g.source")), "left_anti").select("source", "file").unionByName(held)
        name = uuid.uuid4().hex
        held.write.parquet(f"{self.path}/manifest/{name}")
        self.spark.range(1).select(F.lit(name).alias("manifest")).coalesce(1).write.parquet(f"{self.path}/current/version={version + 1}")
        return version + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a published version, the latest if none is given."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("no version was published")
        manifest = self._manifest(version)
        files = [r["file"] for r in manifest.select("file").distinct().collect()]  # names of files, not rows
        if not files:
            return self.spark.read.parquet(f"{self.path}/data/*").where("false")
        rows = self.spark.read.parquet(*files).withColumn("__file", F.input_file_name()).alias("r")
        live = manifest.withColumnsRenamed({"source": "__source", "file": "__name"})
        return rows.join(live, (F.col("__file") == F.col("__name")) & F.col(f"r.{self.source}").eqNullSafe(F.col("__source")), "left_semi").drop("__file")

    def stale_files(self, keep: int = 1) -> DataFrame:
        """(file): those that none of the ``keep`` latest versions names, for a clean-up."""
        latest = self.version()
        kept = [self._manifest(v).select("file") for v in range(max(1, latest - keep + 1), latest + 1)]
        every = reduce(DataFrame.union, [self._manifest(v).select("file") for v in range(1, latest + 1)]).distinct()
        return every.join(reduce(DataFrame.union, kept).distinct(), "file", "left_anti")


def publish_catalog(tables: dict[str, DataFrame], prefix: str = "catalog_", bucketed: dict[str, tuple[int, str]] | None = None) -> None:
    """K3: overwrites the catalogue's tables; those in ``bucketed`` are bucketed and sorted by a column, so that lookups join without a shuffle."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if bucketed and name in bucketed:
            n, column = bucketed[name]
            writer = writer.bucketBy(n, column).sortBy(column)
        writer.saveAsTable(prefix + name)


def quote_table(items: DataFrame) -> DataFrame:
    """K4: export rows: texts made safe, quantity formulas by unit, amounts of other than PASS items left out."""
    row = F.col("sequence") + 1
    formula = F.when(F.col("unit") == "m", F.format_string("=J%d*K%d/1000", row, row)).when(F.col("unit") == "㎡", F.format_string("=I%d*J%d*K%d/1000000", row, row, row)).when(F.col("unit").isin("件", "套"), F.format_string("=K%d", row))
    return items.withColumns({"name": excel_safe(F.col("name")), "quantity_formula": formula, "amount": F.when(F.col("status") == "PASS", F.col("amount"))})


def review_pack(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """K5: one JSON document for each key: all its candidates with their provenance, ordered."""
    rest = [c for c in candidates.columns if c != key and c not in order]
    packed = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("candidates"))
    return packed.select(key, F.to_json(F.struct(key, "candidates")).alias("document"))


def markdown_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """K6: the rows as lines of a Markdown table, nulls as blanks; the header is ``markdown_header``. Ordering is the writer's."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))


def markdown_header(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
