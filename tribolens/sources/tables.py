"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tribolens.plans.storage import new_table_path
from tribolens.sources.headers import AmbiguousHeader, header_key

ROW_KEY = "source_row"
TEXT_ROWS_PER_FILE = 1_000_000


def load_table(spark: SparkSession, path: str, row_key: bool = False, multi_line: bool = False) -> DataFrame:
    """Read a CSV or Parquet table; any other extension is an error.

    CSV cells stay text: types are coerced column by column later. With `row_key` a scan also carries a stable key
    made of file name and position, for tables that have no unique key of their own; a CSV table is staged as
    Parquet for it once.
    `multi_line` accepts line breaks inside CSV cells, at the price of one task per file.
    """
    lowered = path.rstrip("/").lower()
    if lowered.endswith(".csv"):
        _reject_case_twins(spark, path)
        df = (
            spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
            .option("mode", "PERMISSIVE").csv(path)
        )
        if not row_key:
            return df
        # Rows of a CSV scan have no stable position; those of its staged copy have.
        staged = new_table_path(spark)
        df.write.parquet(staged)
        lowered, path = ".parquet", staged
    if lowered.endswith(".parquet"):
        df = spark.read.parquet(path)
        if not row_key:
            return df
        position = F.lpad(F.col("_metadata.row_index").cast("string"), 14, "0")
        return df.select("*", F.concat_ws(":", F.col("_metadata.file_name"), position).alias(ROW_KEY))
    raise ValueError(f"unsupported table {path!r}: use .csv or .parquet")


def _reject_case_twins(spark: SparkSession, path: str) -> None:
    """A case-insensitive reader renames twin headers silently, so look at the header line itself."""
    first = spark.read.text(path).first()
    names = [] if first is None else [name.strip().strip('"') for name in first[0].split(",")]
    seen: dict[str, str] = {}
    for name in names:
        key = header_key(name)
        if key and key in seen:
            raise AmbiguousHeader(f"headers {[seen[key], name]!r} differ only in case or punctuation; rename one")
        seen[key] = name


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that has fewer partitions than cores one per core.

    A large table has more splits than cores and is returned as it is; only a small one, whose single row group
    would otherwise keep one core busy, is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def for_text_sink(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, so that a CSV sink accepts them."""
    return df.select(*[
        F.to_json(field.name).alias(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(field.name)
        for field in df.schema.fields
    ])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at `path`.

    CSV repeats every text in full, so its files are compressed, and of bounded length, since a compressed file is read by one task.
    """
    writer = (for_text_sink(df) if fmt == "csv" else df).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", "\"").option("compression", "gzip").option(
            "maxRecordsPerFile", TEXT_ROWS_PER_FILE)
    writer.format(fmt).save(path)


def write_json_row(df: DataFrame, path: str) -> None:
    """Write a one-row result as JSON."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
