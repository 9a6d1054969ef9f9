"""Writing and reading one folder, or one file, per client partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.spec import require_choice, require_columns

FORMATS = ("parquet", "csv")
# Client files are named by a two-letter client and an underscore; reports beside them are not.
CLIENT_FILES = "??_*.csv"


def save_clients(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    by: Sequence[str] = ("split", "partition_id"),
    rows_per_file: int = 5_000_000,
    mode: str = "errorifexists",
) -> None:
    """Write the table with one folder per split and partition.

    Rows are rebalanced by split and partition first, so that a folder gets few files; Spark divides those that
    are large over several tasks. Files are cut at ``rows_per_file``. No row number is written, so it cannot
    come back as a feature.
    """
    require_choice("format", fmt, FORMATS)
    require_columns(df, by)
    writer = df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", rows_per_file)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def load_clients(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """Read what ``save_clients`` wrote; the partition columns come back from the folder names."""
    require_choice("format", fmt, FORMATS)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def save_client_csvs(df: DataFrame, path: str, split: str = "split", partition: str = "partition_id") -> None:
    """Write every partition of every split as files in a folder named ``{split}_{i}.csv`` below ``path``.

    A partition of any size is written by as many tasks as its size asks for; ``load_client_csvs`` reads folders and
    single files of this name alike.
    """
    require_columns(df, (split, partition))
    named = df.withColumn("__file", F.concat(F.col(split).cast("string"), F.lit("_"), F.col(partition).cast("string"), F.lit(".csv")))
    rows = named.drop(split, partition).hint("rebalance", "__file")
    rows.write.partitionBy("__file").option("header", True).csv(path)


def load_client_csvs(
    spark: SparkSession, path: str, schema: T.StructType, client: str = "client", pattern: str = CLIENT_FILES
) -> DataFrame:
    """Read CSV files named ``{client}_{i}.csv``, or folders ``__file={client}_{i}.csv``, with the client from the name.

    Files that are not named so, such as reports, are left out.
    """
    reader = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    found = reader.csv(path).withColumn("__name", F.regexp_extract("_metadata.file_path", r"/(?:__file=)?([^/]*\.csv)(?:/[^/]*)?$", 1))
    alike = "^" + "".join({"?": "[^/]", "*": "[^/]*", ".": r"\."}.get(c, c) for c in pattern) + "$"
    return found.where(F.col("__name").rlike(alike)).select(F.substring("__name", 1, 2).alias(client), *schema.fieldNames())
