"""Reading person-level tables of chosen clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.spec import DEFAULT_CLIENTS, INCOME_FEATURES

# The income table's columns and types. Codes are doubles, as group labels print them.
INCOME_SCHEMA = T.StructType(
    [T.StructField("client", T.StringType()), T.StructField("row_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in
       INCOME_FEATURES]
    + [T.StructField("PINCP", T.BooleanType())]
)


def read_clients(
    spark: SparkSession,
    path: str,
    clients: Sequence[str] | None = None,
    year: str | int | None = None,
    horizon: str | None = None,
    client: str = "client",
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Rows of the named clients, year and horizon; all clients when none are named.

    The conditions are plain comparisons, so they prune partition directories and reach the file scan.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if clients is not None:
        df = df.where(F.col(client).isin(*clients))
    if year is not None:
        df = df.where(F.col("year") == F.lit(year))
    if horizon is not None:
        df = df.where(F.col("horizon") == F.lit(horizon))
    return df


# Columns that say where a row stood in its files.
ROW_ORDER = ("file_order", "row_order")


def with_row_order(df: DataFrame) -> DataFrame:
    """Rows just read from files with ``file_order``, the name of a row's file, and ``row_order``, its place in there.

    Part files are written in the order of their names, so both together are the order of the table as it was written.
    """
    return df.select("*", F.col("_metadata.file_name").alias(ROW_ORDER[0]), F.col("_metadata.row_index").alias(ROW_ORDER[1]))


def default_partitions(clients: Sequence[str] | None = None) -> dict[str, int]:
    """One partition for each named client, or for each of the default ones."""
    return {c: 1 for c in (clients or DEFAULT_CLIENTS)}
