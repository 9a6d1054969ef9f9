"""Cutting lineage, and joining small tables to large ones without relying on their being small."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions import all_of

# A table is broadcast only when its counted cells (rows times values per row) stay below this.
BROADCAST_CELLS = 200_000
# Copies of a table that is too large to broadcast, so that a hot key is spread over this many tasks at least.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names, or our own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="evenhand-"))
        current = spark.sparkContext.getCheckpointDir()
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it in the shared folder, so that lost executors do not matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write a table that will be read many times to the shared folder as Parquet, and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing will read again."""
    session = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def join_alike(one: DataFrame, two: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the keys come from the first table."""
    renamed = two.select(*[F.col(c).alias(f"__key_{c}") if c in keys else F.col(c) for c in two.columns])
    on = all_of([F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return one.join(renamed, on, how).drop(*[f"__key_{k}" for k in keys])


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    size: int,
    spread: Sequence[str] = (),
    how: str = "left",
    limit: int = BROADCAST_CELLS,
) -> DataFrame:
    """Join ``table`` (unique on ``keys``) to ``rows``; ``size`` is its counted number of cells.

    Up to ``limit`` the rows stay where they are and the table is broadcast. Beyond it both sides are
    shuffled by key and by a salt made from the ``spread`` columns, so a key holding a large part of the
    rows is shared out over as many tasks as a quarter of the shuffle partitions, at least ``SALTS``.
    """
    renamed = table.select(*[F.col(c).alias(f"__key_{c}") if c in keys else F.col(c) for c in table.columns])
    on: list[Column] = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    if size <= limit:
        renamed = F.broadcast(renamed)
    else:
        salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
        salt = F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(salts)).cast("int")
        rows = rows.withColumn("__salt", salt)
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        renamed = renamed.withColumn("__copy", copies)
        on.append(F.col("__salt") == F.col("__copy"))
    joined = rows.join(renamed, all_of(on), how)
    return joined.drop(*[f"__key_{k}" for k in keys], "__salt", "__copy")


def gather(table: DataFrame, per_row: Column | int = 1) -> DataFrame:
    """A settled table as one partition if it is counted to be small, so that what follows from it needs no shuffle."""
    return table.coalesce(1) if count_cells(table, per_row) <= BROADCAST_CELLS else table


def count_cells(table: DataFrame, per_row: Column | int = 1) -> int:
    """Number of values of a settled table, for ``attach``."""
    per_row = F.lit(per_row) if isinstance(per_row, int) else per_row
    return table.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("n")).first()["n"]
