"""Dropping or flipping an exact share of a group's positives, per client."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions import same_value
from evenhand.operators.ranks import at_bounds, cut_classes, hash_order
from evenhand.plans.runtime import attach, settle
from evenhand.spec import FairSpec, Modification, plan_extent, plan_table, require_columns, require_rate


def _draw(df: DataFrame, spec: FairSpec, hit: Column, carried: Sequence[str], drop: Column, flip: Column,
          seed: int) -> DataFrame:
    """Drop the first part of the hit rows in hash order and flip the next part.

    Dropping and then flipping the same group are one draw: the flipped rows follow the dropped ones in the
    order, and their number is a share of what the drop leaves.
    """
    rows = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    rows, order = hash_order(rows, spec.key, seed, only=F.col("__hit"))
    dropped = F.floor(F.col("total") * drop).cast("long")
    flipped = F.floor((F.col("total") - dropped) * flip).cast("long")
    cutting = at_bounds([dropped, dropped + flipped])
    drawn = cut_classes(rows, spec.client, order, cutting, "__class", only="__hit", carried=carried)
    kept = drawn.where("__class is null or __class > 0")
    label = F.when(F.col("__class") == 1, F.lit(False)).otherwise(F.col(spec.label).cast("boolean"))
    dtype = df.schema[spec.label].dataType
    return kept.withColumn(spec.label, label.cast(dtype)).select(*df.columns)


def drop_positive(df: DataFrame, spec: FairSpec, pred: Column, rate: float, seed: int = 42) -> DataFrame:
    """Remove ``floor(n * rate)`` of the n positives of each client that satisfy ``pred``."""
    require_rate(rate)
    hit = pred & F.col(spec.label).cast("boolean")
    return _draw(df, spec, hit, (), F.lit(float(rate)), F.lit(0.0), seed)


def flip_positive(df: DataFrame, spec: FairSpec, pred: Column, rate: float, seed: int = 42) -> DataFrame:
    """Make ``floor(n * rate)`` of the n positives of each client that satisfy ``pred`` negative."""
    require_rate(rate)
    hit = pred & F.col(spec.label).cast("boolean")
    return _draw(df, spec, hit, (), F.lit(0.0), F.lit(float(rate)), seed)


def apply_modifications(
    df: DataFrame, spec: FairSpec, plan: Iterable[Modification] | DataFrame, seed: int = 42
) -> DataFrame:
    """Apply a plan: for each client its steps in ``seq`` order, dropping and then flipping in each.

    All clients having an s-th step are treated together, so the number of jobs follows the longest plan and
    not the number of clients. The plan names a client by the first client column; its columns must be among
    those of ``df``.
    """
    if isinstance(plan, DataFrame):
        table = plan = settle(plan)
    else:
        plan = list(plan)
        table = plan_table(df.sparkSession, plan)
    extent = plan_extent(plan)
    size, columns = extent.rows * len(table.columns), extent.columns
    require_columns(df, columns)
    client = spec.client[0]
    for step in extent.steps:
        now = table.where(F.col("seq") == step).select(
            F.col("client").alias("__client"), F.col("column").alias("__column"), F.col("value").alias("__value"),
            F.col("drop_rate").alias("__drop"), F.col("flip_rate").alias("__flip"),
            F.col("column2").alias("__column2"), F.col("value2").alias("__value2"),
        )
        marked = attach(df.withColumn("__client", F.col(client).cast("string")), now, ["__client"], size, spec.key)

        def matches(column: str, value: str) -> Column:
            found = F.lit(False)
            for c in columns:
                same = same_value(F.col(c), df.schema[c].dataType, F.col(value))
                found = F.when(F.col(column) == c, same).otherwise(found)
            return found

        second = F.col("__column2").isNull() | F.col("__value2").isNull() | matches("__column2", "__value2")
        hit = F.col("__column").isNotNull() & matches("__column", "__value") & second
        hit = hit & F.col(spec.label).cast("boolean")
        drawn = _draw(marked, spec, hit, ("__drop", "__flip"), F.col("__drop"), F.col("__flip"), seed)
        df = drawn.select(*df.columns)
    return df


def latest_modification(log: DataFrame, client: str = "state") -> DataFrame:
    """The last entry of each client in a log of several calibration rounds: the one with the largest rate.

    Entries that a log marks as not applied are left out.
    """
    log = log.where("applied").drop("applied") if "applied" in log.columns else log
    return log.groupBy(client).agg(
        F.max_by(F.struct(*[c for c in log.columns if c != client]),
                 F.struct("drop_rate", *[c for c in log.columns if c not in (client, "drop_rate")])).alias("last")
    ).select(client, "last.*")
