"""How sensitive values are distributed over clients and partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.spec import FairSpec, require_choice, require_columns


def attribute_rows(df: DataFrame, attributes: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """One row per attribute: (kept..., ``attribute``, ``value`` as text)."""
    pairs = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]
    return df.select(*kept, F.inline(F.array(*pairs)))


def attribute_counts(df: DataFrame, attributes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., ``attribute``, ``value``, ``n``).

    Rows are first counted per combination of all attributes, and only these counts are unpivoted, so the
    table is scanned once and not multiplied by the number of attributes.
    """
    combined = df.groupBy(*by, *attributes).agg(F.count(F.lit(1)).alias("n"))
    return attribute_rows(combined, attributes, [*by, "n"]).groupBy(*by, "attribute", "value").agg(
        F.sum("n").alias("n"))


def value_counts(
    df: DataFrame, spec: FairSpec, partition: str | None = "partition_id", unit: str = "absolute"
) -> DataFrame:
    """Rows per sensitive value of each client and partition, or its percentage; nulls are left out."""
    require_choice("unit", unit, ("absolute", "percent"))
    by = [*spec.client, *([partition] if partition else [])]
    require_columns(df, [*by, *spec.sensitive])
    counts = attribute_counts(df, spec.sensitive, by).where("value is not null")
    if unit == "absolute":
        return counts
    whole = Window.partitionBy(*by, "attribute")
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(whole)).drop("n")


def by_frequency(counts: DataFrame) -> DataFrame:
    """Counts with the most frequent value first."""
    return counts.orderBy(F.desc("n"), "value")


def proportions(
    df: DataFrame,
    spec: FairSpec,
    partition: str = "partition_id",
    digits: int = 3,
    overall_nulls: bool = False,
) -> DataFrame:
    """(``level``, client..., partition, ``attribute``, ``value``, ``share``) overall, per client and per partition.

    Shares are rounded half to even. With ``overall_nulls`` null values count in the overall total.
    """
    levels = [*spec.client, partition]
    counts = attribute_counts(df, spec.sensitive, levels)
    every = [F.col(c) for c in (*levels, "attribute", "value")]
    sets = [[F.col(c) for c in (*levels[:i], "attribute", "value")] for i in (0, len(spec.client), len(levels))]
    rolled = counts.groupingSets(sets, *every).agg(
        F.sum("n").alias("n"),
        (F.grouping(spec.client[0]) + F.grouping(partition)).alias("rolled"),
    )
    if not overall_nulls:
        rolled = rolled.where("value is not null")
    level = F.element_at(F.array(*map(F.lit, ("partition", "client", "overall"))), F.col("rolled") + 1)
    whole = Window.partitionBy("rolled", *levels, "attribute")
    counted = F.when((F.col("rolled") == 2) | F.col("value").isNotNull(), F.col("n"))
    share = F.bround(F.col("n") / F.sum(counted).over(whole), digits)
    made = rolled.select(level.alias("level"), *levels, "attribute", "value", share.alias("share"))
    return made.where("level = 'overall' or value is not null") if overall_nulls else made


def proportions_json(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    """The shares of an attribute's values as one JSON object per level, client and attribute."""
    entries = F.sort_array(F.collect_list(F.struct("value", "share")))
    return shares.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias("shares"))


def profile(df: DataFrame, spec: FairSpec) -> DataFrame:
    """One row: the number of rows, and the columns without the label as JSON."""
    columns = [c for c in df.columns if c != spec.label]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "columns", F.to_json(F.array(*[F.lit(c) for c in columns])))
