"""Demographic parity and equalized odds of every client, attribute and group in one job.

The table is scanned once into counts per (client, sensitive values, label, prediction); the map side combines
them, so a client holding a large part of the rows is no hot spot. Everything after works on those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions import all_of
from evenhand.operators.splits import first_partitions
from evenhand.plans.runtime import join_alike
from evenhand.spec import LEVELS, METRICS, FairSpec, require_choice


def cells(df: DataFrame, spec: FairSpec) -> DataFrame:
    """Rows per client, combination of sensitive values, label ``y`` and prediction ``p``; counts made before stay as they are."""
    if {"__y", "__p", "n"} <= set(df.columns):
        return df
    spec.check(df)
    as_bit = lambda c: F.col(c).cast("boolean").cast("int")
    counted = df.select(*spec.client, *spec.sensitive, as_bit(spec.label).alias("__y"),
                        as_bit(spec.prediction or spec.label).alias("__p"),
                        (F.col(spec.weight) if spec.weight else F.lit(1)).cast("long").alias("__n"))
    return (counted.where("__y is not null and __p is not null")
            .groupBy(*spec.client, *spec.sensitive, "__y", "__p").agg(F.sum("__n").alias("n")))


def _rank_of(column: str, dtype: T.DataType) -> Column:
    """A value's place in the ascending order of groups: numbers by size, anything else by text."""
    number = isinstance(dtype, (T.NumericType, T.BooleanType))
    return F.struct(
        (F.col(column).cast("double") if number else F.lit(None).cast("double")).alias("number"),
        (F.lit(None).cast("string") if number else F.col(column).cast("string")).alias("text"),
    )


def _member(column: str, dtype: T.DataType) -> Column:
    """A value as it stands inside the label of an intersection: text is quoted."""
    text = F.col(column).cast("string")
    return text if isinstance(dtype, T.NumericType) else F.concat(F.lit("'"), text, F.lit("'"))


def _groups(df: DataFrame, spec: FairSpec, intersect: bool) -> Column:
    """An array of (attribute, group label, group order): one entry per attribute, or one for their tuple."""
    types = {c: df.schema[c].dataType for c in spec.sensitive}
    if intersect:
        members = F.concat_ws(", ", *[_member(c, types[c]) for c in spec.sensitive])
        whole = F.when(all_of([F.col(c).isNotNull() for c in spec.sensitive]),
                       F.concat(F.lit("("), members, F.lit(")")))
        order = F.array(*[_rank_of(c, types[c]) for c in spec.sensitive])
        return F.array(F.struct(F.lit("*".join(spec.sensitive)).alias("attribute"), whole.alias("g"),
                                order.alias("ord")))
    return F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("g"),
                 F.array(_rank_of(c, types[c])).alias("ord"))
        for c in spec.sensitive
    ])


def group_rates(df: DataFrame, spec: FairSpec, intersect: bool = False, empty: str = "zero") -> DataFrame:
    """(client..., ``attribute``, ``g``, ``ord``, ``n``, ``selection_rate``, ``tpr``, ``fpr``) per group.

    Rows whose sensitive value is null belong to no group. A rate over no rows is 0, or null with
    ``empty="null"``.
    """
    require_choice("empty", empty, ("zero", "null"))
    counted = cells(df, spec)
    long = counted.select(*spec.client, "__y", "__p", "n", F.inline(_groups(df, spec, intersect)))
    y, p, n = F.col("__y"), F.col("__p"), F.col("n")

    def rate(hits: Column, rows: Column) -> Column:
        made = F.sum(n * hits) / F.nullif(F.sum(n * rows), F.lit(0))
        return F.coalesce(made, F.lit(0.0)) if empty == "zero" else made

    return long.where("g is not null").groupBy(*spec.client, "attribute", "g", "ord").agg(
        F.sum("n").alias("n"),
        rate(p, F.lit(1)).alias("selection_rate"),
        rate(y * p, y).alias("tpr"),
        rate((1 - y) * p, 1 - y).alias("fpr"),
    )


def _two_rates(rates: DataFrame, metric: str) -> DataFrame:
    """The two rates a metric compares; demographic parity compares one, so it stands in twice."""
    require_choice("fairness metric", metric, METRICS)
    first, second = ("selection_rate", "selection_rate") if metric == "DP" else ("tpr", "fpr")
    return rates.withColumns({"__t": F.col(first), "__f": F.col(second)})


def pair_gaps(rates: DataFrame, spec: FairSpec, metric: str) -> DataFrame:
    """The signed gap of every ordered pair of groups (a group and itself too) of a client and attribute.

    For equalized odds it is the difference in true or in false positive rate, whichever is larger in size,
    ties to the former. The number of pairs is that of category pairs; it does not grow with the rows.
    """
    rates = _two_rates(rates, metric)
    by = [*spec.client, "attribute"]
    left = rates.select(*by, F.col("g").alias("g_i"), F.col("__t").alias("ti"), F.col("__f").alias("fi"))
    right = rates.select(*by, F.col("g").alias("g_j"), F.col("__t").alias("tj"), F.col("__f").alias("fj"))
    dt, df = F.col("ti") - F.col("tj"), F.col("fi") - F.col("fj")
    gap = dt if metric == "DP" else F.when(F.abs(dt) >= F.abs(df), dt).otherwise(df)
    return join_alike(left, right, by).select(
        *by, F.lit(metric).alias("metric"), F.concat_ws("_", "g_i", "g_j").alias("pair"), "g_i", "g_j",
        gap.alias("gap"))


def worst_pairs(rates: DataFrame, spec: FairSpec, metric: str) -> DataFrame:
    """The largest gap of each client and attribute, and the first pair having it in row-major group order.

    No pairs are built. The largest gap is the larger range of the two rates. The first group of the pair is
    the least one reaching it upwards in the true positive rate, or in the false positive rate against some
    group whose true positive rate is not equally far above; the second is the least one completing it. Groups
    without a false positive rate have no gap with anyone; without a true positive rate only the former counts.
    """
    by = [*spec.client, "attribute"]
    every = Window.partitionBy(*by)
    group = F.struct("ord", "g", "__t", "__f")
    t, f, gap = F.col("__t"), F.col("__f"), F.col("__gap")
    rated = _two_rates(rates, metric).where("__f is not null")
    rows = rated.select(*by, "g", "ord", "__t", "__f").withColumns({
        "__t_max": F.max("__t").over(every), "__t_min": F.min("__t").over(every),
        "__f_max": F.max("__f").over(every), "__f_min": F.min("__f").over(every),
    })
    t_range, f_range = F.col("__t_max") - F.col("__t_min"), F.col("__f_max") - F.col("__f_min")
    rows = rows.withColumn("__gap", F.greatest(t_range, f_range)).withColumn(
        "__t_low", F.min(F.when(f == F.col("__f_min"), F.coalesce(t, F.lit(-1e300)))).over(every))
    by_t = (t_range == gap) & (t == F.col("__t_max"))
    by_f = (f_range == gap) & (f == F.col("__f_max")) & F.coalesce(F.col("__t_low") - t < gap, F.lit(True))
    rows = rows.withColumn("__i", F.min(F.when(by_t | by_f, group)).over(every))
    dt, df = F.col("__i.__t") - t, F.col("__i.__f") - f
    completes = (dt == gap) | ((df == gap) & F.coalesce(F.abs(dt) < gap, F.lit(True)))
    found = rows.groupBy(*by).agg(
        F.first("__gap").alias("gap"), F.first("__i.g").alias("g_i"),
        F.min(F.when(completes, F.struct("ord", "g"))).alias("__j"),
    )
    return found.select(*by, F.lit(metric).alias("metric"),
                        F.concat_ws("_", "g_i", F.col("__j.g")).alias("pair"), "g_i",
                        F.col("__j.g").alias("g_j"), "gap")


def fairness(
    df: DataFrame,
    spec: FairSpec,
    metric: str = "DP",
    level: str = "attribute",
    intersect: bool = False,
    max_partitions: int | None = None,
    empty: str = "zero",
) -> DataFrame:
    """(client..., ``attribute``, ``metric``, ``pair``, ``g_i``, ``g_j``, ``gap``) of every client.

    Level ``attribute`` gives the largest gap, ``value`` also its pair, ``attribute-value`` every pair.
    """
    require_choice("fairness level", level, LEVELS)
    rates = group_rates(first_partitions(df, max_partitions), spec, intersect, empty)
    if level == "attribute-value":
        return pair_gaps(rates, spec, metric)
    worst = worst_pairs(rates, spec, metric)
    if level == "value":
        return worst
    nothing = F.lit(None).cast("string")
    return worst.withColumns({"pair": nothing, "g_i": nothing, "g_j": nothing})


def wide(
    gaps: DataFrame, spec: FairSpec, metric: str, level: str, attributes: Sequence[str] | None = None,
    pairs: Sequence[str] | None = None,
) -> DataFrame:
    """One row per client. ``{attribute}_{metric}`` and ``{attribute}_val`` per attribute, or one column per pair.

    ``_val`` holds the pair at level ``value`` and repeats the gap at level ``attribute``. Pairs of one attribute
    are named as they are, those of several ``{attribute}_{pair}``. ``pairs`` names the columns wanted; without it
    they are looked up, and Spark allows as many as spark.sql.pivotMaxValues says. The long form has no such bound.
    """
    by = list(spec.client)
    if level == "attribute-value":
        chosen = list(attributes or spec.sensitive)
        mine = gaps.where(F.col("attribute").isin(chosen)) if attributes else gaps
        name = F.col("pair") if len(chosen) == 1 else F.concat_ws("_", "attribute", "pair")
        return mine.withColumn("__name", name).groupBy(*by).pivot("__name", list(pairs) if pairs else None).agg(
            F.first("gap"))
    columns = []
    for a in attributes or spec.sensitive:
        mine = F.col("attribute") == a
        columns.append(F.max(F.when(mine, F.col("gap"))).alias(f"{a}_{metric}"))
        columns.append(F.max(F.when(mine, F.col("pair" if level == "value" else "gap"))).alias(f"{a}_val"))
    return gaps.groupBy(*by).agg(*columns)
