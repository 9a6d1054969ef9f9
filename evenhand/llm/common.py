"""What the corpus operators share: word bounds, hot groups, labels of linked rows, and packing of input rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.plans.runtime import stage

# A group is hot when it holds more than one in this many rows, so at most this many groups are hot.
HOT_GROUPS = 10_000
# Bytes that a task takes from Arrow into Python at a time, about.
TOGETHER = 4 << 20
Rows = TypeVar("Rows", pa.Array, pa.RecordBatch)


def in_parts(batches: Iterable[Rows], together: int = TOGETHER) -> Iterator[Rows]:
    """All rows in their order, in slices of about ``together`` bytes, so that a task's memory follows no batch's size."""
    for batch in batches:
        rows = max(1, len(batch) * together // max(1, batch.nbytes))
        yield from (batch.slice(at, rows) for at in range(0, max(1, len(batch)), rows))


def text_of(name: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def carry(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as one struct beside the named columns, so that no other column name can clash."""
    return docs.select(*[c.alias(n) for n, c in columns.items()],
                       F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("__row"))


def unpack(carried: DataFrame) -> DataFrame:
    """The input rows that ``carry`` packed."""
    return carried.select("__row.*")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``groups`` (staged, unique on ``key``, counting rows in ``size``) to the rows of each group.

    Groups with more than ``total / HOT_GROUPS`` rows are at most HOT_GROUPS in number: they are broadcast, and
    their rows stay where they are. The rows of all others are shuffled by key.
    """
    is_hot = F.col(size) * HOT_GROUPS > F.lit(total)
    hot = F.broadcast(groups.filter(is_hot))
    cold = groups.filter(~is_hot)
    common = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(common)


def range_parts(rows: DataFrame, size: Column, most: int = 64 << 20) -> int:
    """Into how many ranges to deal rows: the session's number of partitions, or more, so that none exceeds ``most`` bytes."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // most))


def component_labels(edges: DataFrame) -> DataFrame:
    """Label every vertex of the undirected ``edges`` (a, b) with the smallest vertex it can reach.

    Each round gives a vertex the smallest label among its own and its neighbours' and then that label's own
    label, so the rounds grow with the logarithm of a chain's length. Rows are spread by adaptive joins and
    combined on the map side, so no vertex's neighbours are gathered. Returns (vertex, label), settled.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .filter("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
                   "labels")
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(
            F.min("label").alias("near"))
        hooked = stage(labels.join(near, "vertex").select(
            "vertex", F.least("label", "near").alias("label"), F.col("label").alias("was")), "hooked")
        roots = hooked.select(F.col("vertex").alias("label"), F.col("label").alias("root"))
        jumped = stage(hooked.join(roots, "label").select(
            "vertex", F.least("label", "root").alias("label"), "was"), "labels")
        if jumped.filter("label <> was").isEmpty():
            return jumped.select("vertex", "label")
        labels = jumped.select("vertex", "label")
