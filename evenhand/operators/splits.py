"""Assigning partitions, folds, holdouts and chunks, all as ordinary columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions import client_name, fold_bounds
from evenhand.operators.ranks import at_bounds, column_order, cut_classes, hash_order, near_equal
from evenhand.plans.runtime import attach, count_cells, settle
from evenhand.spec import SETTINGS, FairSpec, require_choice, require_fractions, require_pieces, require_rate

FOLDS = ("train", "val", "test")


def _restore(df: DataFrame, result: DataFrame, *added: str) -> DataFrame:
    return result.select(*[c for c in df.columns if c not in added], *added)


def assign_partitions(
    df: DataFrame,
    spec: FairSpec,
    partitions: int | Mapping[str, int] | None = None,
    by: Column | None = None,
    within: Sequence[str] = (),
    seed: int = 42,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``partition_id``: k near-equal random parts of each client, or any expression of one's own.

    With ``order`` the parts are contiguous in the order of these columns instead, which must be a total one.

    ``partitions`` is one k for all, or one per client (1 where it names none). ``within`` adds grouping
    columns, such as the fold, inside which the parts are made.
    """
    if by is not None:
        return df.withColumn("partition_id", by.cast("int"))
    groups = [*spec.client, *within]
    if isinstance(partitions, Mapping):
        counts = F.create_map(*[F.lit(x) for pair in partitions.items() for x in (str(pair[0]), int(pair[1]))])
        k = F.coalesce(F.element_at(counts, F.col(spec.client[0]).cast("string")), F.lit(1))
        most = max(partitions.values(), default=1)
        require_pieces(min(partitions.values(), default=1))
    else:
        most = 1 if partitions is None else int(partitions)
        require_pieces(most)
        k = F.lit(most)
    if most == 1:
        return df.withColumn("partition_id", F.lit(0))
    rows, by_order = column_order(df, order) if order else hash_order(df, spec.key, seed)
    cut = cut_classes(rows, groups, by_order, near_equal(k, most), "partition_id")
    return _restore(df, cut, "partition_id")


def split_folds(
    df: DataFrame,
    spec: FairSpec,
    fractions: Sequence[float] = (0.7, 0.15, 0.15),
    setting: str = "cross-silo",
    seed: int = 42,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``fold`` (train, val or test) per row of each client; the last fold takes the remainder.

    With ``order`` the folds are contiguous in the order of these columns instead of random.

    In the cross-device setting clients are not cut, so the table is returned as it is; use
    ``split_clients`` there.
    """
    require_choice("setting", setting, SETTINGS)
    if setting == "cross-device":
        return df
    require_fractions(fractions, FOLDS)
    names = F.array(*[F.lit(f) for f in FOLDS])
    rows, by_order = column_order(df, order) if order else hash_order(df, spec.key, seed)
    bounds = at_bounds(fold_bounds(F.col("total"), fractions))
    cut = cut_classes(rows, spec.client, by_order, bounds, "__fold")
    return _restore(df, cut.withColumn("fold", F.get(names, F.col("__fold"))), "fold")


def split_clients(
    df: DataFrame, spec: FairSpec, fractions: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42
) -> DataFrame:
    """Add ``fold`` per client: whole clients are train, val or test."""
    require_fractions(fractions, FOLDS)
    clients = settle(df.select(*spec.client).distinct())
    names = F.array(*[F.lit(f) for f in FOLDS])
    rows, order = hash_order(clients, spec.client, seed)
    bounds = at_bounds(fold_bounds(F.col("total"), fractions))
    cut = cut_classes(rows, (), order, bounds, "__fold")
    folds = cut.select(*spec.client, F.get(names, F.col("__fold")).alias("fold"))
    return attach(df, folds, spec.client, count_cells(clients), spec.key)


def stratum_quotas(sizes: DataFrame, spec: FairSpec, test_size: float, strata: Sequence[str]) -> DataFrame:
    """Add ``__quota`` to the sizes ``n`` of strata: how many rows of each are held out."""
    client = Window.partitionBy(*spec.client)
    exact = F.col("n") * F.lit(float(test_size))
    wanted = F.ceil(F.sum("n").over(client) * F.lit(float(test_size)))
    made = (
        sizes.withColumn("__low", F.floor(exact))
        .withColumn("__rest", exact - F.col("__low"))
        .withColumn("__missing", wanted - F.sum("__low").over(client))
        .withColumn("__turn", F.row_number().over(client.orderBy(F.desc("__rest"), *strata)))
    )
    quota = F.col("__low") + (F.col("__turn") <= F.col("__missing")).cast("long")
    return made.select(*sizes.columns, quota.cast("long").alias("__quota"))


def holdout(
    df: DataFrame,
    spec: FairSpec,
    test_size: float = 0.2,
    seed: int = 42,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Add ``is_test``: ``ceil(n * test_size)`` rows of each client.

    With ``strata`` every stratum gives ``floor`` of its share, and the rows then missing come one each from
    the strata with the largest remainders, ties in the order of the strata.
    """
    require_rate(test_size)
    if not strata:
        rows, order = hash_order(df, spec.key, seed)
        quota = F.ceil(F.col("total") * F.lit(float(test_size))).cast("long")
        cut = cut_classes(rows, spec.client, order, at_bounds([quota]), "__part")
        return _restore(df, cut.withColumn("is_test", F.col("__part") == 0), "is_test")
    groups = [*spec.client, *strata]
    quotas = settle(stratum_quotas(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")), spec, test_size, strata))
    rows = attach(df, quotas.drop("n"), groups, count_cells(quotas), spec.key)
    rows, order = hash_order(rows, spec.key, seed)
    cut = cut_classes(rows, [*groups, "__quota"], order, at_bounds([F.col("__quota")]), "__part", sizes=quotas)
    return _restore(df, cut.withColumn("is_test", F.col("__part") == 0), "is_test")


def chunk(df: DataFrame, spec: FairSpec, k: int, order: Sequence[str]) -> DataFrame:
    """Add ``chunk``: k near-equal contiguous pieces of each client in the given order."""
    require_pieces(k)
    if k == 1:
        return df.withColumn("chunk", F.lit(0))
    rows, by = column_order(df, order)
    cut = cut_classes(rows, spec.client, by, near_equal(F.lit(k), k), "chunk")
    return _restore(df, cut, "chunk")


def first_partitions(df: DataFrame, most: int | None) -> DataFrame:
    """Only partitions with an id below ``most``."""
    return df if most is None else df.where(F.col("partition_id") < most)


def partition(df: DataFrame, spec: FairSpec, client: str, partition_id: int) -> DataFrame:
    """One partition of one client."""
    return split(df, spec, client).where(F.col("partition_id") == partition_id)


def split(df: DataFrame, spec: FairSpec, client: str) -> DataFrame:
    """All rows of one client."""
    return df.where(F.col(spec.client[0]) == F.lit(client))


def with_client_name(df: DataFrame, *parts: str, out: str = "client_name") -> DataFrame:
    return df.withColumn(out, client_name(*parts))


def client_index(df: DataFrame, client: str = "client") -> DataFrame:
    """(``client_index``, client): clients numbered from 0 in sorted order.

    The sorted list of clients is settled first, so that positions inside its partitions are fixed; one count
    per partition then gives each partition's offset.
    """
    ordered = settle(
        df.select(client).distinct().orderBy(client).withColumn("__id", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.withColumn("__part", part)
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
        .select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    )
    # One row per partition of the sorted list.
    joined = numbered.join(F.broadcast(offsets), "__part")
    return joined.select((place + F.col("__offset")).cast("long").alias("client_index"), client)
