"""Exact ranks inside groups, also inside groups too large to sort in one task.

Every seeded draw and every split in this library asks one question: in a group ordered by some columns, between
which of some wanted ranks does a row stand? While the largest group is counted to be small, a window function
answers it. A window sorts each group in one task, though, which fails when one client holds a third of the
table. Beyond the limit the rows stay where they are:

1. count rows per (group, bin) of the leading order column, so only counts are shuffled;
2. find the bins in which the wanted ranks fall, and split those again while they are large;
3. rank just the rows of these last bins, which gives the exact row at each wanted rank (a *cut*);
4. compare every row with the cuts of its group.

The row order is total (the last order columns are the key), so both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions import all_of, chunk_bounds, chunk_of, order_key
from evenhand.plans.runtime import BROADCAST_CELLS, attach, count_cells, settle

BINS = 1024
# Up to this many cuts per group are compared one by one.
FEW_CUTS = 3
# A window ranks groups up to this many rows, as long as the table is small or the groups are many.
WINDOW_ROWS = 1_000_000
WINDOW_TOTAL = 3_000_000
# Boundary bins above this many rows are split again.
BIN_ROWS = 1_000_000
# Rows of a group that are ranked together where every row needs its rank, about.
RANKED_ROWS = 200_000
# The hash order is binned by its first 15 hexadecimal digits.
HASH_SPAN = (0, 16**15 - 1)
# A text is binned by so many bytes at a time.
CHUNK = 7


@dataclass(frozen=True)
class Order:
    """Columns to order by, and numbers to bin them by.

    ``leads`` names for each column in turn how it becomes numbers; each never decreases along the order among
    rows alike in those before it. Texts become one number per CHUNK bytes, as many as the longest text has. ``span``
    bounds the first number if that is known beforehand.
    """

    columns: tuple[str, ...]
    types: tuple[str, ...]
    span: tuple[int, int] | None = None

    def leads(self, rows: DataFrame, at: str) -> list[Column]:
        """The numbers as expressions over the struct column ``at``; one job finds the longest texts, if any."""
        value = [F.col(f"{at}.o{j}") for j in range(len(self.columns))]
        texts = [j for j, t in enumerate(self.types) if t == "text"]
        longest = rows.agg(*[F.max(F.octet_length(value[j].cast("binary"))).alias(f"n{j}") for j in texts]).first() if texts else {}
        made: list[Column] = []
        for j, kind in enumerate(self.types):
            if kind == "hash":
                made.append(F.conv(F.substring(value[j], 1, 15), 16, 10).cast("long"))
            elif kind == "long":
                made.append(value[j].cast("long"))
            elif kind == "time":
                made.append(F.unix_micros(value[j]))
            elif kind == "date":
                made.append(F.unix_date(value[j]).cast("long"))
            elif kind == "clock":
                seconds = F.hour(value[j]) * 3600 + F.minute(value[j]) * 60 + F.second(value[j])
                made.append(F.unix_date(value[j].cast("date")).cast("long") * 86400 + seconds)
            elif kind == "double":
                made += [_magnitude(value[j].cast("double")), value[j].cast("double")]
            else:
                made += [_letters(value[j], i) for i in range(-(-(longest[f"n{j}"] or 0) // CHUNK))]
        return made or [F.lit(0).cast("long")]


def _magnitude(x: Column) -> Column:
    """Sign and power of two of a double as a whole number; infinities and NaN stand apart, in Spark's order."""
    power = F.floor(F.log2(F.abs(x))).cast("long") + 2000
    return (F.when(F.isnan(x), 9000).when(F.abs(x) == float("inf"), F.signum(x) * 8000)
            .when(x == 0, 0).otherwise(F.signum(x) * power)).cast("long")


def _letters(text: Column, place: int) -> Column:
    """The bytes of a text at a place as one number; a text that is over counts as zeros."""
    part = F.substring(text.cast("binary"), 1 + CHUNK * place, CHUNK)
    return F.conv(F.rpad(F.hex(part), 2 * CHUNK, "0"), 16, 10).cast("long")


@dataclass(frozen=True)
class Cutting:
    """Where to cut groups: the ranks as an array over ``total``, and the stretch of the row at rank ``__rn``."""

    ranks: Column
    place: Column
    most: int


def at_bounds(bounds: Sequence[Column]) -> Cutting:
    """Cut after the given ranks, which are expressions over ``total`` and must not decrease."""
    place = F.lit(0)
    for bound in bounds:
        place = place + (F.col("__rn") > bound).cast("int")
    return Cutting(F.array(*[b.cast("long") for b in bounds]), place, len(bounds))


def near_equal(k: Column, most: int) -> Cutting:
    """Cut into ``k`` near-equal pieces; ``most`` is the largest k."""
    total = F.col("total")
    return Cutting(chunk_bounds(total, k), chunk_of(F.col("__rn"), total, k), most - 1)


def hash_order(
    rows: DataFrame, key: Sequence[str], seed: int = 42, only: Column | None = None
) -> tuple[DataFrame, Order]:
    """Order by the seeded hash of the key, ties by the key; rows outside ``only`` are not hashed."""
    digest = order_key(key, seed)
    hashed = rows.withColumn("__hash", digest if only is None else F.when(only, digest))
    kinds = _kinds(rows, key)
    return hashed, Order(("__hash", *key), ("hash", *kinds), HASH_SPAN)


def _kinds(rows: DataFrame, columns: Sequence[str]) -> tuple[str, ...]:
    """How each column becomes numbers; columns after one that cannot be binned are not binned."""
    kinds = []
    for c in columns:
        dtype = rows.schema[c].dataType
        found = next((kind for types, kind in (
            ((T.IntegralType,), "long"), ((T.NumericType,), "double"), ((T.TimestampType,), "time"), ((T.DateType,), "date"),
            ((T.TimestampNTZType,), "clock"), ((T.StringType, T.BinaryType), "text"), ((T.BooleanType,), "long"))
            if isinstance(dtype, types)), None)
        if found is None:
            break
        kinds.append(found)
        if found == "clock" or isinstance(dtype, T.DecimalType):
            break  # equal numbers need not be ties
    return tuple(kinds)


def column_order(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Order]:
    """Order by the given columns, nulls first; the last ones make it total."""
    kinds = _kinds(rows, columns)
    if not kinds:
        found = rows.schema[columns[0]].dataType.simpleString()
        raise ValueError(f"cannot bin the order column {columns[0]!r} of type {found}")
    return rows, Order(tuple(columns), kinds)


def _away(value: Column, lo: Column, dtype: str) -> Column:
    """``value - lo`` as a double that never decreases with value, also where two longs are too far apart."""
    rough = value.cast("double") - lo.cast("double")
    if dtype != "bigint":
        return rough
    exact = F.try_subtract(value, lo).cast("double")
    return F.coalesce(exact, F.greatest(rough, F.lit(2.0**63)))


def _bin(lo: Column, hi: Column, dtype: str = "bigint") -> Column:
    """Equal-width bin of ``__lead`` between lo and hi; never decreases with ``__lead``. Nulls have a bin below all."""
    at, width = _away(F.col("__lead"), lo, dtype), _away(hi, lo, dtype)
    place = F.floor(F.nanvl(at / F.greatest(width, F.lit(1e-300)), F.lit(0.0)) * BINS)
    inside = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place))
    return F.when(F.col("__lead").isNull(), -1).when(F.coalesce(hi > lo, F.lit(False)), inside).otherwise(0).cast("int")


def _histogram(rows: DataFrame, by: Sequence[str], step: str) -> DataFrame:
    """Rows per bin, with the number of rows of the same group before it. A group has at most BINS bins."""
    counts = rows.groupBy(*by, step).agg(
        F.count(F.lit(1)).alias("n"), F.min("__lead").alias("lo"), F.max("__lead").alias("hi")
    )
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _asked_type(dtype: str) -> str:
    """One entry of the merged list of bins (kind 0) and asked ranks (kind 1)."""
    spot = f"struct<bin:int,n:bigint,lo:{dtype},hi:{dtype},before:bigint>"
    return f"struct<pos:bigint,kind:int,spot:{spot},total:bigint,i:int,rank:bigint>"


def _point(dtype: str, **given: Column) -> Column:
    names = ("pos", "kind", "spot", "total", "i", "rank")
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(_asked_type(dtype))


def _bin_point(step: str, dtype: str) -> Column:
    return _point(dtype, pos=F.col("before"), kind=F.lit(0), spot=F.struct(step, "n", "lo", "hi", "before"))


def _place(points: DataFrame, by: Sequence[str], step: str) -> DataFrame:
    """Give every asked rank its bin: the last one that starts before it. Ranks below 1 get none."""
    upto = Window.partitionBy(*by).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = points.withColumn("spot", F.last("spot", ignorenulls=True).over(upto)).where("kind = 1")
    rank = F.col("rank") - F.coalesce(F.col("spot.before"), F.lit(0))
    return placed.select(*by, F.col("spot.bin").alias(step), "total", "i", rank.alias("rank"),
                         F.col("spot.n").alias("n"), F.col("spot.lo").alias("lo"), F.col("spot.hi").alias("hi"))


def find_cuts(rows: DataFrame, groups: Sequence[str], order: Order, ranks: Column) -> tuple[DataFrame, int]:
    """The rows standing at given ranks of each group.

    ``ranks`` is an expression for a non-decreasing array of ranks over the group columns and ``total``, the
    group's size. Returns (groups, ``cuts``) and the number of values for ``attach``. An entry of ``cuts`` is
    (``i``, ``at``); ``at`` is null for rank 0.
    """
    at = F.struct(*[F.col(c).alias(f"o{j}") for j, c in enumerate(order.columns)])
    rows = rows.select(*groups, at.alias("__at"))
    leads = order.leads(rows, "__at")
    rows = rows.withColumn("__lead", leads[0])
    dtype = dict(rows.dtypes)["__lead"]
    if order.span is not None:
        lo, hi = (F.lit(v) for v in order.span)
        binned = rows.withColumn("__b0", _bin(lo, hi, dtype))
    else:
        spans = settle(rows.groupBy(*groups).agg(F.min("__lead").alias("__lo"), F.max("__lead").alias("__hi")))
        binned = attach(rows, spans, groups, count_cells(spans), ["__at"])
        binned = binned.withColumn("__b0", _bin(F.col("__lo"), F.col("__hi"), dtype)).drop("__lo", "__hi")

    bins = _histogram(binned, groups, "__b0").withColumn("total", F.sum("n").over(Window.partitionBy(*groups)))
    asked = F.transform(ranks, lambda rank, i: _point(
        dtype, pos=rank - 1, kind=F.lit(1), total=F.col("total"), i=i, rank=rank))
    nothing = F.array().cast(f"array<{_asked_type(dtype)}>")
    # The ranks of a group are written out once, beside its first bin.
    merged = F.concat(F.array(_bin_point("__b0", dtype)), F.when(F.col("before") == 0, asked).otherwise(nothing))
    found = settle(_place(bins.select(*groups, F.inline(merged)), groups, "__b0"))
    unplaced = found.where("rank <= 0").select(
        *groups, "i", F.lit(None).cast(rows.schema["__at"].dataType).alias("at"))
    found = found.where("rank > 0")

    path, lead = ["__b0"], 0
    while True:
        spread = F.coalesce(F.col("hi") > F.col("lo"), F.lit(False))  # compared exactly, in the type of the column
        extent = found.agg(F.count(F.lit(1)).alias("cuts"), F.max(F.when(spread, F.col("n"))).alias("spread"),
                           F.max(F.when(~spread, F.col("n"))).alias("tied")).first()
        keys = [*groups, *path]
        boundary = found.groupBy(*keys).agg(F.first("lo").alias("__lo"), F.first("hi").alias("__hi"))
        binned = attach(binned, boundary, keys, extent["cuts"], ["__at"], how="inner")
        finer_lead = (extent["spread"] or 0) > BIN_ROWS
        next_lead = (extent["tied"] or 0) > BIN_ROWS and lead + 1 < len(leads)
        if not (finer_lead or next_lead):
            break
        step = f"__b{len(path)}"
        if finer_lead:
            place = _bin(F.col("__lo"), F.col("__hi"), dtype)
        else:
            # Rows alike in one column are told apart by the next; bins not alike in it stay as they are.
            lead += 1
            tied = ~F.coalesce(F.col("__hi") > F.col("__lo"), F.lit(False))
            binned = binned.withColumn("__lead", F.when(tied, leads[lead]))
            spans = settle(binned.groupBy(*keys).agg(
                F.min("__lead").alias("__low"), F.max("__lead").alias("__high")))
            binned = attach(binned, spans, keys, count_cells(spans), ["__at"])
            dtype = dict(binned.dtypes)["__lead"]
            binned = binned.withColumn("__untold", ~tied)
            place = F.when(F.col("__untold"), 0).otherwise(_bin(F.col("__low"), F.col("__high"), dtype))
        binned = binned.withColumn(step, place).drop("__lo", "__hi", "__low", "__high", "__untold")
        finer = _histogram(binned, keys, step).select(*keys, F.inline(F.array(_bin_point(step, dtype))))
        again = found.select(*keys, F.inline(F.array(_point(
            dtype, pos=F.col("rank") - 1, kind=F.lit(1), total=F.col("total"), i=F.col("i"), rank=F.col("rank")))))
        found = settle(_place(finer.unionByName(again), keys, step))
        path.append(step)

    ordered = Window.partitionBy(*keys).orderBy("__at")
    ranked = binned.withColumn("__rn", F.row_number().over(ordered))
    asked = found.select(*[F.col(c).alias(f"_{c}") for c in keys], "i", "rank")
    same = all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    placed = ranked.join(asked, same & (F.col("__rn") == F.col("rank")))
    cuts = settle(
        placed.select(*groups, "i", F.col("__at").alias("at")).unionByName(unplaced)
        .groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("cuts"))
    )
    return cuts, count_cells(cuts, F.size("cuts") + len(groups))


def classify(
    rows: DataFrame, groups: Sequence[str], order: Order, cuts: DataFrame, size: int, most: int, out: str
) -> DataFrame:
    """Add ``out``, the number of cuts a row comes after, by binary search in its group's cuts.

    ``most`` bounds the number of cuts of a group and sets the number of search steps.
    """
    here = F.struct(*[F.col(c).alias(f"o{j}") for j, c in enumerate(order.columns)])
    if most <= FEW_CUTS:
        # A few cuts become columns of the small table, so that each row just compares.
        single = [F.get("cuts", F.lit(i)).alias(f"__cut{i}") for i in range(most)]
        joined = attach(rows, cuts.select(*groups, *single), groups, size, order.columns)
        place = F.lit(0)
        for i in range(most):
            cut = F.col(f"__cut{i}")
            passed = F.when(cut.isNull(), 0).when(cut["at"].isNull() | (cut["at"] < here), 1).otherwise(0)
            place = place + passed
        return joined.withColumn(out, place).drop(*[f"__cut{i}" for i in range(most)])
    joined = attach(rows, cuts.select(*groups, "cuts"), groups, size, order.columns)
    joined = joined.withColumn("__here", here).withColumn(out, F.lit(0))
    for exponent in reversed(range(most.bit_length())):
        stride = 1 << exponent
        probe = F.get("cuts", F.col(out) + F.lit(stride - 1))
        beyond = probe.isNotNull() & (probe["at"].isNull() | (probe["at"] < F.col("__here")))
        joined = joined.withColumn(out, F.col(out) + F.when(F.coalesce(beyond, F.lit(False)), stride).otherwise(0))
    return joined.drop("__here", "cuts")


def window_fits(rows: DataFrame, groups: Sequence[str], only: str | None, most: int, sizes: DataFrame | None) -> bool:
    """Should a window rank these rows? One job that reads the group columns and shuffles only counts, unless a
    settled table with the group sizes ``n`` is there already.

    It must not when a group is large. It should not when the table is large and its groups are few, since a
    window shuffles all rows and cuts can then be broadcast.
    """
    taking = F.sum(F.col(only).cast("long")) if only else F.count(F.lit(1))
    if sizes is None:
        sizes = rows.groupBy(*groups).agg(taking.alias("n"), F.count(F.lit(1)).alias("m"))
    else:
        sizes = sizes.select("n", F.col("n").alias("m"))
    found = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("groups"),
                      F.coalesce(F.sum("m"), F.lit(0)).alias("total")).first()
    few = found["groups"] * (most + len(groups)) <= BROADCAST_CELLS
    return found["largest"] <= WINDOW_ROWS and (found["total"] <= WINDOW_TOTAL or not few)


def cut_classes(
    rows: DataFrame, groups: Sequence[str], order: Order, cutting: Cutting, out: str, only: str | None = None,
    carried: Sequence[str] = (), sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``: the stretch of its group, numbered from 0, in which a row stands.

    ``only`` names a boolean column; other rows take no part and get null. ``carried`` are columns the ranks
    depend on that are the same for all rows of a group taking part.
    """
    columns = rows.columns
    if not groups:
        rows, groups = rows.withColumn("__all", F.lit(0)), ["__all"]
    if window_fits(rows, groups, only, cutting.most, sizes):
        # Rows that take no part stand alone, so that a large group of them is not sorted in one task.
        apart = F.when(~F.col(only), F.xxhash64(*order.columns)) if only else None
        by = [*groups, *carried, *([only, apart] if only else [])]
        every = Window.partitionBy(*by)
        made = rows.withColumns({
            "__rn": F.row_number().over(every.orderBy(*order.columns)), "total": F.count(F.lit(1)).over(every)})
        made = made.withColumn(out, cutting.place.cast("int"))
    else:
        taking = rows.where(only) if only else rows
        cuts, size = find_cuts(taking, [*groups, *carried], order, cutting.ranks)
        made = classify(rows, groups, order, cuts, size, cutting.most, out)
    if only:
        made = made.withColumn(out, F.when(F.col(only), F.col(out)))
    return made.select(*columns, out)


def every_rank(df: DataFrame, by: Sequence[str], key: Sequence[str], groups: Mapping[str, Sequence[str]], seed: int = 42) -> DataFrame:
    """Add the rank of every row in hash order inside several groups: ``groups`` names, for each column to add, the columns that
    part ``by`` further.

    One shuffle serves all groups. It deals rows by ``by`` and an equal-width bin of the hash, so that large groups are spread;
    a rank is the rows of the group in earlier bins, which are counted before, and the rank in the row's own bin.
    """
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bins = -(-largest // RANKED_ROWS) or 1
    rows, order = hash_order(df, key, seed)
    lead = F.conv(F.substring("__hash", 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("__bin", F.least(F.floor(lead / F.lit(float(16**15)) * bins), F.lit(bins - 1)).cast("int"))
    # The rows of a bin are put in order once; their groups then sort by a number.
    ranked = rows.repartition(*by, "__bin").withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__bin").orderBy(*order.columns)))
    ranked = ranked.drop("__hash").withColumns({
        name: F.row_number().over(Window.partitionBy(*by, "__bin", *columns).orderBy("__at")).cast("long") for name, columns in groups.items()})
    if bins > 1:
        counts = settle(rows.groupBy(*by, "__bin", *dict.fromkeys(c for g in groups.values() for c in g)).agg(F.count(F.lit(1)).alias("n")))
        for name, columns in groups.items():
            earlier = Window.partitionBy(*by, *columns).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
            keys = [*by, *columns, "__bin"]
            before = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
            before = settle(before)
            ranked = attach(ranked, before, keys, count_cells(before, len(keys) + 1), key)
            ranked = ranked.withColumn(name, F.col(name) + F.col("__before")).drop("__before")
    return ranked.select(*df.columns, *groups)
