"""Mixing sources to target weights along a curriculum whose weights change over training.

Every source has a weight schedule, linear between knots. Its integral says how much of the source's target is
demanded up to a time; inverted at the words taken before a document, it says when that document is due.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import carry, in_parts, text_of, unpack
from evenhand.plans.runtime import attach, stage

# Documents of one source that a window orders together at most; with fewer rows, as many as give every task a bin.
BIN_ROWS = 20_000


@dataclass(frozen=True)
class Curriculum:
    """Weights of the sources in order of their names, repeating; the words wanted as a share of all words; how often
    a source may be repeated; and for each weight the knots (time, height) of its schedule, whose area is scaled
    to 1. By default heavy sources fade, middle ones are level and light ones grow.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    repeats: int = 2
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))

    def __post_init__(self) -> None:
        if not 0 <= self.share <= self.repeats:
            raise ValueError("more words are wanted than all repeats of all sources have")
        if len(self.schedules) != len(self.weights) or any(w <= 0 for w in self.weights):
            raise ValueError("there must be one schedule for each weight, and weights above 0")
        for knots in self.schedules:
            times = [t for t, _ in knots]
            if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(h for _, h in knots) <= 0:
                raise ValueError("a schedule runs from time 0 to 1 through ascending knots above 0")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space."""
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(t.split()) for part in in_parts([texts]) for t in part.cast(pa.large_binary()).to_pylist()], pa.int64())

    return F.arrow_udf(count, "bigint")(text)


def _ranked(names: DataFrame) -> DataFrame:
    """Distinct sources with their place in ascending order, nulls last: dealt by range, counted, then numbered."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stage(names.repartitionByRange(*order).select("source", F.spark_partition_id().alias("part")), "names")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(counts.select("part", first.alias("first")), "part").select(
        "source", (F.col("first") + F.col("inside")).alias("place"))


def source_targets(sized: DataFrame, c: Curriculum) -> DataFrame:
    """(source, place, weight, source_size, rows, target), settled, from rows (source, size).

    Targets are ``level * weight`` or the cap of the source, whichever is less. The level is raised until nothing
    is left over: each turn caps the sources that the last one filled and shares the rest out again.
    """
    sums = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    place = _ranked(sums.select("source")).withColumnRenamed("source", "__s")
    weights = F.array(*[F.lit(float(w)) for w in c.weights])
    sources = stage(sums.join(place, F.col("source").eqNullSafe(F.col("__s"))).select(
        "source", "place", F.get(weights, F.pmod("place", F.lit(len(c.weights))).cast("int")).alias("weight"),
        "source_size", "rows", (F.col("source_size") * c.repeats).cast("double").alias("cap")), "sources")
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, full = 0.0, -1
    while True:
        filled = F.col("cap") <= F.lit(level) * F.col("weight")
        s = sources.agg(F.sum(F.when(filled, F.col("cap"))).alias("cap"), F.count(F.when(filled, 1)).alias("n"),
                        F.sum(F.when(~filled, F.col("weight"))).alias("weight")).first()
        if s["n"] == full or not s["weight"]:
            break
        full, level = s["n"], (total * c.share - (s["cap"] or 0.0)) / s["weight"]
    target = F.col("cap") if full >= 0 and not s["weight"] else F.least("cap", F.lit(level) * F.col("weight"))
    return stage(sources.withColumn("target", target).drop("cap"), "targets")


def _due(share: Column, place: Column, c: Curriculum) -> Column:
    """Time at which a source's schedule has demanded ``share`` of its target: the integral, inverted knot by knot."""
    by_weight = []
    for knots in c.schedules:
        pieces, done = [], 0.0
        for (t0, h0), (t1, h1) in zip(knots, knots[1:]):
            pieces.append((t0, h0, (h1 - h0) / (t1 - t0), done))
            done += (t1 - t0) * (h0 + h1) / 2
        out = None
        for t0, h0, slope, start in reversed(pieces):
            # Solves h0 * x + slope * x^2 / 2 = left in the form that also holds for slope 0.
            left = F.greatest(share * F.lit(done) - F.lit(start), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(h0 * h0) + F.lit(2 * slope) * left, F.lit(0.0)))
            due = F.lit(t0) + 2 * left / (F.lit(h0) + root)
            out = due if out is None else F.when(share * F.lit(done) < F.lit(end), due).otherwise(out)
            end = start
        by_weight.append(out)
    return F.get(F.array(*by_weight), F.pmod(place, F.lit(len(c.weights))).cast("int"))


def _placed(sized: DataFrame, sources: DataFrame, c: Curriculum) -> DataFrame:
    """Rows with ``before``, the words of their source ahead of them in a fixed random order.

    Each source is cut into bins of the order's leading hash, as many as its rows need. Sums of earlier bins
    come from counts of bins; a window orders one bin, so a source with a third of all rows is spread out.
    """
    hash_of = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.hex("mark"))))
    total = sources.agg(F.sum("rows").alias("n")).first()["n"] or 0
    tasks = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = F.ceil(F.col("rows") / max(1, min(BIN_ROWS, total // tasks)))
    rows = attach(sized, sources, ["source"], 7 * sources.count(), ["doc_id", "mark"]).withColumn("__h", hash_of)
    lead = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = stage(rows.withColumn("__bin", F.floor(lead * bins)), "binned")
    sums = rows.groupBy("source", "place", "__bin").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("place").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.select(F.col("place").alias("__p"), F.col("__bin").alias("__b"),
                             F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__ahead")), "bins")
    within = Window.partitionBy("place", "__bin").orderBy("__h", "size", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("__in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = (F.col("place") == F.col("__p")) & (F.col("__bin") == F.col("__b"))
    return numbered.join(sums, on).withColumn("before", F.col("__ahead") + F.col("__in")).drop(
        "__ahead", "__in", "__p", "__b", "__h", "__bin")


def _mark(docs: DataFrame) -> Column:
    """A digest of a whole row; rows that share it are alike in every column."""
    return F.unhex(F.md5(F.to_json(F.struct(*[docs[f"`{n}`"].alias(f"c{i}") for i, n in enumerate(docs.columns)]))))


def mix(docs: DataFrame, c: Curriculum = Curriculum(), text: str = "text", doc_id: str = "doc_id",
        source: str = "source") -> DataFrame:
    """One row per document, sorted by its first position: (doc_id, source, size, source_size, target, taken, positions).

    A source is taken in rounds, each in the same fixed random order. Whole documents are taken: full rounds, and in
    the last one those whose middle lies before the target, so the words taken differ from it by at most half a
    document. ``positions`` lists the times in [0, 1] at which the copies of a document are due.

    A null text has size 0; documents without words are never taken. Null sources form the last source. Rows with
    equal ids are told apart by size and by a digest of all their columns, and rows without an id are dealt by that
    digest. An empty table gives no rows.
    """
    found = _mixed(docs, c, text, doc_id, source)
    return found.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id", "mark").drop("mark")


def _mixed(docs: DataFrame, c: Curriculum, text: str, doc_id: str, source: str) -> DataFrame:
    """``mix`` with the digest of each row, in no order."""
    sized = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                              word_count(text_of(text)).alias("size"), _mark(docs).alias("mark")).withColumn(
        "row", F.monotonically_increasing_id()), "sized")
    rows = _placed(sized, source_targets(sized, c), c)
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - rounds * F.col("source_size")
    again = (F.col("before") + F.col("size") / 2 < rest).cast("long")
    copies = F.when(F.col("size") > 0, F.least(rounds + again, F.lit(c.repeats).cast("long"))).otherwise(F.lit(0).cast("long"))
    middle = lambda k: (k * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target")
    positions = F.transform(F.filter(F.array(*[F.lit(k) for k in range(c.repeats)]), lambda k: k < F.col("__copies")),
                            lambda k: F.round(_due(F.least(middle(k), F.lit(1.0)), F.col("place"), c), 9))
    return rows.withColumn("__copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("__copies") * F.col("size")).alias("taken"),
        positions.alias("positions"), "mark")


def arrange(docs: DataFrame, c: Curriculum = Curriculum(), text: str = "text", doc_id: str = "doc_id",
            source: str = "source") -> DataFrame:
    """The rows of ``docs`` as the mix takes them, each as often as it is taken, range-sorted by position.

    Every row follows its own decision, found by its id and a digest of all its columns. Rows alike in every column,
    null ids included, share their decisions: one of them stands for all and comes once for each time any is taken.
    """
    due = stage(_mixed(docs, c, text, doc_id, source).filter("taken > 0").select(
        F.col("doc_id").alias("__due"), F.col("mark").alias("__of"), "positions"), "due")
    whole = carry(docs, __id=F.col(doc_id), __mark=_mark(docs))
    alike = stage(due.groupBy(F.col("__due").alias("__d"), F.col("__of").alias("__o")).agg(F.count("*").alias("n"))
                  .filter("n > 1"), "alike")
    if not alike.isEmpty():
        is_alike = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__o"))
        once = whole.join(alike, is_alike, "left_semi").dropDuplicates(["__id", "__mark"])
        whole = whole.join(alike, is_alike, "left_anti").unionByName(once)
    joined = whole.join(due, F.col("__id").eqNullSafe(F.col("__due")) & (F.col("__mark") == F.col("__of")))
    return unpack(joined.withColumn("__at", F.explode("positions")).orderBy("__at", "__id", "__mark"))
