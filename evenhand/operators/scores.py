"""Scores of models on clients, and what they say about each client's dominant bias."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.operators.fairness import cells, group_rates, worst_pairs
from evenhand.plans.runtime import join_alike
from evenhand.spec import FairSpec, require_choice

# The two models, thresholds and bounds the calibration and the client selection use.
MODELS = ("LogisticRegression", "XGBoost")
THRESHOLD = 0.09
SELECTION = {"SEX": (0.09, None), "RAC1P": (0.12, 0.175)}
VALUE_SELECTION = (0.09, None)
# The score tables shorten this attribute's name.
SHORT_NAMES = {"RAC1P": "RACE"}


# --- measuring scored rows ---------------------------------------------------------------------------------

def unscored(df: DataFrame, spec: FairSpec) -> DataFrame:
    """(client..., ``rows``, ``unscored``): how many rows lack a label or a prediction, and so count nowhere else."""
    missing = F.col(spec.label).isNull() | F.col(spec.prediction or spec.label).isNull()
    return df.groupBy(*spec.client).agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("unscored"))


def accuracy(df: DataFrame, spec: FairSpec) -> DataFrame:
    """(client..., ``n``, ``accuracy``) over the rows that have a label and a prediction; ``unscored`` counts the others."""
    right = F.sum(F.when(F.col("__y") == F.col("__p"), F.col("n")).otherwise(0))
    return cells(df, spec).groupBy(*spec.client).agg(
        F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy"))


def score_fairness(
    df: DataFrame, spec: FairSpec, metric: str = "DP", level: str = "attribute",
    names: Mapping[str, str] = SHORT_NAMES, empty: str = "zero",
) -> DataFrame:
    """(client..., ``{metric}_{attribute}``) of scored rows; level ``value`` adds ``value_{metric}_{attribute}``."""
    require_choice("fairness level", level, ("attribute", "value"))
    worst = worst_pairs(group_rates(df, spec, empty=empty), spec, metric)
    columns = []
    for a in spec.sensitive:
        mine, name = F.col("attribute") == a, names.get(a, a)
        if level == "value":
            columns.append(F.max(F.when(mine, F.col("pair"))).alias(f"value_{metric}_{name}"))
        columns.append(F.max(F.when(mine, F.col("gap"))).alias(f"{metric}_{name}"))
    return worst.groupBy(*spec.client).agg(*columns)


def score_table(df: DataFrame, spec: FairSpec, metric: str = "DP", level: str = "attribute",
                empty: str = "zero", metrics: Mapping[str, Metric] = {}) -> DataFrame:
    """Accuracy and gaps of scored rows, one row per client (and model, if that is a client column), and one's own metrics."""
    right = accuracy(df, spec).drop("n")
    if metrics:
        right = join_alike(right, own_metrics(df, spec, metrics), list(spec.client))
    return join_alike(right, score_fairness(df, spec, metric, level, empty=empty), list(spec.client))


# --- metrics of one's own -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class MergeableMetric:
    """A metric that Spark has no expression for: a state of numbers that is updated from rows and merged with others.

    ``update`` gives the state of some rows, arrays of labels ``y`` and predictions ``p`` (booleans) and the columns named in
    ``columns``; ``merge`` joins two states; ``finish`` turns the state of all rows into the metric. How rows are divided must
    not matter to the result.
    """

    update: Callable[..., np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]
    columns: Sequence[str] = ()


# An aggregate expression over the columns y and p, 1 or 0 in every row with a label and a prediction; or a state.
Metric = Column | MergeableMetric


def own_metrics(df: DataFrame, spec: FairSpec, metrics: Mapping[str, Metric], by: Sequence[str] | None = None) -> DataFrame:
    """(client..., one column a metric) over the rows that have a label and a prediction; ``by`` groups otherwise.

    Expressions are combined on the map side like any aggregate. States are made in each task, one for each of its groups, and
    only states are shuffled.
    """
    by = list(spec.client if by is None else by)
    bit = lambda c: F.col(c).cast("boolean").cast("int")
    rows = df.withColumns({"y": bit(spec.label), "p": bit(spec.prediction or spec.label)}).where("y is not null and p is not null")
    plain = {name: m for name, m in metrics.items() if isinstance(m, Column)}
    found = rows.groupBy(*by).agg(*[m.alias(name) for name, m in plain.items()]) if plain else rows.select(*by).distinct()
    for name, metric in metrics.items():
        if name not in plain:
            found = join_alike(found, _merged(rows, by, name, metric), by)
    return found.select(*by, *metrics)


def _merged(rows: DataFrame, by: list[str], name: str, metric: MergeableMetric) -> DataFrame:
    kept = rows.select(*dict.fromkeys([*by, "y", "p", *metric.columns]))
    keys = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c in by)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*metric.columns, "y", "p")}
            columns |= {c: columns[c].astype(bool) for c in ("y", "p")}
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by])):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                made = metric.update(**{c: v[at] for c, v in columns.items()})
                states[key] = metric.merge(states[key], made) if key in states else made
            kinds = [batch.schema.field(c).type for c in by]
        if states:
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(zip(*states), kinds)],
                 pa.array([[float(x) for x in s] for s in states.values()], pa.list_(pa.float64()))], names=[*by, "state"])

    def whole(table: pa.Table) -> pa.Table:
        state = reduce(metric.merge, map(np.array, table.column("state").to_pylist()))
        return pa.table([*[table.column(c).slice(0, 1) for c in by], pa.array([float(metric.finish(state))])], names=[*by, name])

    states = kept.mapInArrow(partial, f"{keys}, state array<double>")
    return states.groupBy(*by).applyInArrow(whole, f"{keys}, `{name}` double")


def own_metric_gaps(df: DataFrame, spec: FairSpec, name: str, metric: Metric) -> DataFrame:
    """(client..., attribute, ``gap``, ``g_i``, ``g_j``): how far a metric of one's own is apart between groups, with the groups
    that have the most and the least of it (ties to the least text). Null groups and null metrics count nowhere."""
    gaps = None
    for a in spec.sensitive:
        each = own_metrics(df.where(F.col(a).isNotNull()), spec, {name: metric}, [*spec.client, a]).where(F.col(name).isNotNull())
        text, value = F.col(a).cast("string"), F.col(name)
        found = each.groupBy(*spec.client).agg(
            (F.max(value) - F.min(value)).alias("gap"), F.min(F.struct((-value).alias("v"), text.alias("g")))["g"].alias("g_i"),
            F.min(F.struct(value.alias("v"), text.alias("g")))["g"].alias("g_j"))
        found = found.select(*spec.client, F.lit(a).alias("attribute"), "gap", "g_i", "g_j")
        gaps = found if gaps is None else gaps.unionByName(found)
    return gaps


def weighted_vectors(rows: DataFrame, vector: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ``vector``): the average of vectors, such as the weights of clients' models, weighted by numbers of rows.

    Places are averaged one by one, combined on the map side, so vectors may be long and groups large. A place that some
    vectors lack is averaged over the others; null vectors, places and weights count nowhere.
    """
    each = rows.where(F.col(n).isNotNull()).select(*by, F.col(n).alias("__n"), F.posexplode(vector).alias("j", "x")).where("x is not null")
    means = each.groupBy(*by, "j").agg((F.sum(F.col("__n") * F.col("x")) / F.sum("__n")).alias("x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias(vector))


def weighted_metric(metrics: DataFrame, value: str = "accuracy", n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """The average of client metrics, weighted by their numbers of rows."""
    return metrics.groupBy(*by).agg((F.sum(F.col(n) * F.col(value)) / F.sum(n)).alias(value))


def log_loss(df: DataFrame, spec: FairSpec, probability: Column, floor: float = 1e-15) -> DataFrame:
    """Mean cross-entropy per client; ``probability`` is that of a positive label."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), probability))
    loss = -F.log(F.when(F.col(spec.label).cast("boolean"), p).otherwise(1 - p))
    return df.groupBy(*spec.client).agg(F.avg(loss).alias("log_loss"))


# --- combining results --------------------------------------------------------------------------------------

def compare_clients(before: DataFrame, after: DataFrame, client: str, column: str) -> DataFrame:
    """(client, ``fairness1``, ``fairness2``); clients must be unique in the first table."""
    if not before.groupBy(client).count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"{client!r} is not unique in the first table")
    one = before.select(client, F.col(column).alias("fairness1"))
    two = after.select(client, F.col(column).alias("fairness2"))
    return one.join(two, client)


def comparison_range(compared: DataFrame, pad: float = 0.05) -> DataFrame:
    """The range both columns of a comparison share, widened by ``pad``."""
    low = F.least(F.min("fairness1"), F.min("fairness2"))
    high = F.greatest(F.max("fairness1"), F.max("fairness2"))
    return compared.agg((low - pad).alias("low"), (high + pad).alias("high"))


def union_tagged(tables: Sequence[DataFrame], names: Sequence[str], name_column: str = "state") -> DataFrame:
    """All rows with a column naming their table; columns are matched by name, missing ones are null."""
    if len(tables) != len(names):
        raise ValueError(f"{len(tables)} tables but {len(names)} names")
    tagged = [t.withColumn(name_column, F.lit(n)) for t, n in zip(tables, names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# --- voting -----------------------------------------------------------------------------------------------

def _of_models(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    return scores.where(F.col("model").isin(*models))


def model_minimum(scores: DataFrame, column: str, models: Sequence[str] = MODELS) -> DataFrame:
    """(``dataset``, ``min_gap``): the smallest value of a column over the models."""
    return _of_models(scores, models).groupBy("dataset").agg(F.min(column).alias("min_gap"))


def attribute_vote(scores: DataFrame, metric: str = "DP", models: Sequence[str] = MODELS) -> DataFrame:
    """(``dataset``, ``votes``, ``vote``, ``min_gap``): is SEX or RAC1P the larger gap, for all models alike?

    ``vote`` is null while the models disagree; ``min_gap`` is the voted attribute's smallest gap over them.
    """
    sex, race = F.col(f"{metric}_SEX"), F.col(f"{metric}_RACE")
    counted = _of_models(scores, models).groupBy("dataset").agg(
        F.sum((sex > race).cast("int")).cast("long").alias("votes"), F.min(sex).alias("__sex"),
        F.min(race).alias("__race"))
    vote = F.when(F.col("votes") == len(models), "SEX").when(F.col("votes") == 0, "RAC1P")
    least = F.when(F.col("votes") == len(models), F.col("__sex")).when(F.col("votes") == 0, F.col("__race"))
    return counted.select("dataset", "votes", vote.alias("vote"), least.alias("min_gap"))


def _code(pair: Column, place: int) -> Column:
    """The first or last code of a pair; null unless the pair is two numbers."""
    two = F.regexp_extract(pair, r"^(-?[0-9]+(?:\.[0-9]+)?)_(-?[0-9]+(?:\.[0-9]+)?)$", place + 1)
    return two.try_cast("double").cast("int")


def _require_codes(scores: DataFrame, column: str) -> None:
    """Votes by value plan changes by code, so labels that are not numbers are an error and not an undecided vote."""
    odd = scores.where(F.col(column).isNotNull() & _code(F.col(column), 0).isNull()).select(column).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0][0]!r} in {column} is not a pair of numeric codes")


def value_vote(scores: DataFrame, metric: str = "DP", models: Sequence[str] = MODELS) -> DataFrame:
    """(``dataset``, ``vote``, ``min_gap``, ``first_code``, ``last_code``): do the models agree on the last code?

    ``vote`` is that code or null; the two codes are those of the first model's pair.
    """
    pair = F.col(f"value_{metric}_RACE")
    _require_codes(scores, f"value_{metric}_RACE")
    seen = _of_models(scores, models).groupBy("dataset").agg(
        F.min(_code(pair, 1)).alias("__low"), F.max(_code(pair, 1)).alias("__high"),
        F.min(f"{metric}_RACE").alias("min_gap"),
        F.max(F.when(F.col("model") == next(iter(models)), pair)).alias("__pair"))
    vote = F.when(F.col("__low") == F.col("__high"), F.col("__low"))
    return seen.select("dataset", vote.alias("vote"), "min_gap", _code(F.col("__pair"), 0).alias("first_code"),
                       _code(F.col("__pair"), 1).alias("last_code"))


def plan_next(scores: DataFrame, rate: float, level: str = "attribute", metric: str = "DP",
              threshold: float = THRESHOLD, models: Sequence[str] = MODELS) -> DataFrame:
    """The next round's plan: who needs a change, on which attribute and value, at the given drop rate."""
    require_choice("fairness level", level, ("attribute", "value"))
    weak = F.col("vote").isNotNull() & (F.col("min_gap") < threshold)
    if level == "attribute":
        voted = attribute_vote(scores, metric, models)
        column = F.coalesce("vote", F.lit("SEX"))
        value = F.lit(2)
    else:
        voted = value_vote(scores, metric, models)
        column = F.lit("RAC1P")
        value = F.when(F.col("vote").isNotNull(), F.col("first_code")).otherwise(F.col("last_code"))
    nothing = F.lit(None).cast("string")
    return voted.where(weak | F.col("vote").isNull()).select(
        F.col("dataset").cast("string").alias("client"), F.lit(0).alias("seq"), column.alias("column"),
        value.cast("string").alias("value"), F.lit(float(rate)).alias("drop_rate"), F.lit(0.0).alias("flip_rate"),
        nothing.alias("column2"), nothing.alias("value2"))


def modification_log(plan: DataFrame) -> DataFrame:
    """A plan as log entries (``state``, ``drop_rate``, ``attribute``, ``value``)."""
    return plan.select(F.col("client").alias("state"), "drop_rate", F.col("column").alias("attribute"),
                       F.col("value").cast("int").alias("value"))


def select_clients(
    scores: DataFrame, level: str = "attribute", metric: str = "DP", models: Sequence[str] = MODELS,
    bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """(``dataset``, ``vote``, ``min_gap``) of clients whose vote is decided and whose gap is inside its bounds."""
    require_choice("fairness level", level, ("attribute", "value"))

    def inside(low: float | None, high: float | None) -> Column:
        gap = F.col("min_gap")
        above = gap > low if low is not None else F.lit(True)
        return above & (gap < high) if high is not None else above

    if level == "attribute":
        voted = attribute_vote(scores, metric, models)
        rules = [(F.col("vote") == a) & inside(*b) for a, b in (bounds or SELECTION).items()]
        keep = reduce(lambda a, b: a | b, rules)
    else:
        voted = value_vote(scores, metric, models)
        keep = F.col("vote").isNotNull() & inside(*((bounds or {}).get("RAC1P", VALUE_SELECTION)))
    return voted.where(keep).select("dataset", "vote", "min_gap")


def decided_votes(
    scores: DataFrame, level: str = "attribute", metric: str = "DP", models: Sequence[str] = MODELS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(``attribute`` or ``value_int``, ``dataset``) of every client whose vote is decided."""
    require_choice("fairness level", level, ("attribute", "value"))
    if level == "attribute":
        decided = F.col("vote").isNotNull() & (F.col("min_gap") > threshold)
        return attribute_vote(scores, metric, models).where(decided).select(F.col("vote").alias("attribute"), "dataset")
    voted = value_vote(scores, metric, models).where("vote is not null")
    return voted.select(F.col("vote").alias("value_int"), "dataset")


def unfairness_distribution(
    scores: DataFrame, level: str = "attribute", metric: str = "DP", models: Sequence[str] = MODELS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Number and sorted list of the clients of each decided vote; ``decided_votes`` is the same with a row per client.

    By attribute only clients whose smallest gap exceeds the threshold count; by value all that are decided.
    """
    voted = decided_votes(scores, level, metric, models, threshold)
    return voted.groupBy(voted.columns[0]).agg(F.count(F.lit(1)).alias("number"),
                                  F.sort_array(F.collect_list("dataset")).alias("states"))
