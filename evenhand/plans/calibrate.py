"""Raising the bias of weakly biased clients step by step, and choosing clients among chunks of clients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions import client_name, same_value
from evenhand.operators.models import Model, evaluate_models
from evenhand.operators.ranks import every_rank
from evenhand.operators.scores import (MODELS, THRESHOLD, modification_log, plan_next, select_clients,
                                       unfairness_distribution)
from evenhand.operators.splits import chunk, holdout, stratum_quotas
from evenhand.plans.runtime import BROADCAST_CELLS, attach, gather, join_alike, settle, stage
from evenhand.spec import FairSpec

# The drop rates tried one after the other.
RATES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
# The attributes that votes and plans speak of.
VOTED = ("SEX", "RAC1P")


def score_clients(
    df: DataFrame, spec: FairSpec, features: Sequence[str], metric: str = "DP", level: str = "attribute",
    models: Sequence[str] = MODELS, options: Mapping[str, Mapping] = {}, seed: int = 42,
    test_size: float = 0.2,
) -> DataFrame:
    """Hold out a part of every client, fit the models on the rest, and score them.

    At level ``attribute`` the held-out part is stratified by the voted attributes SEX and RAC1P.
    """
    strata = [c for c in spec.sensitive if c in VOTED] if level == "attribute" else []
    needed = dict.fromkeys([*spec.client, *spec.key, *spec.sensitive, spec.label, *features])
    held = holdout(df.select(*needed), spec, test_size, seed, strata)
    held = stage(held, "held") if isinstance(models, Mapping) else held
    return _score(held, spec, features, metric, level, models, options)


def _score(held: DataFrame, spec: FairSpec, features: Sequence[str], metric: str, level: str, models: Sequence[str] | Mapping[str, Model],
           options: Mapping[str, Mapping]) -> DataFrame:
    """Fit and score on a divided table. For the models of this library, equal rows are counted first and written out, so that
    only one pass reads all rows; models of one's own get the rows as they are."""
    if not isinstance(models, Mapping):
        alike = dict.fromkeys([*spec.client, *spec.sensitive, spec.label, *features, "is_test"])
        # Rows to fit on are alike whatever their sensitive values, unless these are features.
        unseen = [c for c in spec.sensitive if c not in (*spec.client, spec.label, *features)]
        held = held.withColumns({c: F.when(F.col("is_test"), F.col(c)) for c in unseen})
        held, spec = stage(held.groupBy(*alike).agg(F.count(F.lit(1)).alias("__times")), "held"), replace(spec, weight="__times")
    return settle(evaluate_models(held, spec, features, ~F.col("is_test"), F.col("is_test"), metric, level, models, options))


class Calibration(NamedTuple):
    """What calibrating yields: last scores, the log of planned changes, the unfairness distribution, and the table."""

    scores: DataFrame
    log: DataFrame
    distribution: DataFrame
    rows: DataFrame


def _ranked(df: DataFrame, spec: FairSpec, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The table with the ranks that draws and holdouts of all rounds follow from, written out; the sizes of its cells, and how
    many cells there are.

    ``__y`` is a positive label. A cell holds the rows of a client that are alike in the voted attributes. ``__rank`` is a row's
    rank in its cell, ``__alike`` that among the rows of the cell with the same ``__y``, and ``__in_{c}`` that among all rows of
    the client with the same ``__y`` and value of c.
    """
    voted = [c for c in spec.sensitive if c in VOTED]
    rows = df.withColumn("__y", F.coalesce(F.col(spec.label).cast("boolean"), F.lit(False)))
    groups = {"__rank": voted, "__alike": [*voted, "__y"], **{f"__in_{c}": [c, "__y"] for c in voted}}
    rows = stage(every_rank(rows, spec.client, spec.key, groups, seed), "ranked")
    sizes = settle(rows.groupBy(*spec.client, *voted).agg(F.count(F.lit(1)).alias("n"), F.count_if("__y").alias("positives")))
    return rows, gather(sizes, len(sizes.columns)), sizes.count()


def _gone(rows: DataFrame, sizes: DataFrame, spec: FairSpec, plan: DataFrame, size: int) -> DataFrame:
    """The cells of planned clients with ``__gone``, the number of positives that the plan drops from each: a cell's first ones.

    ``size`` bounds the values of a table of cells, for ``attach``.
    """
    client = spec.client[0]
    voted = [c for c in spec.sensitive if c in VOTED]
    cells = sizes.join(plan.select(F.col("client").alias("__name"), F.col("column").alias("__column"), F.col("value").alias("__value"),
                                   F.col("drop_rate").alias("__drop")), F.col(client).cast("string") == F.col("__name"))
    hit, rank = F.lit(False), F.lit(None).cast("long")
    for c in voted:
        mine = F.col("__column") == c
        hit = F.when(mine, same_value(F.col(c), sizes.schema[c].dataType, F.col("__value"))).otherwise(hit)
        rank = F.when(mine, F.col(f"__in_{c}")).otherwise(rank)
    hits = F.sum(F.when(F.col("__hit"), F.col("positives")).otherwise(0)).over(Window.partitionBy(*spec.client))
    cells = cells.withColumn("__hit", F.coalesce(hit, F.lit(False))).withColumn("__drawn", F.floor(hits * F.col("__drop")).cast("long"))
    keys = [*spec.client, *voted]
    marked = attach(rows.where("__y"), cells.where("__hit").select(*keys, "__column", "__drawn"), keys, size, spec.key, how="inner")
    drawn = marked.where(rank <= F.col("__drawn")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__gone"))
    drawn = drawn.coalesce(1) if size <= BROADCAST_CELLS else drawn
    return join_alike(cells.select(*keys, "n"), drawn, keys, "left").withColumn("__gone", F.coalesce("__gone", F.lit(0)))


def _left(rows: DataFrame, gone: DataFrame, spec: FairSpec, size: int, how: str) -> DataFrame:
    """The rows that a plan leaves; ``gone`` may carry more columns along."""
    keys = [*spec.client, *[c for c in spec.sensitive if c in VOTED]]
    found = attach(rows, gone, keys, size, spec.key, how=how)
    return found.where(~F.col("__y") | (F.col("__alike") > F.coalesce("__gone", F.lit(0))))


def calibrate(
    df: DataFrame, spec: FairSpec, features: Sequence[str], rates: Sequence[float] = RATES,
    metric: str = "DP", level: str = "attribute", threshold: float = THRESHOLD,
    models: Sequence[str] = MODELS, options: Mapping[str, Mapping] = {}, seed: int = 42, test_size: float = 0.2,
) -> Calibration:
    """Raise drop rates until the clients are biased.

    Each round plans a change for every client whose bias is undecided or weak, derives those clients again
    from the unchanged table at the round's rate, and scores them anew; clients no longer flagged keep their
    last scores. It ends when at most one client is flagged. Every round treats all its clients in one go.

    All rounds draw and hold out by one order of the rows. So the rows are ranked and written out once; what a round drops and
    holds out then follows from a row's ranks and the counts of its cell, and a round moves no rows but those it predicts.

    The log says of each entry whether it was ``applied``: the plan that ends the rounds is not. The rows returned
    are those of all clients, each changed by its last applied entry, or unchanged if it has none.
    """
    voted = [c for c in spec.sensitive if c in VOTED]
    keys, needed = [*spec.client, *voted], list(dict.fromkeys([*spec.client, *spec.key, *spec.sensitive, spec.label, *features]))
    ranked, sizes, cells = _ranked(df, spec, seed)
    size = cells * (len(keys) + 3)

    def score(gone: DataFrame) -> DataFrame:
        rows = _left(ranked, gone, spec, size, "inner")
        if level == "attribute":
            earlier = F.when(F.col("__y"), F.col("__alike")).otherwise(F.col("__rank") - F.col("__alike"))
            rank = F.col("__rank") - F.least(F.col("__gone"), earlier)
            held = rows.select(*needed, (rank <= F.col("__quota")).alias("is_test"))
        else:
            held = holdout(rows.select(*needed), spec, test_size, seed)
            held = stage(held, "held") if isinstance(models, Mapping) else held
        return _score(held, spec, features, metric, level, models, options)

    def quotas(gone: DataFrame) -> DataFrame:
        left = gone.withColumn("n", F.col("n") - F.col("__gone"))
        return settle(stratum_quotas(left, spec, test_size, voted).drop("n"))

    latest = score(quotas(sizes.select(*keys, "n", F.lit(0).cast("long").alias("__gone"))))
    every = latest.withColumn("__round", F.lit(-1))
    log = applied = None
    for number, rate in enumerate(rates):
        plan = settle(plan_next(latest, rate, level, metric, threshold, models))
        flagged = plan.count()
        if flagged:
            entries = modification_log(plan).withColumn("applied", F.lit(flagged > 1))
            log = entries if log is None else log.unionByName(entries)
        if flagged <= 1:
            break
        gone = quotas(_gone(ranked, sizes, spec, plan, size))
        now = gone.withColumn("__round", F.lit(number))
        applied = now if applied is None else applied.unionByName(now)
        latest = score(gone)
        every = every.unionByName(latest.withColumn("__round", F.lit(number)))
    if log is None:
        log = modification_log(plan).withColumn("applied", F.lit(False))
    last = Window.partitionBy("dataset")
    scores = every.withColumn("__last", F.max("__round").over(last)).where(F.col("__round") == F.col("__last")).drop("__round", "__last")
    done = df
    if applied is not None:
        final = settle(applied.groupBy(*keys).agg(F.max_by("__gone", "__round").alias("__gone")))
        done = _left(ranked, final, spec, size, "left").select(*df.columns)
    return Calibration(scores, log, unfairness_distribution(scores, level, metric, models, threshold), done)


def cross_device(
    df: DataFrame, spec: FairSpec, k: int, order: Sequence[str], features: Sequence[str], metric: str = "DP",
    level: str = "attribute", models: Sequence[str] = MODELS, options: Mapping[str, Mapping] = {},
    seed: int = 42, bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cut every client into k chunks, score each as a client, and keep those with a clear bias.

    Returns the rows of the chosen clients, named ``{client}_{i}``, and their scores.
    """
    client = spec.client[0]
    pieces = chunk(df, spec, k, order)
    # Written out once, as the holdout reads it several times: counts, cuts and the rows themselves.
    pieces = stage(pieces.withColumn(client, client_name(client, "chunk")).drop("chunk"), "pieces")
    scores = score_clients(pieces, spec, features, metric, level, models, options, seed)
    chosen = settle(select_clients(scores, level, metric, models, bounds).select("dataset"))
    rows = attach(pieces, chosen.withColumnRenamed("dataset", client), [client], chosen.count(), spec.key,
                  how="left_semi")
    return rows, scores.join(chosen, "dataset", "left_semi")
