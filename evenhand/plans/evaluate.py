"""Auditing every partition of a table, with or without a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.operators import counts, fairness
from evenhand.operators.models import FITS, Model, evaluate_models, features_of
from evenhand.operators.splits import first_partitions, holdout
from evenhand.plans.runtime import stage
from evenhand.sources.reports import write_report
from evenhand.spec import FairSpec, require_choice


def evaluate_fairness(
    df: DataFrame,
    spec: FairSpec,
    metric: str = "DP",
    level: str = "attribute",
    intersect: bool = False,
    model: str | Model | None = None,
    max_partitions: int | None = None,
    unit: str = "absolute",
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Value counts and fairness of every client and partition, all attributes in one job each.

    With a model it is fitted on the ``train`` rows of a partition and judged on the ``val`` rows of the same
    partition. With a path both tables are written there, one folder per attribute.
    """
    rows = first_partitions(df, max_partitions)
    by = (*spec.client, "partition_id")
    counted = counts.value_counts(rows, spec, unit=unit)
    audited = FairSpec(spec.sensitive, spec.label, by, spec.key, spec.prediction)
    if model is not None:
        if isinstance(model, str):
            require_choice("model", model, tuple(FITS))
            model = FITS[model]
        rows = stage(rows, "divided")
        rows = model(rows, audited, features_of(rows, audited, ("fold", "split")),
                           F.col("fold") == "train", F.col("fold") == "val")
        audited = FairSpec(spec.sensitive, spec.label, by, spec.key, "prediction")
    gaps = fairness.fairness(rows, audited, metric, level, intersect)
    if path is not None:
        write_report(counted, f"{path}/counts", ["attribute"])
        write_report(gaps, f"{path}/{metric}", ["attribute"])
    return counted, gaps


def local_audit(df: DataFrame, spec: FairSpec, features: Sequence[str], model: str = "LogisticRegression",
                metric: str = "DP", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Each client's own model, fitted on 80 % of its rows: accuracy and gaps on the rest."""
    needed = dict.fromkeys([*spec.client, *spec.key, *spec.sensitive, spec.label, *features])
    held = stage(holdout(df.select(*needed), spec, test_size, seed), "held")
    return evaluate_models(held, spec, features, ~F.col("is_test"), F.col("is_test"), metric, "attribute", (model,))
