"""From a person-level table to a perturbed, split and partitioned client dataset."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions import client_name
from evenhand.operators import counts, fairness, perturb, splits, transform
from evenhand.plans.runtime import stage
from evenhand.sources.client_files import save_clients
from evenhand.sources.reports import config_json
from evenhand.sources.tables import ROW_ORDER
from evenhand.spec import (LEVELS, METRICS, SETTINGS, FairSpec, Modification, TaskSpec, require_choice)


@dataclass(frozen=True)
class DatasetOptions:
    """How a dataset is built. The order is fixed: remap, modify, shuffle, preprocess, split, partition.

    Without ``shuffle`` folds and partitions are contiguous in the order of the ``order`` columns, which by default are those
    that ``with_row_order`` adds to rows read from files.
    """

    task: TaskSpec
    spec: FairSpec
    clients: Sequence[str] | None = None
    partitions: int | Mapping[str, int] | None = None
    partition_by: Column | None = field(default=None, compare=False)
    seed: int = 42
    shuffle: bool = True
    order: Sequence[str] = ROW_ORDER
    mapping: Mapping[str, Mapping] | None = None
    modifications: Iterable[Modification] | DataFrame | None = None
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    setting: str | None = None
    fractions: Sequence[float] = (0.7, 0.15, 0.15)
    metric: str = "DP"
    level: str = "attribute"
    intersect: bool = False

    def __post_init__(self):
        require_choice("fairness metric", self.metric, METRICS)
        require_choice("fairness level", self.level, LEVELS)
        if self.setting is not None:
            require_choice("setting", self.setting, SETTINGS)


class ClientDataset:
    """A client dataset as one table with the columns ``fold``, ``split`` and ``partition_id``, made when first asked for.

    ``split`` is the client, followed by the fold where rows are split into folds.
    """

    def __init__(self, source: DataFrame, options: DatasetOptions):
        self.source = source
        self.options = options
        self._table: DataFrame | None = None

    @property
    def table(self) -> DataFrame:
        """The prepared table; built once, run by whatever action uses it."""
        if self._table is None:
            self._table = self._prepare()
        return self._table

    def _prepare(self) -> DataFrame:
        o, spec = self.options, self.options.spec
        client = spec.client[0]
        rows = self.source if o.clients is None else self.source.where(F.col(client).isin(*o.clients))
        order = None if o.shuffle else list(o.order)
        df = transform.apply_task(rows, o.task, [*dict.fromkeys([*spec.client, *spec.key, *(order or ())])])
        if o.mapping:
            df = transform.remap(df, o.mapping)
        if o.modifications is not None:
            # Written once, so that the ranks of folds and partitions do not repeat the draws.
            df = stage(perturb.apply_modifications(df, spec, o.modifications, o.seed), "changed")
        if o.preprocess is not None:
            df = df.transform(o.preprocess)
        within = []
        if o.setting == "cross-silo":
            df = splits.split_folds(df, spec, o.fractions, o.setting, o.seed, order)
            df = df.withColumn("split", client_name(client, "fold"))
            within = ["fold"]
        else:
            df = df.withColumn("split", F.col(client).cast("string"))
        df = splits.assign_partitions(df, spec, o.partitions, o.partition_by, within, o.seed, order)
        return df.drop(*[c for c in order or () if c not in (*spec.key, *o.task.features, o.task.label)])

    @property
    def audited(self) -> FairSpec:
        """The spec by which every partition of every split is looked at on its own."""
        spec = self.options.spec
        return FairSpec(spec.sensitive, spec.label, ("split", "partition_id"), spec.key, spec.prediction)

    def load_partition(self, split: str, partition_id: int = 0) -> DataFrame:
        return self.load_split(split).where(F.col("partition_id") == partition_id)

    def load_split(self, split: str) -> DataFrame:
        return self.table.where(F.col("split") == split)

    def evaluate(self) -> tuple[DataFrame, DataFrame]:
        """Value counts and fairness of every partition, both as long tables."""
        o = self.options
        spec = self.audited
        counted = counts.value_counts(self.table, spec, partition=None)
        return counted, fairness.fairness(self.table, spec, o.metric, o.level, o.intersect)

    def proportions(self, digits: int = 3) -> DataFrame:
        spec = self.options.spec
        by_split = FairSpec(spec.sensitive, spec.label, ("split",), spec.key)
        return counts.proportions(self.table, by_split, digits=digits)

    def save(self, path: str, fmt: str = "csv") -> None:
        """Write one folder per split and partition."""
        if self.options.spec.sensitive:
            warnings.warn("the saved files hold sensitive columns; leave them out where a model must not see them",
                          stacklevel=2)
        save_clients(self.table, path, fmt)

    def to_json(self, **options) -> str:
        return config_json(self.options, **options)
