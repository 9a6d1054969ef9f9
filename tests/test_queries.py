"""The model queries leave rates, models, bounds and the size of trees to the library."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evenhand.spec import FairSpec
from workload import queries


def test_model_queries_are_not_cut(monkeypatch):
    calls = []
    note = lambda *args, **named: calls.append((args, named)) or SimpleNamespace(log=None)
    monkeypatch.setattr(queries.calibration, "calibrate", note)
    monkeypatch.setattr(queries.calibration, "cross_device", lambda *a, **n: (note(*a, **n), None))
    monkeypatch.setattr(queries.models, "evaluate_models", note)
    monkeypatch.setattr(queries, "stage", lambda df, name: df)
    monkeypatch.setattr(queries.splits, "holdout", lambda df, spec: df)
    monkeypatch.setattr(queries, "F", SimpleNamespace(col=lambda name: _Column()))
    monkeypatch.setattr(queries.t, "coded", lambda spark, sf: _Column())
    for name in ("calibrated_clients", "cross_device_scores", "model_grid"):
        queries.REGISTRY[name](None, None)
    assert len(calls) == 3 and len(calls[0][0]) == 3
    for _, named in calls:
        assert not {"rates", "models", "bounds"} & set(named) and set(named["options"]) == {"LogisticRegression"}


class _Column:
    def __invert__(self):
        return self

    def cast(self, kind):
        return self

    def withColumn(self, name, column):
        return self


def test_sweep_divides_folds_that_are_written_out(monkeypatch):
    """Counting the folds and dividing them must not rank all rows anew each time."""
    monkeypatch.setattr(queries.t, "coded", lambda spark, sf: "rows")
    monkeypatch.setattr(queries.splits, "split_folds", lambda df, spec: f"folds of {df}")
    monkeypatch.setattr(queries, "stage", lambda df, name: f"written {df}")
    monkeypatch.setattr(queries.splits, "assign_partitions", lambda df, spec, k, within: f"{k} parts of {df}")
    monkeypatch.setattr(queries, "evaluate_fairness", lambda df, *args, **named: (None, df))
    assert queries.REGISTRY["partition_sweep"](None, None) == "2 parts of written folds of rows"


def test_chunks_are_written_out_before_they_are_held_out(spark, monkeypatch):
    from evenhand.plans import calibrate

    class Seen(Exception):
        pass

    def look(pieces, *rest):
        raise Seen([f.rsplit("/", 2)[1] for f in pieces.inputFiles()])

    monkeypatch.setattr(calibrate, "score_clients", look)
    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("client"), "id", F.lit("a").alias("g"), F.lit(True).alias("y"))
    with pytest.raises(Seen) as seen:
        calibrate.cross_device(rows, FairSpec(("g",), "y", ("client",), ("id",)), 2, ["id"], ["id"])
    assert seen.value.args[0] and all(f.startswith("pieces-") for f in seen.value.args[0])
