"""Metrics of one's own, averages of vectors, and rows in the order of their files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import scores, splits
from evenhand.sources.tables import ROW_ORDER, with_row_order
from evenhand.spec import FairSpec

SPEC = FairSpec(("SEX",), "label", ("client",), ("row",), "pred")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(None if i % 11 == 0 else i % 3, i, None if i % 13 == 0 else float(i % 2 + 1), None if i % 17 == 0 else i % 5 < 2, i % 4 < 2, i / 7)
            for i in range(600)]
    return spark.createDataFrame(rows, "client int, row int, SEX double, label boolean, pred boolean, weight double").repartition(7)


def test_states_equal_expressions(scored):
    """Weighted agreement and F1, by states that are merged over tasks and by expressions."""
    y, p = F.col("y"), F.col("p")
    f1 = scores.MergeableMetric(lambda y, p: np.array([(y & p).sum(), y.sum() + p.sum()]), np.add, lambda s: 2 * s[0] / s[1])
    agree = scores.MergeableMetric(lambda y, p, weight: np.array([weight[y == p].sum(), weight.sum()]), np.add, lambda s: s[0] / s[1], ("weight",))
    largest = scores.MergeableMetric(lambda y, p, weight: np.array([weight.max()]), np.maximum, lambda s: s[0], ("weight",))
    found = scores.own_metrics(scored, SPEC, {
        "f1": f1, "f1_too": 2 * F.sum(y * p) / (F.sum("y") + F.sum("p")), "agree": agree, "largest": largest,
        "agree_too": F.sum(F.when(y == p, F.col("weight")).otherwise(0)) / F.sum("weight"), "largest_too": F.max("weight")}).collect()
    assert {r["client"] for r in found} == {None, 0, 1, 2}
    for r in found:
        assert r["f1"] == pytest.approx(r["f1_too"]) and r["agree"] == pytest.approx(r["agree_too"]) and r["largest"] == r["largest_too"]
    one, two = (sorted(scores.own_metric_gaps(scored, SPEC, "m", m).collect(), key=repr) for m in (f1, 2 * F.sum(y * p) / (F.sum("y") + F.sum("p"))))
    assert [(r["client"], r["g_i"], r["g_j"]) for r in one] == [(r["client"], r["g_i"], r["g_j"]) for r in two]
    table = scores.score_table(scored, SPEC, metrics={"f1": f1})
    assert table.columns == ["client", "accuracy", "f1", "DP_SEX"] and table.count() == 4


def test_own_metrics_of_no_rows(scored):
    count = scores.MergeableMetric(lambda y, p: np.array([len(y)]), np.add, lambda s: s[0])
    assert scores.own_metrics(scored.where("false"), SPEC, {"n": count, "m": F.count("*")}).collect() == []


def test_vectors_are_averaged_by_place(spark):
    rows = [("a", [1.0, 2.0, 3.0], 1), ("a", [3.0, 4.0], 3), ("a", None, 5), ("a", [9.0], None), ("b", [None, 1.0], 2), (None, [4.0], 1), ("c", [], 1)]
    df = spark.createDataFrame(rows, "client string, w array<double>, n int").repartition(3)
    found = {r["client"]: r["w"] for r in scores.weighted_vectors(df, "w", "n", ["client"]).collect()}
    assert found == {"a": [2.5, 3.5, 3.0], "b": [1.0], None: [4.0]}
    long = [(i, np.arange(5000.0).tolist(), i + 1) for i in range(4)]
    (row,) = scores.weighted_vectors(spark.createDataFrame(long, "i int, w array<double>, n int"), "w", "n").collect()
    assert row["w"] == pytest.approx(np.arange(5000.0))


def test_rows_in_the_order_of_several_files(spark, tmp_path):
    """Part files are in the order of their names; folds and partitions follow it."""
    path = str(tmp_path / "rows")
    spark.range(0, 1000, numPartitions=5).select((F.col("id") * 7919 % 1000).alias("row"), F.col("id").alias("place"),
                                                 (F.col("id") % 2).alias("client"), F.lit(True).alias("label")).write.parquet(path)
    rows = with_row_order(spark.read.parquet(path))
    spec = FairSpec((), "label", ("client",), ("row",))
    parts = splits.assign_partitions(splits.split_folds(rows, spec, order=ROW_ORDER), spec, 5, within=("fold",), order=ROW_ORDER)
    for client in (0, 1):
        mine = sorted(parts.where(F.col("client") == client).collect(), key=lambda r: r["place"])
        assert [r["fold"] for r in mine] == ["train"] * 350 + ["val"] * 75 + ["test"] * 75
        assert [r["partition_id"] for r in mine] == [i * 5 // 350 for i in range(350)] + 2 * [i * 5 // 75 for i in range(75)]
