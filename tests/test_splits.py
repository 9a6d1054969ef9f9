"""Ranks, draws and splits: worked answers, and the same rows whichever way they are found."""

import pytest
from pyspark.sql import functions as F

import evenhand.operators.ranks as ranks
import evenhand.plans.runtime as runtime
from evenhand.functions import group_pred
from evenhand.operators import perturb, splits
from evenhand.spec import FairSpec, Modification, modifications_from_dict, plan_table

SPEC = FairSpec(("g",), "y", ("client",), ("id",))


def many(spark, n=3000):
    """A third of the rows in one client, ids with one far outlier, a null client."""
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, None).otherwise(
            F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("client"),
        F.when(F.col("id") == n - 1, F.lit(9 * 10**18)).when(F.col("id") == 3, F.lit(-9 * 10**18)).otherwise(
            F.col("id")).alias("id"),
        (F.col("id") % 4).cast("string").alias("g"), (F.col("id") % 5 < 3).alias("y"))
    return df


def results(df, names=None):
    plan = [Modification("big", 0, "g", "1", 0.5, 0.5), Modification("big", 1, "g", "2", 0.1, 0.9),
            Modification("c1", 0, "g", "3", 1.0, 0.0), Modification("c2", 0, "g", "0", 0.3, 0.3, "g", "0")]
    made = {
        "folds": lambda: splits.split_folds(df, SPEC).select("id", "fold"),
        "parts": lambda: splits.assign_partitions(df, SPEC, {"big": 70, "c1": 3}).select("id", "partition_id"),
        "chunks": lambda: splits.chunk(df, SPEC, 9, ["id"]).select("id", "chunk"),
        "holdout": lambda: splits.holdout(df, SPEC).select("id", "is_test"),
        "strata": lambda: splits.holdout(df, SPEC, strata=["g"]).select("id", "is_test"),
        "clients": lambda: splits.split_clients(df, SPEC).select("id", "fold"),
        "drop": lambda: perturb.drop_positive(df, SPEC, group_pred("g", "1"), 0.29).select("id", "y"),
        "plan": lambda: perturb.apply_modifications(df, SPEC, plan).select("id", "y"),
        "ties": lambda: splits.chunk(df.withColumn("day", F.expr("least(abs(id) % 7, 3)")), SPEC, 5, ["day", "id"]
                                     ).select("id", "chunk"),
        "tiny": lambda: splits.split_folds(df, SPEC, (0.0, 0.0, 1.0)).select("id", "fold"),
    }
    return {k: sorted(map(tuple, made[k]().collect())) for k in names or made}


def test_all_ways_of_ranking_agree(spark, monkeypatch):
    df = many(spark).coalesce(2).cache()
    window = results(df)
    monkeypatch.setattr(ranks, "WINDOW_ROWS", 0)
    monkeypatch.setattr(ranks, "BINS", 32)
    monkeypatch.setattr(ranks, "BIN_ROWS", 20)
    distinct = ("parts", "chunks", "ties", "strata", "clients", "plan", "tiny")
    assert results(df, distinct) == {k: window[k] for k in distinct}
    # Nothing fits a broadcast: every join is salted.
    defaults = runtime.attach.__defaults__
    monkeypatch.setattr(runtime.attach, "__defaults__", (*defaults[:-1], 0))
    salted = ("parts", "plan")
    assert results(df, salted) == {k: window[k] for k in salted}


def awkward(spark):
    """Order columns with nulls, NaN, infinities, doubles over all magnitudes, ties, and texts with long common starts."""
    n = F.col("id")
    spread = F.when(n % 3 == 0, -1).otherwise(1) * F.pow(F.lit(10.0), (n * 37 % 600) - 300)
    x = (F.when(n % 11 == 0, None).when(n % 13 == 0, float("nan")).when(n % 17 == 0, float("inf"))
         .when(n % 19 == 0, -float("inf")).when(n % 7 == 0, 0.0).otherwise(spread))
    text = F.when(n % 23 == 0, None).otherwise(F.concat(F.lit("the same long beginning of all texts "), F.md5((n % 900).cast("string"))))
    return spark.range(2000).select(F.when(n % 5 == 0, "b").otherwise("a").alias("client"), "id", F.lit("g").alias("g"),
                                    F.lit(True).alias("y"), x.alias("x"), text.alias("s"), F.lit(1).alias("same"))


@pytest.mark.parametrize("order", [("x", "id"), ("s", "id"), ("same", "s", "x", "id"), ("same", "x", "s", "id")])
def test_awkward_orders_rank_alike(spark, monkeypatch, order):
    df = awkward(spark).coalesce(2).cache()
    chunked = lambda: sorted((r["id"], r["chunk"]) for r in splits.chunk(df, SPEC, 4, order).collect())
    window = chunked()
    monkeypatch.setattr(ranks, "WINDOW_ROWS", 0)
    monkeypatch.setattr(ranks, "BINS", 64)
    monkeypatch.setattr(ranks, "BIN_ROWS", 40)
    assert chunked() == window


def test_last_bins_are_small_unless_rows_are_alike(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BIN_ROWS", 100)
    sizes = []
    count = ranks.Window.partitionBy

    def watched(*keys):
        if any(str(k).startswith("__b") for k in keys):
            sizes.append(keys)
        return count(*keys)

    monkeypatch.setattr(ranks.Window, "partitionBy", staticmethod(watched))
    rows = spark.range(20_000).select(F.lit("a").alias("client"), "id", F.when(F.col("id") == 7, float("inf")).otherwise(
        F.col("id") / 7).alias("x"))
    made, order = ranks.column_order(rows, ["x", "id"])
    cuts, _ = ranks.find_cuts(made, ["client"], order, F.array(F.lit(5000).cast("long"), F.lit(20_000).cast("long")))
    assert [c["at"]["o1"] for c in cuts.first()["cuts"]] == [5000, 7]
    # Two or three passes suffice, although one value is infinite.
    assert max(len([k for k in keys if str(k).startswith("__b")]) for keys in sizes) <= 4


def test_splits_check_their_arguments(table):
    df = ten(table)
    for bad in ((0.5, 0.2, 0.2, 0.1), (0.9, 0.9, 0.15), (0.5, 0.5), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            splits.split_folds(df, SPEC, bad)
        with pytest.raises(ValueError):
            splits.split_clients(df, SPEC, bad)
    for bad in (lambda: splits.holdout(df, SPEC, 1.5), lambda: splits.chunk(df, SPEC, 0, ["id"]),
                lambda: splits.assign_partitions(df, SPEC, 0), lambda: splits.assign_partitions(df, SPEC, {"c": 0})):
        with pytest.raises(ValueError):
            bad()


def test_plans_name_a_step_once(spark, table):
    plan = [Modification("c", 0, "g", "g", 0.1), Modification("c", 0, "g", "g", 0.2)]
    with pytest.raises(ValueError, match="two entries"):
        perturb.apply_modifications(ten(table), SPEC, plan)
    with pytest.raises(ValueError, match="two entries"):
        perturb.apply_modifications(ten(table), SPEC, plan_table(spark, plan))


def ten(table, n=10, positives=10):
    return table("client string, id long, g string, y boolean",
                 *[("c", i, "g", i < positives) for i in range(n)])


def counted(df, column):
    return [r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column).collect()]


def test_chunks_and_folds(spark, table):
    df = ten(table)
    assert counted(splits.chunk(df, SPEC, 4, ["id"]), "chunk") == [3, 3, 2, 2]
    first = splits.chunk(df, SPEC, 4, ["id"]).where("chunk = 0").select("id").collect()
    assert sorted(r["id"] for r in first) == [0, 1, 2]
    folds = splits.split_folds(df, SPEC)
    assert [folds.where(F.col("fold") == f).count() for f in splits.FOLDS] == [7, 1, 2]
    ak = spark.range(3463).select(F.lit("AK").alias("client"), "id", F.lit("g").alias("g"), F.lit(True).alias("y"))
    assert counted(splits.chunk(ak, SPEC, 3, ["id"]), "chunk") == [1155, 1154, 1154]
    assert counted(splits.assign_partitions(df, SPEC, 3), "partition_id") == [4, 3, 3]
    assert counted(splits.assign_partitions(df, SPEC), "partition_id") == [10]


def test_modes_and_order_columns(table):
    df = ten(table)
    with pytest.raises(ValueError, match="unknown setting"):
        splits.split_folds(df, SPEC, setting="other")
    assert "fold" not in splits.split_folds(df, SPEC, setting="cross-device").columns
    with pytest.raises(ValueError, match="order column"):
        splits.chunk(df.withColumn("g", F.array("g")), SPEC, 2, ["g", "id"])


def test_stratified_holdout_takes_the_largest_remainders(table):
    sizes = {"a": 7, "b": 4, "c": 4}
    rows = [("c", i, g, True) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    df = table("client string, id long, g string, y boolean", *rows)
    held = splits.holdout(df, SPEC, 0.2, strata=["g"]).where("is_test").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in held} == {"a": 1, "b": 1, "c": 1}


def test_whole_clients_and_index(spark):
    df = many(spark)
    per_client = splits.split_clients(df, SPEC).groupBy("client").agg(F.countDistinct("fold").alias("n"))
    assert {r["n"] for r in per_client.collect()} == {1}
    index = splits.client_index(df.where("client is not null")).orderBy("client_index").collect()
    assert [r["client_index"] for r in index] == list(range(len(index)))
    assert [r["client"] for r in index] == sorted(r["client"] for r in index)


@pytest.mark.parametrize("n, rate, dropped", [(7, 0.3, 2), (100, 0.29, 28), (5, 0.0, 0), (5, 1.0, 5)])
def test_drop_counts_are_truncated(table, n, rate, dropped):
    df = ten(table, n + 3, n)
    left = perturb.drop_positive(df, SPEC, F.lit(True), rate)
    assert left.where("y").count() == n - dropped and left.where("not y").count() == 3
    flipped = perturb.flip_positive(df, SPEC, F.lit(True), rate)
    assert flipped.count() == n + 3 and flipped.where("y").count() == n - dropped


def test_rates_are_checked(spark, table):
    for bad in (1.2, -0.1):
        with pytest.raises(ValueError, match="between 0 and 1"):
            perturb.drop_positive(ten(table), SPEC, F.lit(True), bad)
        with pytest.raises(ValueError, match="between 0 and 1"):
            Modification("c", 0, "g", "g", drop_rate=bad)
    plan = table("client string, seq int, `column` string, value string, drop_rate double, flip_rate double, "
                 "column2 string, value2 string", ("c", 0, "g", "g", 1.5, 0.0, None, None))
    with pytest.raises(ValueError, match="between 0 and 1"):
        perturb.apply_modifications(ten(table), SPEC, plan)


def test_steps_follow_each_other(table):
    plan = modifications_from_dict({"c": {"g": {
        "drop_rate": 0.5, "flip_rate": 0.5, "value": "g", "attribute": None, "attribute_value": None}}})
    done = perturb.apply_modifications(ten(table), SPEC, plan)
    assert done.count() == 5 and done.where("y").count() == 3
    untouched = perturb.apply_modifications(ten(table), SPEC, [Modification("other", 0, "g", "g", 0.5, 0.5)])
    assert untouched.where("y").count() == 10


def test_plan_values_compare_by_number(table):
    df = table("client string, id long, g double, h int, y boolean", *[("c", i, 2.0, i % 2, True) for i in range(8)])
    done = perturb.apply_modifications(df, SPEC, [Modification("c", 0, "g", 2, 1.0, 0.0, "h", 1.0)])
    assert sorted(r["id"] for r in done.collect()) == [0, 2, 4, 6]
    half_given = perturb.apply_modifications(df, SPEC, [Modification("c", 0, "g", 2, 1.0, 0.0, "h", None)])
    assert half_given.count() == 0


def test_latest_modification(table):
    log = table("state string, drop_rate double, attribute string, value int",
                ("AK", 0.1, "RAC1P", 1), ("AK", 0.3, "RAC1P", 4), ("CT", 0.1, "SEX", 2), ("AK", 0.2, "RAC1P", 2))
    found = {r["state"]: (r["drop_rate"], r["attribute"], r["value"]) for r in
             perturb.latest_modification(log).collect()}
    assert found == {"AK": (0.3, "RAC1P", 4), "CT": (0.1, "SEX", 2)}


def test_a_table_of_millions_in_few_groups_is_not_shuffled_to_be_ranked(spark):
    rows = spark.range(4_000_000).select((F.col("id") % 8).alias("client"), "id")
    assert not ranks.window_fits(rows, ["client"], None, 1, None)
    assert ranks.window_fits(rows.where("id < 1000000"), ["client"], None, 1, None)
    # Cuts of many groups would not fit a broadcast, so a window serves them.
    assert ranks.window_fits(rows.withColumn("client", F.col("id") % 300_000), ["client"], None, 1, None)
