"""The registered queries: each operator on the given tables, over all their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions import group_pred, order_key
from evenhand.operators import counts, fairness, models, perturb, scores, splits, transform
from evenhand.plans import calibrate as calibration
from evenhand.plans.dataset import ClientDataset, DatasetOptions
from evenhand.plans.evaluate import evaluate_fairness, local_audit
from evenhand.plans.runtime import scratch_path, stage
from evenhand.sources.client_files import load_client_csvs, load_clients, save_client_csvs, save_clients
from evenhand.sources.reports import plan_json, read_distribution, read_scores, write_report
from evenhand.sources.tables import ROW_ORDER, read_clients, with_row_order
from evenhand.spec import FairSpec, Modification, TaskSpec
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- rates and gaps ---------------------------------------------------------------------------------------

@query
def selection_rates(spark, sf):
    rates = fairness.group_rates(t.orders(spark, sf), t.ORDERS_SCORED)
    return rates.select("client", "attribute", "g", "n", "selection_rate")


@query
def true_false_rates(spark, sf):
    return fairness.group_rates(t.docs(spark, sf), t.DOCS).select("client", "attribute", "g", "n", "tpr", "fpr")


@query
def dp_pairs(spark, sf):
    return fairness.fairness(t.orders(spark, sf), t.ORDERS, "DP", "attribute-value")


@query
def dp_attribute(spark, sf):
    found = fairness.fairness(t.orders(spark, sf), t.ORDERS, "DP", "attribute")
    return found.select("client", "attribute", "metric", "gap")


@query
def dp_value(spark, sf):
    return fairness.fairness(t.orders(spark, sf), t.ORDERS, "DP", "value")


@query
def dp_wide_pairs(spark, sf):
    spec = FairSpec(("c_mktsegment",), "label", ("client",), ("o_orderkey",))
    gaps = fairness.fairness(t.orders(spark, sf), spec, "DP", "attribute-value")
    return fairness.wide(gaps, spec, "DP", "attribute-value")


@query
def dp_wide_pairs_all(spark, sf):
    """Three attributes that share their codes, each with columns of its own."""
    gaps = fairness.fairness(t.coded(spark, sf), t.CODED, "DP", "attribute-value")
    return fairness.wide(gaps, t.CODED, "DP", "attribute-value")


@query
def dp_wide_value(spark, sf):
    gaps = fairness.fairness(t.orders(spark, sf), t.ORDERS, "DP", "value")
    return fairness.wide(gaps, t.ORDERS, "DP", "value")


@query
def eo_pairs(spark, sf):
    return fairness.fairness(t.docs(spark, sf), t.DOCS, "EO", "attribute-value")


@query
def eo_value_docs(spark, sf):
    return fairness.fairness(t.docs(spark, sf), t.DOCS, "EO", "value")


@query
def eo_value_orders(spark, sf):
    return fairness.fairness(t.orders(spark, sf), t.ORDERS_SCORED, "EO", "value")


@query
def eo_empty_as_null(spark, sf):
    return fairness.fairness(t.docs(spark, sf), t.DOCS, "EO", "value", empty="null")


@query
def dataset_dp_sweep(spark, sf):
    return fairness.fairness(t.items(spark, sf), t.ITEMS, "DP", "value")


@query
def dataset_eo_sweep(spark, sf):
    return fairness.fairness(t.items(spark, sf), t.ITEMS, "EO", "value")


@query
def dp_intersection(spark, sf):
    return fairness.fairness(t.items(spark, sf), t.ITEMS, "DP", "value", intersect=True)


@query
def eo_intersection(spark, sf):
    return fairness.fairness(t.items(spark, sf), t.ITEMS_SCORED, "EO", "value", intersect=True)


@query
def coded_dp_value(spark, sf):
    return fairness.fairness(t.coded(spark, sf), t.CODED, "DP", "value")


@query
def partition_fairness(spark, sf):
    rows = splits.assign_partitions(t.orders(spark, sf), t.ORDERS, by=F.col("o_orderkey") % 4)
    counted, gaps = evaluate_fairness(rows, t.ORDERS, "DP", "value")
    return gaps


@query
def first_partitions_fairness(spark, sf):
    """Only the first partitions are shown, which is what the operator is for."""
    rows = splits.assign_partitions(t.orders(spark, sf), t.ORDERS, 4)
    counted, gaps = evaluate_fairness(rows, t.ORDERS, "DP", "attribute", max_partitions=3)
    return gaps.select("client", "partition_id", "attribute", "gap")


# --- distributions ------------------------------------------------------------------------------------------

def _thirds(spark, sf):
    return splits.assign_partitions(t.orders(spark, sf), t.ORDERS, by=F.col("o_orderkey") % 3)


@query
def value_counts(spark, sf):
    return counts.value_counts(_thirds(spark, sf), t.ORDERS)


@query
def value_counts_events(spark, sf):
    return counts.value_counts(t.events(spark, sf), t.EVENTS, partition=None)


@query
def value_percent(spark, sf):
    return counts.value_counts(_thirds(spark, sf), t.ORDERS, unit="percent")


@query
def proportions(spark, sf):
    shares = counts.proportions(_thirds(spark, sf), t.ORDERS)
    return shares.withColumns({c: F.col(c).cast("string") for c in ("client", "partition_id")})


@query
def proportions_json(spark, sf):
    shares = counts.proportions(_thirds(spark, sf), t.ORDERS)
    found = counts.proportions_json(shares, ["level", "client", "partition_id", "attribute"])
    return found.withColumns({c: F.col(c).cast("string") for c in ("client", "partition_id")})


@query
def profile(spark, sf):
    return counts.profile(t.events(spark, sf), t.EVENTS)


@query
def frequencies(spark, sf):
    return counts.by_frequency(counts.value_counts(t.items(spark, sf), t.ITEMS, partition=None))


# --- transforms --------------------------------------------------------------------------------------------

@query
def chosen_clients(spark, sf):
    """Scan of chosen clients only, here nations as clients of the customer table."""
    rows = read_clients(spark, f"{sf}/customer.parquet", [0, 3, 7], client="c_nationkey")
    task = TaskSpec("orders", ("c_acctbal", "c_mktsegment"), "rich", F.col("c_acctbal") > 5000)
    return transform.apply_task(rows, task, ("c_nationkey", "c_custkey"))


@query
def remap(spark, sf):
    rows = transform.remap(t.coded(spark, sf), {"RAC1P": {1: 2, 2: 3, 3: 1}, "MAR": {3: 2}})
    return rows.select("client", *t.CODED.key, "RAC1P", "MAR")


@query
def remap_text(spark, sf):
    rows = transform.remap(t.orders(spark, sf), {"o_orderpriority": {
        "1-URGENT": "2-HIGH", "2-HIGH": "3-MEDIUM", "5-LOW": "4-NOT SPECIFIED"}})
    return rows.select("client", "o_orderkey", "o_orderpriority")


@query
def remap_long(spark, sf):
    """Numbers beyond the whole numbers of a double stay exact."""
    rows = t.orders(spark, sf).withColumn("code", F.col("o_orderkey") + F.lit(2**53))
    return transform.remap(rows, {"code": {2**53 + 1: 2**53 + 2, 2**53 + 3: 2**53 + 5}}).select("client", "o_orderkey", "code")


@query
def binarize(spark, sf):
    rows = transform.binarize(t.coded(spark, sf), ["SEX", "MAR", "RAC1P"])
    return transform.label_to_int(rows, "label", ">50K").select(
        "client", *t.CODED.key, "SEX", "MAR", "RAC1P", ">50K")


@query
def group_predicate(spark, sf):
    hit = group_pred("c_mktsegment", "BUILDING", "o_orderpriority", "1-URGENT") & F.col("label")
    return t.orders(spark, sf).where(hit).select("client", "o_orderkey")


@query
def feature_view(spark, sf):
    return transform.feature_view(t.orders(spark, sf), t.ORDERS_SCORED)


@query
def minmax(spark, sf):
    rows = transform.minmax(t.items(spark, sf), ["l_quantity", "l_extendedprice"])
    return rows.select("client", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query
def minmax_by_client(spark, sf):
    rows = transform.minmax(t.items(spark, sf), ["l_quantity", "l_extendedprice"], by=["client"])
    return rows.select("client", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query
def one_hot(spark, sf):
    rows = transform.one_hot(t.items(spark, sf), ["l_returnflag", "l_linestatus"])
    return rows.drop("label", "pred", "l_quantity", "l_discount", "l_tax")


@query
def one_hot_index(spark, sf):
    rows = transform.one_hot_index(t.items(spark, sf), ["l_returnflag", "l_linestatus", "l_partkey"])
    return rows.select("client", *t.ITEMS.key, *[F.get("hot", F.lit(j)).alias(f"hot{j}") for j in range(3)])


@query
def minmax_fitted(spark, sf):
    """Bounds from the training fold, applied to all rows."""
    rows = splits.split_folds(t.orders(spark, sf), t.ORDERS)
    return transform.minmax(rows, ["o_totalprice"], fit=F.col("fold") == "train").select("client", "o_orderkey", "o_totalprice")


@query
def assemble(spark, sf):
    rows = transform.assemble(t.items(spark, sf), ["l_quantity", "l_discount"])
    return rows.select("client", *t.ITEMS.key, F.size("features").alias("width"),
                       F.get("features", F.lit(0)).cast("double").alias("first"),
                       F.get("features", F.lit(2)).cast("double").alias("bias"))


# --- perturbation -------------------------------------------------------------------------------------------

@query
def drop_positive(spark, sf):
    pred = F.col("c_mktsegment") == "BUILDING"
    rows = perturb.drop_positive(t.orders(spark, sf), t.ORDERS, pred, 0.29)
    return rows.select("client", "o_orderkey", "label")


@query
def flip_positive(spark, sf):
    pred = group_pred("c_mktsegment", "MACHINERY", "o_orderpriority", "5-LOW")
    rows = perturb.flip_positive(t.orders(spark, sf), t.ORDERS, pred, 0.4)
    return rows.select("client", "o_orderkey", "label")


def two_steps(clients=range(25)) -> list[Modification]:
    first = [Modification(str(c), 0, "c_mktsegment", "BUILDING", 0.2, 0.1, "o_orderpriority", "1-URGENT")
             for c in clients]
    second = [Modification(str(c), 1, "o_orderpriority", "1-URGENT", 0.3, 0.2) for c in clients if c % 2 == 0]
    return first + second


@query
def modification_plan(spark, sf):
    rows = perturb.apply_modifications(t.orders(spark, sf), t.ORDERS, two_steps())
    return rows.select("client", "o_orderkey", "label")


@query
def latest_modification(spark, sf):
    """A log of three rounds, derived from the orders' yearly totals per customer nation."""
    log = t.orders(spark, sf).groupBy("client", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("client").cast("string").alias("state"),
        (F.substring("o_orderpriority", 1, 1).cast("int") / 10).alias("drop_rate"),
        F.when(F.col("n") % 2 == 0, "SEX").otherwise("RAC1P").alias("attribute"),
        (F.col("n") % 5 + 1).cast("int").alias("value"))
    return perturb.latest_modification(log)


# --- partitions and folds -----------------------------------------------------------------------------------

@query
def shuffle_order(spark, sf):
    return t.events(spark, sf).select("client", "event_id", order_key(["event_id"]).alias("position"))


@query
def iid_partitions(spark, sf):
    rows = splits.assign_partitions(t.orders(spark, sf), t.ORDERS, 7)
    return rows.select("client", "o_orderkey", "partition_id")


@query
def iid_partitions_per_client(spark, sf):
    rows = splits.assign_partitions(t.events(spark, sf), t.EVENTS, {"0": 3, "1": 30, "5": 7})
    return rows.select("client", "event_id", "partition_id")


@query
def own_partitions(spark, sf):
    skewed = F.when(F.col("label"), F.col("o_orderkey") % 2).otherwise(2)
    rows = splits.assign_partitions(t.orders(spark, sf), t.ORDERS, by=skewed)
    return rows.select("client", "o_orderkey", "partition_id")


@query
def folds(spark, sf):
    return splits.split_folds(t.orders(spark, sf), t.ORDERS).select("client", "o_orderkey", "fold")


@query
def folds_then_partitions(spark, sf):
    rows = splits.split_folds(t.events(spark, sf), t.EVENTS, (0.6, 0.2, 0.2))
    rows = splits.assign_partitions(rows, t.EVENTS, 4, within=["fold"])
    return rows.select("client", "event_id", "fold", "partition_id")


@query
def partitions_in_row_order(spark, sf):
    """Folds and partitions of rows that are not shuffled: they follow the order of the file."""
    rows = with_row_order(spark.read.parquet(f"{sf}/events.parquet")).select(
        (F.col("user_id") % 10).alias("client"), "event_id", "event_type", (F.col("value") > 10).alias("label"), *ROW_ORDER)
    options = DatasetOptions(TaskSpec("events", ("event_type",), "label"), t.EVENTS, partitions=4, setting="cross-silo", shuffle=False)
    return ClientDataset(rows, options).table.select("client", "event_id", "fold", "partition_id")


@query
def client_folds(spark, sf):
    return splits.split_clients(t.orders(spark, sf), t.ORDERS).select("client", "o_orderkey", "fold")


@query
def holdout(spark, sf):
    return splits.holdout(t.orders(spark, sf), t.ORDERS).select("client", "o_orderkey", "is_test")


@query
def stratified_holdout(spark, sf):
    rows = splits.holdout(t.items(spark, sf), t.ITEMS, strata=["l_returnflag", "l_linestatus"])
    return rows.select("client", *t.ITEMS.key, "is_test")


@query
def chunks(spark, sf):
    return splits.chunk(t.orders(spark, sf), t.ORDERS, 6, ["o_orderkey"]).select("client", "o_orderkey", "chunk")


@query
def chunks_with_nulls(spark, sf):
    """Rows without an order value stand before all others."""
    rows = t.orders(spark, sf).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    return splits.chunk(rows, t.ORDERS, 6, ["o_totalprice", "o_orderkey"]).select("client", "o_orderkey", "chunk")


@query
def chunk_names(spark, sf):
    rows = splits.chunk(t.events(spark, sf), t.EVENTS, 3, ["ts", "event_id"])
    return splits.with_client_name(rows, "client", "chunk").groupBy("client_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query
def one_partition(spark, sf):
    rows = splits.assign_partitions(t.events(spark, sf), t.EVENTS, 5)
    return splits.partition(rows, t.EVENTS, 3, 1).select("client", "event_id", "partition_id")


@query
def client_index(spark, sf):
    named = splits.with_client_name(t.orders(spark, sf), "c_mktsegment", "client")
    return splits.client_index(named, "client_name")


@query
def prepared_dataset(spark, sf):
    """The whole preparation: remap, modify, split, partition."""
    spec = FairSpec(("c_mktsegment", "o_orderpriority"), "label", ("client",), ("o_orderkey",))
    options = DatasetOptions(
        TaskSpec("orders", ("c_mktsegment", "o_orderpriority", "o_totalprice"), "label"), spec, partitions=3,
        mapping={"o_orderpriority": {"5-LOW": "4-NOT SPECIFIED"}},
        modifications=[Modification(str(c), 0, "o_orderpriority", "4-NOT SPECIFIED", 0.25, 0.5) for c in (1, 2, 3)],
        setting="cross-silo")
    return ClientDataset(t.orders(spark, sf), options).table.select(
        "client", "o_orderkey", "o_orderpriority", "label", "fold", "split", "partition_id")


@query
def preprocessed_dataset(spark, sf):
    """A preparation with a step of one's own between the changes and the split."""
    spec = FairSpec(("c_mktsegment",), "label", ("client",), ("o_orderkey",))
    options = DatasetOptions(
        TaskSpec("orders", ("c_mktsegment", "o_totalprice"), "label"), spec, setting="cross-silo",
        preprocess=lambda df: df.where("o_totalprice > 50000").withColumn("o_totalprice", F.col("o_totalprice") / 2))
    return ClientDataset(t.orders(spark, sf), options).table.select("client", "o_orderkey", "o_totalprice", "fold")


# --- scores -------------------------------------------------------------------------------------------------

@query
def accuracy(spark, sf):
    return scores.accuracy(t.orders(spark, sf), t.ORDERS_SCORED)


@query
def weighted_accuracy(spark, sf):
    each = scores.accuracy(t.orders(spark, sf), t.ORDERS_SCORED)
    return scores.weighted_metric(each).select(F.round("accuracy", 6).alias("accuracy"))


@query
def weighted_vectors(spark, sf):
    """The mean embedding of each label, as the weights of models are averaged."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("n", F.col("vec_id") % 5 + 1)
    means = scores.weighted_vectors(rows, "embedding", "n", ["label"])
    return means.select("label", F.posexplode("embedding").alias("j", "x")).select("label", "j", F.round("x", 6).alias("x"))


@query
def own_metric(spark, sf):
    """The score table with the F1 score as a metric of one's own."""
    y, p = F.col("y"), F.col("p")
    f1 = 2 * F.sum(y * p) / (F.sum(y) + F.sum(p))
    return scores.score_table(t.orders(spark, sf), t.ORDERS_SCORED, "DP", "attribute", metrics={"f1": f1})


@query
def own_metric_gaps(spark, sf):
    """Between which groups the F1 score is furthest apart."""
    f1 = 2 * F.sum(F.col("y") * F.col("p")) / F.nullif(F.sum("y") + F.sum("p"), F.lit(0))
    return scores.own_metric_gaps(t.orders(spark, sf), t.ORDERS_SCORED, "f1", f1)


@query
def log_loss(spark, sf):
    probability = F.col("l_discount") * 5 + 0.2
    found = scores.log_loss(t.items(spark, sf), t.ITEMS, probability)
    return found.select("client", F.round("log_loss", 6).alias("log_loss"))


@query
def score_table_attribute(spark, sf):
    return scores.score_table(t.coded_scored(spark, sf), t.CODED_SCORED, "DP", "attribute")


@query
def score_table_value(spark, sf):
    return scores.score_table(t.coded_scored(spark, sf), t.CODED_SCORED, "EO", "value")


def _scores(spark, sf, metric="DP", level="value"):
    table = scores.score_table(t.coded_scored(spark, sf), t.CODED_SCORED, metric, level)
    return table.withColumnRenamed("client", "dataset")


@query
def model_minimum(spark, sf):
    return scores.model_minimum(_scores(spark, sf), "DP_RACE")


@query
def attribute_vote(spark, sf):
    return scores.attribute_vote(_scores(spark, sf))


@query
def value_vote(spark, sf):
    return scores.value_vote(_scores(spark, sf)).withColumn("vote", F.col("vote").cast("string"))


@query
def next_plan_attribute(spark, sf):
    return scores.plan_next(_scores(spark, sf), 0.3, "attribute")


@query
def next_plan_value(spark, sf):
    return scores.plan_next(_scores(spark, sf), 0.3, "value")


@query
def selected_attribute(spark, sf):
    bounds = {"SEX": (0.01, None), "RAC1P": (0.005, 0.06)}
    return scores.select_clients(_scores(spark, sf), "attribute", bounds=bounds)


@query
def selected_value(spark, sf):
    return scores.select_clients(_scores(spark, sf), "value", bounds={"RAC1P": (0.01, None)})


@query
def distribution_attribute(spark, sf):
    found = scores.unfairness_distribution(_scores(spark, sf), "attribute", threshold=0.01)
    return found.select("attribute", "number", F.concat_ws(",", "states").alias("states"))


@query
def distribution_value(spark, sf):
    found = scores.unfairness_distribution(_scores(spark, sf), "value")
    return found.select("value_int", "number", F.concat_ws(",", "states").alias("states"))


@query
def distribution_long(spark, sf):
    return scores.decided_votes(_scores(spark, sf), "attribute", threshold=0.01)


@query
def unscored_rows(spark, sf):
    rows = t.orders(spark, sf).withColumn("pred", F.when(F.col("o_orderkey") % 7 != 0, F.col("pred")))
    return scores.unscored(rows, t.ORDERS_SCORED)


@query
def before_after(spark, sf):
    """Gaps by client before and after dropping positives of one group."""
    return _compared(spark, sf)


def _compared(spark, sf):
    rows = t.orders(spark, sf)
    spec = FairSpec(("c_mktsegment",), "label", ("client",), ("o_orderkey",))
    changed = perturb.drop_positive(rows, spec, F.col("c_mktsegment") == "BUILDING", 0.5)
    gaps = lambda df: fairness.wide(fairness.fairness(df, spec), spec, "DP", "attribute")
    return scores.compare_clients(gaps(rows), gaps(changed), "client", "c_mktsegment_DP")


@query
def before_after_range(spark, sf):
    return scores.comparison_range(_compared(spark, sf))


@query
def union_tagged(spark, sf):
    first = counts.value_counts(t.orders(spark, sf), t.ORDERS, partition=None).withColumn(
        "client", F.col("client").cast("long"))
    second = counts.value_counts(t.events(spark, sf), t.EVENTS, partition=None, unit="percent")
    both = scores.union_tagged([first, second], ["orders", "events"])
    return both.withColumn("n", F.col("n").cast("double"))


# --- files --------------------------------------------------------------------------------------------------

@query
def saved_clients(spark, sf):
    """Written per split and partition, and read back."""
    rows = splits.assign_partitions(t.orders(spark, sf), t.ORDERS, by=F.col("o_orderkey") % 2)
    path = scratch_path(spark, "clients")
    kept = rows.withColumnRenamed("client", "split").select("split", "partition_id", "o_orderkey", "label")
    save_clients(kept, path, "csv")
    schema = "o_orderkey bigint, label boolean, split int, partition_id int"
    return load_clients(spark, path, "csv", schema)


@query
def saved_scores(spark, sf):
    """The score table written as a report and read back."""
    path = scratch_path(spark, "scores")
    table = _scores(spark, sf).select("model", "accuracy", "value_DP_SEX", "DP_SEX", "value_DP_RACE", "DP_RACE",
                                      "value_DP_MAR", "DP_MAR", F.col("dataset").cast("string").alias("dataset"))
    write_report(table, path)
    return read_scores(spark, path, "DP", "value")


@query
def saved_counts(spark, sf):
    """The count report, one folder per attribute, read back."""
    path = scratch_path(spark, "counts")
    write_report(counts.value_counts(_thirds(spark, sf), t.ORDERS), path, ["attribute"])
    schema = "client int, partition_id int, value string, n bigint, attribute string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query
def saved_client_files(spark, sf):
    """One file name per split and partition, read back beside a report that does not count."""
    path = scratch_path(spark, "files")
    rows = splits.assign_partitions(t.orders(spark, sf), t.ORDERS, by=F.col("o_orderkey") % 2)
    named = rows.withColumn("split", F.lpad(F.col("client").cast("string"), 2, "0"))
    save_client_csvs(named.select("split", "partition_id", "o_orderkey", "label"), path)
    write_report(rows.groupBy("partition_id").count(), f"{path}/report.csv")
    return load_client_csvs(spark, path, T.StructType.fromDDL("o_orderkey bigint, label boolean"))


@query
def clients_of_year(spark, sf):
    """Rows of chosen clients, one year and one horizon; the conditions prune folders."""
    path = scratch_path(spark, "years")
    rows = t.orders(spark, sf).select(F.col("client").cast("string").alias("client"), "o_orderkey",
                                      (2014 + F.col("o_orderkey") % 3).cast("int").alias("year"),
                                      F.when(F.col("o_orderkey") % 2 == 0, "1-Year").otherwise("5-Year").alias("horizon"))
    rows.write.partitionBy("year", "horizon").parquet(path)
    return read_clients(spark, path, ("1", "7", "12"), 2015, "1-Year").select("client", "o_orderkey")


@query
def published_distribution(spark, sf):
    """The distribution table as published, with an unquoted list of clients, written and read back."""
    path = scratch_path(spark, "published")
    votes = scores.decided_votes(_scores(spark, sf), "attribute", threshold=0.01)
    letter = lambda n: F.char(65 + n.cast("int"))
    state = F.concat(F.lit("'"), letter(F.floor(F.col("dataset") / 5)), letter(F.col("dataset") % 5), F.lit("'"))
    lines = votes.groupBy("attribute").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(state)), ", ").alias("s"))
    lines.select(F.concat(F.col("n").cast("string"), F.lit(","), F.col("attribute"), F.lit(",["), F.col("s"), F.lit("]"))).write.text(path)
    return read_distribution(spark, path).select("number", "attribute", F.array_join("states", ",").alias("states"))


@query
def modification_log(spark, sf):
    plan = scores.plan_next(_scores(spark, sf), 0.3, "attribute")
    path = scratch_path(spark, "log")
    write_report(scores.modification_log(plan), path)
    schema = "state string, drop_rate double, attribute string, value int"
    return spark.read.schema(schema).option("header", True).csv(path)


@query
def plan_as_json(spark, sf):
    return plan_json(scores.plan_next(_scores(spark, sf), 0.5, "attribute"))


# --- models ---------------------------------------------------------

@query
def client_models(spark, sf):
    """Weights of one logistic regression per client."""
    weights = models.fit_logistic(t.coded(spark, sf), "label", ["l_discount", "l_tax", "SEX"], precount=True)
    return weights.select("client", *[F.round(F.get("w", F.lit(j)), 4).alias(f"w{j}") for j in range(4)])


@query
def client_predictions(spark, sf):
    """Accuracy and gaps of each client's own model on its held-out rows."""
    return local_audit(t.coded(spark, sf), t.CODED, t.CODED_FEATURES)


@query
def own_model_scores(spark, sf):
    """A model of one's own beside the library's interface: every client's majority label of its training rows."""
    def majority(df, spec, features, train, test, by=None):
        most = df.where(train).groupBy(*spec.client).agg((F.avg(F.col(spec.label).cast("int")) > 0.5).alias("prediction"))
        return df.where(test).join(most, list(spec.client))

    held = stage(splits.holdout(t.orders(spark, sf), t.ORDERS), "held")
    scored = models.score_models(held, t.ORDERS, [], ~F.col("is_test"), F.col("is_test"), {"Majority": majority})
    spec = FairSpec(t.ORDERS.sensitive, "label", ("client", "model"), t.ORDERS.key, "prediction")
    return scores.accuracy(scored, spec)


@query
def partition_sweep(spark, sf):
    """Each partition's own model, fitted on its training rows and judged on its validation rows."""
    # Folds are written out, as partitions first count them and then divide them.
    rows = stage(splits.split_folds(t.coded(spark, sf), t.CODED), "folds")
    parts = splits.assign_partitions(rows, t.CODED, 2, within=("fold",))
    counted, gaps = evaluate_fairness(parts, t.CODED, "DP", "value", model="LogisticRegression")
    return gaps


@query
def model_grid(spark, sf):
    held = stage(splits.holdout(t.coded(spark, sf), t.CODED), "held")
    return models.evaluate_models(held, t.CODED, t.CODED_FEATURES, ~F.col("is_test"), F.col("is_test"),
                                  level="value", options={"LogisticRegression": {"precount": True}})


@query
def calibrated_clients(spark, sf):
    """All rounds of calibration with both models on few codes."""
    options = {"LogisticRegression": {"precount": True}}
    return calibration.calibrate(t.coded(spark, sf), t.CODED, ["l_discount", "l_tax"], options=options).log


def _rule(condition):
    return lambda df, spec, features, train, test, by=None: df.where(test).withColumn("prediction", condition)


def _rules():
    """Two fixed rules that stand in for trained models."""
    return {"LogisticRegression": _rule(F.col("l_discount") >= 0.05), "XGBoost": _rule(F.col("l_tax") >= 0.04)}


@query
def calibrated_rows(spark, sf):
    """What all rounds leave of every client."""
    rows = calibration.calibrate(t.coded(spark, sf), t.CODED, ["l_discount", "l_tax"], models=_rules()).rows
    return rows.groupBy("client").agg(F.count("*").alias("n"), F.count_if("label").alias("positives"))


@query
def cross_device_rules(spark, sf):
    """Chunks of clients on whose last code both rules agree."""
    pieces = t.coded(spark, sf).withColumn("client", F.col("client").cast("string"))
    return calibration.cross_device(pieces, t.CODED, 2, t.CODED.key, ["l_discount", "l_tax"], level="value", models=_rules(),
                                    bounds={"RAC1P": (0.01, None)})[1]


@query
def cross_device_scores(spark, sf):
    rows, found = calibration.cross_device(
        t.coded(spark, sf).withColumn("client", F.col("client").cast("string")), t.CODED, 2,
        ["l_orderkey", *t.CODED.key[1:]], ["l_discount", "l_tax"], level="value",
        options={"LogisticRegression": {"precount": True}})
    return found
