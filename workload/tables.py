"""The given tables as client tables: who the client is, which columns are groups, what the label is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.spec import FairSpec


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ORDERS = FairSpec(("c_mktsegment", "o_orderpriority"), "label", ("client",), ("o_orderkey",))
ORDERS_SCORED = FairSpec(("c_mktsegment", "o_orderpriority"), "label", ("client",), ("o_orderkey",), "pred")
ITEMS = FairSpec(("l_returnflag", "l_linestatus"), "label", ("client",),
                 ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
ITEMS_SCORED = FairSpec(ITEMS.sensitive, "label", ("client",), ITEMS.key, "pred")
DOCS = FairSpec(("lang",), "label", ("client",), ("doc_id",), "pred")
EVENTS = FairSpec(("event_type",), "label", ("client",), ("event_id",))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Clients are the customers' nations; the label is a finished order."""
    customer = _table(spark, sf, "customer")
    return _table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("client"), "o_orderkey", "c_mktsegment", "o_orderpriority",
        (F.col("o_orderstatus") == "F").alias("label"), (F.col("o_totalprice") > 250000).alias("pred"),
        "o_totalprice", "c_acctbal")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Clients are the suppliers' nations; the label is a large quantity."""
    supplier = _table(spark, sf, "supplier")
    return _table(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("client"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("label"),
        (F.col("l_discount") >= 0.05).alias("pred"), "l_quantity", "l_discount", "l_tax")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Clients are the sources; the label is good quality."""
    documents = _table(spark, sf, "documents").select("doc_id", "lang", "source")
    return _table(spark, sf, "labels").join(documents, "doc_id").select(
        F.col("source").alias("client"), "doc_id", "lang", (F.col("quality") == 1).alias("label"),
        (F.col("toxic") == 0).alias("pred"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Clients are users modulo 10; the label is a value above 10."""
    return _table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("client"), "event_id", "event_type", (F.col("value") > 10).alias("label"),
        "value", "ts")


CODED = FairSpec(("SEX", "RAC1P", "MAR"), "label", ("client",), ITEMS.key)
CODED_FEATURES = ("l_extendedprice", "l_discount", "l_tax")


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """The line items with their flags as numeric codes under the names the votes and plans speak of."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return items(spark, sf).select(
        "client", *ITEMS.key, F.when(status == "F", 2.0).otherwise(1.0).alias("SEX"),
        F.when(flag == "A", 1.0).when(flag == "N", 2.0).otherwise(3.0).alias("RAC1P"),
        ((F.col("l_linenumber") % 3) + 1).cast("double").alias("MAR"), "label", "l_discount", "l_tax")


def coded_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The coded line items once per stand-in model, with its prediction."""
    rows = coded(spark, sf)
    first = rows.withColumns({"model": F.lit("LogisticRegression"), "pred": F.col("l_discount") >= 0.05})
    second = rows.withColumns({"model": F.lit("XGBoost"), "pred": F.col("l_tax") >= 0.04})
    return first.unionByName(second)


CODED_SCORED = FairSpec(CODED.sensitive, "label", ("client", "model"), CODED.key, "pred")
