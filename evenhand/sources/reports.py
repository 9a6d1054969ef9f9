"""Result tables and configuration as files."""

from __future__ import annotations

import dataclasses
import datetime
import json
from collections.abc import Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a result table as CSV with a header, in one folder per value of ``by`` (such as the attribute)."""
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_scores(spark: SparkSession, path: str, metric: str = "DP", level: str = "attribute") -> DataFrame:
    """Read a model score table back with its types."""
    fields = [("model", T.StringType()), ("accuracy", T.DoubleType())]
    for name in ("SEX", "RACE", "MAR"):
        if level == "value":
            fields.append((f"value_{metric}_{name}", T.StringType()))
        fields.append((f"{metric}_{name}", T.DoubleType()))
    fields.append(("dataset", T.StringType()))
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def read_distribution(spark: SparkSession, path: str, level: str = "attribute") -> DataFrame:
    """Read a published distribution table whose list of clients may stand unquoted between commas.

    Attribute tables are ``number,attribute,states``; value tables have ``value,value_int`` before the list.
    Returns one row per line with ``states`` as an array.
    """
    line = spark.read.text(path).where(~F.col("value").startswith("number"))
    field = F.split("value", ",")
    columns = [field[0].cast("int").alias("number"), field[1].alias("attribute")]
    if level == "value":
        columns += [field[2].alias("value"), field[3].cast("int").alias("value_int")]
    states = F.regexp_extract_all("value", F.lit(r"'([A-Z]{2}(?:_\d+)?)'"), F.lit(1)).alias("states")
    return line.select(*columns, states)


def config_json(config: object, **options) -> str:
    """Nested specs as JSON: dataclasses and objects by their attributes, dates in ISO form, anything else as text."""

    def plain(value: object) -> object:
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            return {f.name: getattr(value, f.name) for f in dataclasses.fields(value)}
        if isinstance(value, (datetime.date, datetime.time)):
            return value.isoformat()
        if isinstance(value, PurePath) or callable(value) or not hasattr(value, "__dict__"):
            return str(value)
        return vars(value)

    return json.dumps(config, default=plain, **options)


def plan_json(plan: DataFrame) -> DataFrame:
    """A config table as one JSON object per row."""
    return plan.select(F.to_json(F.struct(*plan.columns)).alias("json"))
