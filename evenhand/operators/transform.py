"""Row-wise projections, and scaling and encoding fitted on pooled clients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions import remap_column
from evenhand.operators.splits import client_index
from evenhand.plans.runtime import attach, count_cells, settle
from evenhand.spec import FairSpec, TaskSpec, require_columns


def apply_task(df: DataFrame, task: TaskSpec, keep: Sequence[str] = ("client", "row_id")) -> DataFrame:
    """Keep the task's features and its boolean label, beside the columns naming and keying a row."""
    if task.row_filter is not None:
        df = df.where(task.row_filter)
    require_columns(df, [*keep, *task.features])
    label = task.label_expr if task.label_expr is not None else F.col(task.label)
    features = [
        F.col(c) if task.fill is None else F.coalesce(F.col(c), F.lit(task.fill)).alias(c) for c in task.features
    ]
    return df.select(*keep, *features, label.cast("boolean").alias(task.label))


def remap(df: DataFrame, mapping: Mapping[str, Mapping]) -> DataFrame:
    """Replace category codes, all codes of a column at once; columns keep their type."""
    require_columns(df, mapping)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: remap_column(F.col(c), codes, types[c]) for c, codes in mapping.items() if codes})


def binarize(df: DataFrame, columns: Sequence[str], keep=1) -> DataFrame:
    """1 where a column equals ``keep``, else 0 (also where it is null)."""
    return df.withColumns({c: F.coalesce(F.col(c) == F.lit(keep), F.lit(False)).cast("int") for c in columns})


def label_to_int(df: DataFrame, label: str, out: str | None = None) -> DataFrame:
    """The boolean label as 0/1, under a new name if one is given."""
    made = df.withColumn(label, F.coalesce(F.col(label).cast("boolean"), F.lit(False)).cast("int"))
    return made.withColumnRenamed(label, out) if out else made


def feature_view(df: DataFrame, spec: FairSpec, drop_sensitive: bool = True) -> DataFrame:
    """What a model may see: without label and prediction and, by default, sensitive columns."""
    hidden = [spec.label, spec.prediction] + (list(spec.sensitive) if drop_sensitive else [])
    return df.drop(*[c for c in hidden if c])


def minmax(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), fit: Column | None = None) -> DataFrame:
    """Scale columns to [0, 1] over all clients, or per ``by``; a constant column becomes null.

    ``fit`` restricts the rows the bounds are taken from, for instance to the training fold.
    """
    source = df if fit is None else df.where(fit)
    bounds = [f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]

    def scaled(c: str, lo: Column, hi: Column) -> Column:
        return ((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0))).alias(c)

    if by:
        table = settle(source.groupBy(*by).agg(*bounds))
        joined = attach(df, table, by, count_cells(table, len(table.columns)))
        pick = lambda name: F.col(name)
    else:
        table = source.agg(F.struct(*bounds).alias("bounds"))
        joined, once = df, table.scalar()
        pick = lambda name: once[name]
    made = {c: scaled(c, pick(f"__lo_{c}"), pick(f"__hi_{c}")) for c in columns}
    return joined.withColumns(made).select(*df.columns)


def categories(df: DataFrame, columns: Sequence[str], most: int = 10_000) -> dict[str, list]:
    """The sorted categories of each column, read in one job; an error above ``most``, never a cut list."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ]))).where("value is not null").distinct()
    rows = pairs.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} categories; these columns are not categorical")
    return {c: [r["value"] for r in rows if r["name"] == c] for c in columns}


def one_hot(df: DataFrame, columns: Sequence[str], fit: Column | None = None, most: int = 10_000) -> DataFrame:
    """Replace each column by one 0/1 column per category found in the pooled data, ``{column}_{category}``.

    A table this wide is only of use up to ``most`` categories; ``one_hot_index`` has no such bound.
    """
    found = categories(df if fit is None else df.where(fit), columns, most)
    made = {}
    for c in columns:
        numeric = df.schema[c].dataType.typeName() not in ("string", "boolean")
        for value in sorted(found[c], key=float if numeric else str):
            made[f"{c}_{value}"] = F.coalesce(F.col(c).cast("string") == F.lit(value), F.lit(False)).cast("int")
    return df.withColumns(made).drop(*columns)


def one_hot_index(df: DataFrame, columns: Sequence[str], out: str = "hot", fit: Column | None = None) -> DataFrame:
    """Add ``out``: for each column the place of its value among the sorted categories, null where it is none.

    This is the sparse form of ``one_hot``. Categories are numbered in a table of their own, of any size, which is
    joined by value.
    """
    source = df if fit is None else df.where(fit)
    made = df
    for j, c in enumerate(columns):
        numbered = client_index(source.select(c).where(F.col(c).isNotNull()), c)
        table = settle(numbered.select(c, F.col("client_index").alias(f"__hot{j}")))
        made = attach(made, table, [c], count_cells(table, 2), df.columns)
    return made.withColumn(out, F.array(*[f"__hot{j}" for j in range(len(columns))])).select(*df.columns, out)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """One array of floats per row, with a trailing 1.0 for the bias."""
    return df.withColumn(out, F.array(*[F.col(c).cast("float") for c in columns], F.lit(1.0).cast("float")))
