"""Plain descriptions of tasks, audits and perturbation plans, with their checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("DP", "EO")
LEVELS = ("attribute", "value", "attribute-value")
SETTINGS = ("cross-silo", "cross-device")

# The clients used when none are named, in survey order.
DEFAULT_CLIENTS = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "PR",
)

DEFAULT_SENSITIVE = ("SEX", "MAR", "RAC1P")

def require_choice(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {name} {value!r}; expected one of {', '.join(allowed)}")


def require_rate(rate: float) -> None:
    if not 0 <= rate <= 1:
        raise ValueError(f"a rate must lie between 0 and 1, not {rate}")


def require_fractions(fractions: Sequence[float], names: Sequence[str]) -> None:
    if len(fractions) != len(names):
        raise ValueError(f"{len(names)} fractions are needed ({', '.join(names)}), not {len(fractions)}")
    for fraction in fractions:
        require_rate(fraction)
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError(f"fractions must add up to 1, not {sum(fractions)}")


def require_pieces(k: int) -> None:
    if k < 1:
        raise ValueError(f"a client is cut into at least one piece, not {k}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not present: {', '.join(missing)}")


@dataclass(frozen=True)
class TaskSpec:
    """Which columns a task keeps, and how its boolean label is made."""

    name: str
    features: tuple[str, ...]
    label: str
    label_expr: Column | None = None
    row_filter: Column | None = None
    fill: float | None = None


# The two supported tasks and the columns of the income one.
INCOME_FEATURES = ("AGEP", "COW", "SCHL", "MAR", "OCCP", "POBP", "RELP", "WKHP", "SEX", "RAC1P")
TASK_LABELS = {"income": "PINCP", "employment": "ESR"}


def task(name: str, features: Sequence[str] = (), **options) -> TaskSpec:
    """The named task; the label column holds the survey's own boolean unless ``label_expr`` is given."""
    if name not in TASK_LABELS:
        raise ValueError(f"unknown task {name!r}; expected income or employment")
    return TaskSpec(name, tuple(features or INCOME_FEATURES), TASK_LABELS[name], **options)


@dataclass(frozen=True)
class FairSpec:
    """What an audit needs to know about a table.

    ``client`` may name several columns, for instance client, partition and model; every combination is
    audited on its own. Without ``prediction`` the label itself is audited. With ``weight``, a column of whole numbers, a row
    stands for so many where models are fitted and scored.
    """

    sensitive: tuple[str, ...]
    label: str
    client: tuple[str, ...] = ("client",)
    key: tuple[str, ...] = ("row_id",)
    prediction: str | None = None
    weight: str | None = None

    def check(self, df: DataFrame) -> None:
        if self.label not in df.columns:
            raise ValueError(f"the label {self.label!r} is not present in the dataset")
        predicted = (self.prediction,) if self.prediction else ()
        require_columns(df, (*self.client, *self.sensitive, *predicted))


@dataclass(frozen=True)
class Modification:
    """One step of a perturbation plan: drop, then flip, positives of a group of one client."""

    client: str
    seq: int
    column: str
    value: object
    drop_rate: float = 0.0
    flip_rate: float = 0.0
    column2: str | None = None
    value2: object = None

    def __post_init__(self):
        require_rate(self.drop_rate)
        require_rate(self.flip_rate)

    def row(self) -> tuple:
        text = lambda v: None if v is None else str(v)
        return (str(self.client), self.seq, self.column, text(self.value), float(self.drop_rate),
                float(self.flip_rate), self.column2, text(self.value2))


def modifications_from_dict(plan: Mapping[str, Mapping[str, Mapping[str, object]]]) -> list[Modification]:
    """Read ``{client: {column: {drop_rate, flip_rate, value, attribute, attribute_value}}}`` in order."""
    return [
        Modification(client, seq, column, m["value"], m["drop_rate"], m["flip_rate"],
                     m.get("attribute"), m.get("attribute_value"))
        for client, steps in plan.items()
        for seq, (column, m) in enumerate(steps.items())
    ]


def plan_table(spark: SparkSession, plan: Iterable[Modification]) -> DataFrame:
    """The plan as a table with one column per field of a modification."""
    rows = list(zip(*[m.row() for m in plan])) or [()] * 8
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string())
    names = ("client", "seq", "column", "value", "drop_rate", "flip_rate", "column2", "value2")
    return spark.createDataFrame(pa.table({n: pa.array(v, t) for n, v, t in zip(names, rows, types)}))


@dataclass(frozen=True)
class PlanExtent:
    """What must be known of a plan before it is applied: a few numbers and names, never its rows."""

    rows: int
    steps: tuple[int, ...]
    columns: tuple[str, ...]


def plan_extent(plan: Iterable[Modification] | DataFrame) -> PlanExtent:
    """Size, steps and named columns of a plan; its rates are checked."""
    if not isinstance(plan, DataFrame):
        plan = list(plan)
        columns = {c for m in plan for c in (m.column, m.column2) if c is not None}
        if len({(str(m.client), m.seq) for m in plan}) < len(plan):
            raise ValueError("a client has two entries for one step")
        return PlanExtent(len(plan), tuple(sorted({m.seq for m in plan})), tuple(sorted(columns)))
    found = plan.agg(
        F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("seq")).alias("steps"),
        F.sort_array(F.array_union(F.collect_set("column"), F.collect_set("column2"))).alias("columns"),
        F.min(F.least("drop_rate", "flip_rate")).alias("low"),
        F.max(F.greatest("drop_rate", "flip_rate")).alias("high"),
    ).first()
    if not plan.groupBy("client", "seq").count().where("count > 1").isEmpty():
        raise ValueError("a client has two entries for one step")
    for rate in (found["low"], found["high"]):
        if rate is not None:
            require_rate(rate)
    return PlanExtent(found["rows"], tuple(found["steps"]), tuple(found["columns"]))
