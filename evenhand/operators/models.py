"""Training on every client at once.

A logistic regression per client is fitted by Newton steps. Clients whose rows fit in one task are fitted there, side by side in
one job. For larger ones, one pass over the rows gives, for all clients together, the sums each client's step needs, and only
those sums are shuffled: each task adds up blocks of outer products, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.operators.fairness import cells
from evenhand.operators.scores import score_table
from evenhand.operators.transform import feature_view
from evenhand.operators.trees import LOCAL_VALUES, by_size, fit_locally, fit_predict_trees
from evenhand.plans.runtime import attach, count_cells, gather, join_alike, settle, stage
from evenhand.spec import FairSpec, require_choice


def features_of(df: DataFrame, spec: FairSpec, extra: Sequence[str] = ()) -> list[str]:
    """The columns a model trains on: all but label, sensitive, client and key columns and ``extra``."""
    hidden = {*spec.client, *spec.key, *extra}
    return [c for c in feature_view(df, spec).columns if c not in hidden]


def _dot(weights: str, xs: Sequence[Column]) -> Column:
    total = F.get(weights, F.lit(len(xs)))
    for j, x in enumerate(xs):
        total = total + F.get(weights, F.lit(j)) * x
    return total


# Rows whose outer products are added up at a time.
BLOCK = 8192


def _sums(x: np.ndarray, y: np.ndarray, m: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, curvature and loss at weights w; x has a last column of ones."""
    z = x @ w
    p = 1 / (1 + np.exp(-z))
    loss = np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z)))
    return x.T @ (m * (p - y)), (x * (m * p * (1 - p))[:, None]).T @ x, float(m @ loss)


def _newton(w: np.ndarray, w_last: np.ndarray, loss_last: float, gradient: np.ndarray, hessian: np.ndarray, loss: float,
            l2: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The next weights, those before, their loss and the move; a worse loss halves the last step instead."""
    penalty = np.array([l2] * (len(w) - 1) + [0.0])
    loss += 0.5 * float(penalty @ (w * w))
    if loss > loss_last * (1 + 1e-12) + 1e-9:
        new, old, kept = (w + w_last) / 2, w_last, loss_last
    else:
        step = np.linalg.lstsq(hessian + np.diag(penalty + 1e-12), gradient + penalty * w, rcond=None)[0]
        new, old, kept = w - step, w, loss
    return new, old, kept, float(np.max(np.abs(new - old) / (1e-3 + np.abs(new))))


def _fit_client(table: pa.Table, by: Sequence[str], d: int, l2: float, max_iter: int, tolerance: float) -> pa.Table:
    """One client's weights from all its rows, and how far the last step moved them."""
    x = np.stack([*[table.column(f"x{j}").to_numpy() for j in range(d)], np.ones(table.num_rows)], axis=1)
    y, m = table.column("y").to_numpy(), table.column("m").to_numpy()
    w = last = np.zeros(d + 1)
    loss, move = float("inf"), float("inf")
    for _ in range(max_iter):
        parts = [_sums(x[at:at + BLOCK], y[at:at + BLOCK], m[at:at + BLOCK], w) for at in range(0, len(y), BLOCK)]
        w, last, loss, move = _newton(w, last, loss, *[sum(c) for c in zip(*parts)], l2)
        if move < tolerance:
            break
    keys = [table.column(c).slice(0, 1) for c in by]
    return pa.table([*keys, pa.array([w.tolist()]), pa.array([move])], names=[*by, "w", "move"])


def _add_up(batches: Iterator[pa.RecordBatch], by: Sequence[str], d: int) -> Iterator[pa.RecordBatch]:
    """A task's sums for each client: rows of (by..., j, value), the gradient, the curvature and the loss one after the other."""
    totals: dict[tuple, list] = {}
    kinds = None
    for batch in batches:
        kinds = [batch.schema.field(c).type for c in by]
        names = list(zip(*[batch.column(c).to_pylist() for c in by])) or []
        groups: dict[tuple, list[int]] = {}
        for i, name in enumerate(names):
            groups.setdefault(name, []).append(i)
        x = np.stack([*[batch.column(f"x{j}").to_numpy() for j in range(d)], np.ones(batch.num_rows)], axis=1)
        y, m, w = batch.column("y").to_numpy(), batch.column("m").to_numpy(), batch.column("w")
        for name, rows in groups.items():
            weights = np.array(w[rows[0]].as_py())
            for at in range(0, len(rows), BLOCK):
                i = rows[at:at + BLOCK]
                made = _sums(x[i], y[i], m[i], weights)
                totals[name] = [a + b for a, b in zip(totals[name], made)] if name in totals else list(made)
    for name, (g, h, loss) in totals.items():
        values = np.concatenate([g, h.ravel(), [loss]])
        keys = [pa.array([v] * len(values), k) for v, k in zip(name, kinds)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(values))), pa.array(values)], names=[*by, "j", "value"])


def _steps(by: Sequence[str], d: int, l2: float):
    """One step for each client row of a batch, from its sums."""
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                sums = np.array(row.sums)
                hessian = sums[d + 1:-1].reshape(d + 1, d + 1)
                made.append(_newton(np.array(row.w), np.array(row.w_last), row.loss_last, sums[:d + 1], hessian, sums[-1], l2))
            out = batch[list(by)].copy()
            out["w"], out["w_last"] = [m[0].tolist() for m in made], [m[1].tolist() for m in made]
            out["loss_last"], out["move"] = [m[2] for m in made], [m[3] for m in made]
            yield out

    return step


def _fit_large(rows: DataFrame, by: Sequence[str], d: int, l2: float, max_iter: int, tolerance: float) -> DataFrame:
    """(by..., ``w``, ``move``) of clients whose rows stay where they are; clients that have converged leave the scan."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    zero = F.array(*[F.lit(0.0)] * (d + 1))
    state = settle(rows.select(*by).distinct().select(*by, zero.alias("w"), zero.alias("w_last"), F.lit(float("inf")).alias("loss_last"),
                                                      F.lit(float("inf")).alias("move")))
    for _ in range(max_iter):
        moving = state.where(F.col("move") >= tolerance)
        n = moving.count()
        if not n:
            break
        at = attach(rows, moving.select(*by, "w"), by, n * (d + 1), [f"x{j}" for j in range(d)], "inner")
        sums = at.mapInArrow(lambda it: _add_up(it, by, d), f"{keys}, j bigint, value double").groupBy(*by, "j").agg(F.sum("value").alias("value"))
        # A client's sums are as many as the square of its features, whatever its rows.
        lists = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: s["value"])
        known = join_alike(sums.groupBy(*by).agg(lists.alias("sums")), moving.drop("move"), list(by))
        made = known.mapInPandas(_steps(by, d, l2), f"{keys}, w array<double>, w_last array<double>, loss_last double, move double")
        state = settle(state.where(F.col("move") < tolerance).unionByName(made))
    return state.select(*by, "w", "move")


def fit_logistic(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    by: Sequence[str] = ("client",),
    l2: float = 1.0,
    max_iter: int = 100,
    tolerance: float = 1e-6,
    precount: bool = False,
    staged: bool = True,
    local: int = LOCAL_VALUES,
    weight: str | None = None,
) -> DataFrame:
    """(by..., ``w``): weights per client, the bias last, minimising log loss plus ``l2 / 2`` times |w|^2.

    The features and labels are written out once, so that the steps do not repeat what led to them; pass
    ``staged=False`` when ``df`` is a stored table already. ``precount`` counts equal rows before, which pays
    when features are codes with few combinations. Rows without a label or without one of the features take no
    part, and ``weight`` names how many rows one stands for. Clients that have not converged after ``max_iter`` steps are an error. Clients of more than ``local`` values are
    fitted by sums over tasks.
    """
    d, by = len(features), list(by)
    rows = df.select(*by, F.col(label).cast("boolean").cast("double").alias("y"),
                     *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)],
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("m"))
    rows = rows.dropna(subset=["y", *[f"x{j}" for j in range(d)]])
    if precount:
        rows = rows.groupBy(*[c for c in rows.columns if c != "m"]).agg(F.sum("m").alias("m"))
    if staged or precount:
        rows = stage(rows, "features")
    small, large = by_size(rows, by, d + 2, local)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", w array<double>, move double"
    fitted = settle(fit_locally(small, by, lambda t: _fit_client(t, by, d, l2, max_iter, tolerance), schema))
    if large is not None:
        fitted = fitted.unionByName(_fit_large(large, by, d, l2, max_iter, tolerance))
    far = fitted.agg(F.max("move")).first()[0]
    if far is not None and far >= tolerance:
        raise ArithmeticError(f"a client's weights still move by {far:.2g} after {max_iter} steps")
    return fitted.select(*by, "w")


def predict_logistic(
    df: DataFrame, weights: DataFrame, features: Sequence[str], by: Sequence[str] = ("client",),
    prediction: str = "prediction", probability: str | None = None,
) -> DataFrame:
    """Add the predicted label, and its probability if a name for it is given, to every row."""
    scored = attach(df, weights, by, count_cells(weights, F.size("w")))
    score = _dot("w", [F.col(c).cast("double") for c in features])
    made = {prediction: score > 0}
    if probability:
        made[probability] = 1 / (1 + F.exp(-score))
    return scored.withColumns(made).drop("w")


def fit_predict_logistic(
    df: DataFrame, spec: FairSpec, features: Sequence[str], train: Column, test: Column,
    by: Sequence[str] | None = None, **options,
) -> DataFrame:
    """Fit per client on the training rows and return the test rows with ``prediction``."""
    by = list(by or spec.client)
    weights = fit_logistic(df.where(train), spec.label, features, by, **{"weight": spec.weight, **options})
    return predict_logistic(df.where(test), weights, features, by)


FITS = {"LogisticRegression": fit_predict_logistic, "XGBoost": fit_predict_trees}
# Anything with the signature of ``fit_predict_logistic`` can stand in for a named model.
Model = Callable[..., DataFrame]


def fits_of(models: Sequence[str] | Mapping[str, Model]) -> dict[str, Model]:
    """The models by name: those of this library, or one's own."""
    if isinstance(models, Mapping):
        return dict(models)
    for name in models:
        require_choice("model", name, tuple(FITS))
    return {name: FITS[name] for name in models}


def pipeline_model(estimator, features_column: str = "features") -> Model:
    """A ``pyspark.ml`` estimator fitted on the training rows of all clients together, as a model."""
    def fit_predict(df: DataFrame, spec: FairSpec, features: Sequence[str], train: Column, test: Column,
                    by: Sequence[str] | None = None) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in features]))
        coded = df.withColumns({features_column: vector, "__label": F.col(spec.label).cast("boolean").cast("double")})
        fitted = estimator.copy({estimator.labelCol: "__label", estimator.featuresCol: features_column}).fit(coded.where(train))
        made = fitted.transform(coded.where(test))
        return made.select(*df.columns, (F.col("prediction") > 0).alias("prediction"))

    return fit_predict


def score_models(
    df: DataFrame, spec: FairSpec, features: Sequence[str], train: Column, test: Column,
    models: Sequence[str] | Mapping[str, Model] = tuple(FITS), options: Mapping[str, Mapping] = {},
) -> DataFrame:
    """The test rows once per model, with ``model`` and ``prediction``."""
    scored = None
    for name, fit_predict in fits_of(models).items():
        one = fit_predict(df, spec, features, train, test, **options.get(name, {})).withColumn("model", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    return scored


def evaluate_models(
    df: DataFrame, spec: FairSpec, features: Sequence[str], train: Column, test: Column,
    metric: str = "DP", level: str = "attribute", models: Sequence[str] | Mapping[str, Model] = tuple(FITS),
    options: Mapping[str, Mapping] = {},
) -> DataFrame:
    """The score table of all models on all clients: ``model``, ``accuracy``, gaps, and ``dataset``, the client."""
    scored = score_models(df, spec, features, train, test, models, options)
    audited = FairSpec(spec.sensitive, spec.label, (*spec.client, "model"), spec.key, "prediction", spec.weight)
    # Rates and accuracies both follow from the same counts, so these are made once.
    counted = settle(cells(scored, audited))
    table = score_table(gather(counted, len(counted.columns)), audited, metric, level)
    gaps = [c for c in table.columns if c not in (*spec.client, "model", "accuracy")]
    dataset = F.concat_ws("_", *[F.col(c).cast("string") for c in spec.client])
    return table.select("model", "accuracy", *gaps, dataset.alias("dataset"))
