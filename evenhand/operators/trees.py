"""Boosted trees for every client at once.

Equal rows of a client are counted first. A client whose counted rows fit in one task is grown there whole, all clients side by
side in one job. Larger ones are cut into bins where they are, and those whose rows alike in all bins fit in one task are grown
there too. For the rest a level of a tree is one aggregation for all of them together: gradient sums per (client, node, feature,
bin), from which windows over the bins find each node's best split; their rows are never gathered. All ways cut features at the
same quantiles of the client and choose the same splits. Rows to predict are dealt by client and hash, and meet their client's
trees in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.plans.runtime import attach, count_cells, drop_staged, join_alike, settle, stage
from evenhand.spec import FairSpec

# Rounds, depth and bins of the usual booster.
ROUNDS, DEPTH, BINS = 100, 6, 256
# Splits must improve the loss by more than rounding does.
LEAST_GAIN = 1e-9
# Counted rows of a client, times their values, up to which it is fitted in one task.
LOCAL_VALUES = 4_000_000
# Rows of a client that are predicted in one task, about, and at a time in it.
SHARE, BLOCK = 100_000, 4096


@dataclass(frozen=True)
class Forest:
    """The trees of all clients, one row each, with the log odds they start from and the bin edges of the features.

    A tree is three arrays over its nodes, the children of node i being 2 i and 2 i + 1: feature (-1 at a leaf), bin, and value.
    """

    trees: DataFrame
    features: tuple[str, ...]
    by: tuple[str, ...]
    depth: int


TREE = "struct<feature: array<int>, bin: array<int>, value: array<double>>"


def bin_edges(df: DataFrame, features: Sequence[str], by: Sequence[str], bins: int = BINS) -> DataFrame:
    """(by..., ``edges``): upper edges of all bins but the last, per client and feature, from mergeable quantile sketches."""
    parts = [i / bins for i in range(1, bins)]
    found = [F.percentile_approx(F.col(c).cast("double"), parts, 10_000) for c in features]
    none = F.array().cast("array<double>")
    return df.groupBy(*by).agg(F.array(*[F.array_sort(F.array_distinct(F.coalesce(q, none))) for q in found]).alias("edges"))


def _bin(x: Column, edges: Column, most: int) -> Column:
    """How many edges a value exceeds, by halving; a missing value is in the first bin."""
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(strides, F.lit(0), lambda at, stride: F.when(F.get(edges, at + stride - 1) < x.cast("double"), at + stride).otherwise(at))


# --- clients that fit in one task ---------------------------------------------------------------------------

def _quantiles(x: np.ndarray, m: np.ndarray, bins: int) -> np.ndarray:
    """The values that ``bin_edges`` finds: for each part the first whose running count reaches it."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(m[order])
    if not len(x):
        return x
    wanted = np.arange(1, bins) / bins * upto[-1]
    return np.unique(x[order][np.minimum(np.searchsorted(upto, wanted), len(x) - 1)])


def _grow_one(bins: np.ndarray, g: np.ndarray, h: np.ndarray, widths: list[int], depth: int, rate: float, l2: float,
              least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree on binned rows: feature, bin and value by node, and the node that each row ends in."""
    size, d = 2 ** (depth + 1), bins.shape[1]
    feature, cut, value = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size)
    node = np.ones(len(g), np.int64)
    value[1] = -rate * g.sum() / (h.sum() + l2)
    for level in range(depth):
        here = np.flatnonzero(node >= 2**level)
        nodes, at = np.unique(node[here], return_inverse=True)
        best = np.full(len(nodes), LEAST_GAIN)
        for j in range(d):
            place, width = at * widths[j] + bins[here, j], widths[j]
            gl, hl = (np.bincount(place, w[here], len(nodes) * width).reshape(-1, width).cumsum(axis=1) for w in (g, h))
            ga, ha = gl[:, -1:], hl[:, -1:]
            gr, hr = ga - gl, ha - hl
            gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - ga * ga / (ha + l2)
            gain[(hl < least) | (hr < least)] = -np.inf
            top = gain.argmax(axis=1)
            found = gain[np.arange(len(nodes)), top]
            for i in np.flatnonzero(found > best):
                best[i], k, n = found[i], top[i], nodes[i]
                feature[n], cut[n] = j, k
                value[2 * n], value[2 * n + 1] = -rate * gl[i, k] / (hl[i, k] + l2), -rate * gr[i, k] / (hr[i, k] + l2)
        split = here[feature[node[here]] >= 0]
        if not len(split):
            break
        chosen = node[split]
        node[split] = 2 * chosen + (bins[split, feature[chosen]] > cut[chosen])
    return feature, cut, value, node


def _alike(coded: np.ndarray, y: np.ndarray, m: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows alike in label and bins put together, in the order of these."""
    place = y.astype(np.int64)
    for j, width in enumerate(widths):
        first, place = np.unique(place * width + coded[:, j], return_index=True, return_inverse=True)[1:]
    if not widths:
        first, place = np.unique(place, return_index=True, return_inverse=True)[1:]
    return coded[first], y[first], np.bincount(place, m, len(first))


def _grow_client(table: pa.Table, by: Sequence[str], d: int, rounds: int, depth: int, rate: float, l2: float, least: float,
                 bins: int) -> pa.Table:
    """All trees of one client from its counted rows."""
    y, m = (table.column(c).to_numpy() for c in ("y", "m"))
    coded, edges = np.zeros((len(y), d), np.int64), []
    for j in range(d):
        column = table.column(f"x{j}").combine_chunks()
        known = column.is_valid().to_numpy(zero_copy_only=False)
        x = column.fill_null(0.0).to_numpy()
        cuts = _quantiles(x[known], m[known], bins)
        coded[known, j] = np.searchsorted(cuts, x[known])
        edges.append(cuts.tolist())
    return _forest(table, by, coded, y, m, edges, rounds, depth, rate, l2, least)


def _grow_binned(table: pa.Table, found: pa.Table, by: Sequence[str], d: int, rounds: int, depth: int, rate: float, l2: float,
                 least: float) -> pa.Table:
    """All trees of one client from its binned rows and the edges of its bins."""
    if not table.num_rows:
        return _forest_table(found.slice(0, 0), by, [], [], [])
    y, m = (table.column(c).to_numpy() for c in ("y", "m"))
    coded = table.column("bins").combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.int64)
    return _forest(table, by, coded, y, m, found.column("edges")[0].as_py(), rounds, depth, rate, l2, least)


def _forest(table: pa.Table, by: Sequence[str], coded: np.ndarray, y: np.ndarray, m: np.ndarray, edges: list[list[float]], rounds: int,
            depth: int, rate: float, l2: float, least: float) -> pa.Table:
    widths = [len(e) + 1 for e in edges]
    coded, y, m = _alike(coded, y, m, widths)
    positive = float(y @ m)
    base = float(np.log((positive + 0.5) / (m.sum() - positive + 0.5)))
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        feature, cut, value, node = _grow_one(coded, m * (p - y), m * p * (1 - p), widths, depth, rate, l2, least)
        margin += value[node]
        used = 2 + 2 * int(np.flatnonzero(feature >= 0).max(initial=0))
        trees.append({"feature": feature[:used], "bin": cut[:used], "value": value[:used]})
    return _forest_table(table.slice(0, 1), by, [base], [edges], [trees])


def _forest_table(keys: pa.Table, by: Sequence[str], base: list, edges: list, trees: list) -> pa.Table:
    tree = pa.struct([("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
    made = [pa.array(base, pa.float64()), pa.array(edges, pa.list_(pa.list_(pa.float64()))), pa.array(trees, pa.list_(tree))]
    return pa.table([*[keys.column(c) for c in by], *made], names=[*by, "base", "edges", "trees"])


# --- clients of any size ------------------------------------------------------------------------------------

def _step(node: Column, splits: Column, bins: Column) -> Column:
    """From a node to its child, or to itself where it is not split."""
    split = F.element_at(splits, node)
    beyond = F.get(bins, split["feature"]) > split["bin"]
    return F.when(split.isNull(), node).otherwise(node * 2 + beyond.cast("int"))


def _grow(cells: DataFrame, by: Sequence[str], d: int, depth: int, rate: float, l2: float,
          least: float) -> tuple[DataFrame, int]:
    """One tree per client: (by..., ``splits``, ``leaves``), both maps from node; and its size for ``attach``."""
    gradient = F.col("m") * (F.col("p") - F.col("y"))
    curvature = F.col("m") * F.col("p") * (1 - F.col("p"))
    rows = cells.withColumn("p", 1 / (1 + F.exp(-F.col("margin"))))
    rows = rows.select(*by, "bins", gradient.alias("g"), curvature.alias("h"))
    tree, size = None, 0
    for level in range(depth):
        if tree is None:
            at = rows.withColumn("node", F.lit(1))
        else:
            at = attach(rows, tree, by, size, ["bins"]).withColumn("node", F.lit(1))
            for _ in range(level):
                at = at.withColumn("node", _step(F.col("node"), F.col("splits"), F.col("bins")))
            at = at.where(F.col("node") >= 2**level)
        sums = at.select(*by, "node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy(
            *by, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        one = Window.partitionBy(*by, "node", "feature")
        upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.select(*by, "node", "feature", "bin", F.sum("g").over(upto).alias("gl"),
                           F.sum("h").over(upto).alias("hl"), F.sum("g").over(one).alias("ga"),
                           F.sum("h").over(one).alias("ha"))
        gl, hl, ga, ha = (F.col(c) for c in ("gl", "hl", "ga", "ha"))
        gr, hr = ga - gl, ha - hl
        gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - ga * ga / (ha + l2)
        allowed = (hl >= least) & (hr >= least) & (gain > LEAST_GAIN)
        choice = F.struct(gain.alias("gain"), (-F.col("feature")).alias("nf"), (-F.col("bin")).alias("nb"),
                          (-rate * gl / (hl + l2)).alias("left"), (-rate * gr / (hr + l2)).alias("right"))
        best = sums.groupBy(*by, "node").agg(
            F.max(F.when(allowed, choice)).alias("best"), F.first(-rate * ga / (ha + l2)).alias("whole"))
        split = F.col("best").isNotNull()
        made = best.groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.when(split, F.struct("node", F.struct(
                (-F.col("best.nf")).alias("feature"), (-F.col("best.nb")).alias("bin")))))).alias("splits"),
            F.map_from_entries(F.flatten(F.collect_list(F.when(split, F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("best.left").alias("value")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.col("best.right").alias("value"))
            ))))).alias("leaves"),
            F.max(F.when(F.col("node") == 1, F.col("whole"))).alias("whole"),
        )
        if tree is None:
            root = F.create_map(F.lit(1), F.col("whole"))
            grown = made.select(*by, "splits", F.map_concat(root, "leaves").alias("leaves"))
        else:
            more = made.select(*by, F.col("splits").alias("__splits"), F.col("leaves").alias("__leaves"))
            joined = attach(tree, more, by, size)
            none = F.create_map().cast(dict(tree.dtypes)["splits"]), F.create_map().cast(dict(tree.dtypes)["leaves"])
            grown = joined.select(
                *by, F.map_concat("splits", F.coalesce("__splits", none[0])).alias("splits"),
                F.map_concat("leaves", F.coalesce("__leaves", none[1])).alias("leaves"))
        tree = settle(grown)
        size = count_cells(tree, F.size("leaves") + 2 * F.size("splits") + len(by))
    return tree, size


def _binned(cells: DataFrame, by: Sequence[str], d: int, bins: int) -> tuple[DataFrame, DataFrame]:
    """(by..., y, bins, m), rows alike in label and bins put together, and the edges of the bins."""
    edges = settle(bin_edges(cells.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))),
                             [f"x{j}" for j in range(d)], by, bins))
    size = count_cells(edges, F.aggregate("edges", F.lit(0), lambda n, e: n + F.size(e)))
    rows = attach(cells, edges, by, size, [f"x{j}" for j in range(d)])
    coded = F.array(*[_bin(F.col(f"x{j}"), F.get("edges", F.lit(j)), bins) for j in range(d)])
    return stage(rows.select(*by, "y", "m", coded.alias("bins")).groupBy(*by, "y", "bins").agg(F.sum("m").alias("m")), "binned"), edges


def _grow_large(cells: DataFrame, edges: DataFrame, by: Sequence[str], d: int, rounds: int, depth: int, rate: float, l2: float,
                least: float) -> DataFrame:
    """The forests of clients whose binned rows stay where they are, tree by tree and level by level."""
    positive, every = F.sum(F.col("y") * F.col("m")), F.sum("m")
    base = settle(cells.groupBy(*by).agg(F.log((positive + 0.5) / (every - positive + 0.5)).alias("base")))
    cells = attach(cells, base, by, count_cells(base), ["bins"]).withColumnRenamed("base", "margin")
    grown, before = [], None
    for number in range(rounds):
        cells = stage(cells, "margins")
        if before is not None:
            drop_staged(before)
        before = cells
        tree, size = _grow(cells, by, d, depth, rate, l2, least)
        grown.append(tree.select(*by, F.struct(F.lit(number).alias("number"), "splits", "leaves").alias("tree")))
        cells = attach(cells, tree, by, size, ["bins"]).withColumn("node", F.lit(1))
        for _ in range(depth):
            cells = cells.withColumn("node", _step(F.col("node"), F.col("splits"), F.col("bins")))
        margin = F.col("margin") + F.element_at("leaves", F.col("node"))
        cells = cells.withColumn("margin", margin).drop("node", "splits", "leaves")
    every_tree = grown[0]
    for more in grown[1:]:
        every_tree = every_tree.unionByName(more)
    # Trees hold maps, which do not sort, so they are put in order by their number.
    ordered = F.map_from_entries(F.collect_list(F.struct("tree.number", "tree")))
    nodes = F.sequence(F.lit(0), F.lit(2 ** (depth + 1) - 1))

    def arrays(tree: Column) -> Column:
        split = lambda n, c, none: F.coalesce(F.element_at(tree["splits"], n)[c].cast("int"), F.lit(none))
        return F.struct(F.transform(nodes, lambda n: split(n, "feature", -1)).alias("feature"),
                        F.transform(nodes, lambda n: split(n, "bin", -1)).alias("bin"),
                        F.transform(nodes, lambda n: F.coalesce(F.element_at(tree["leaves"], n), F.lit(0.0))).alias("value"))

    numbers = F.sequence(F.lit(0), F.lit(rounds - 1))
    trees = every_tree.groupBy(*by).agg(ordered.alias("__trees")).select(
        *by, F.transform(numbers, lambda i: arrays(F.element_at("__trees", i))).alias("trees"))
    forest = settle(join_alike(join_alike(base, edges, list(by)), trees, list(by)).select(*by, "base", "edges", F.col("trees").cast(f"array<{TREE}>")))
    drop_staged(before)
    return forest


def by_size(cells: DataFrame, by: Sequence[str], values: int, local: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of clients with up to ``local`` values (rows times ``values``), and those of larger ones if there are any."""
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * values > local).select(*by)
    n = sizes.count()
    if not n:
        return cells, None
    sizes = settle(sizes)
    spread = [c for c in cells.columns if c not in by]
    return (attach(cells, sizes, by, n * len(by), spread, "left_anti"), attach(cells, sizes, by, n * len(by), spread, "left_semi"))


def fit_locally(cells: DataFrame, by: Sequence[str], fit: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One task per client, many clients at a time; the clients must be of bounded size."""
    parts = max(32, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(parts, *by).groupBy(*by).applyInArrow(fit, schema)


def fit_trees(
    df: DataFrame, label: str, features: Sequence[str], by: Sequence[str] = ("client",), rounds: int = ROUNDS,
    depth: int = DEPTH, rate: float = 0.3, l2: float = 1.0, least: float = 1.0, bins: int = BINS, local: int = LOCAL_VALUES,
    weight: str | None = None,
) -> Forest:
    """Boosted trees per client, starting from the log odds of its label.

    Second-order boosting of the log loss: each tree's splits and leaves follow from gradient sums, shrunk by
    ``rate``; ``least`` is the curvature a child must hold; ``weight`` names how many rows one stands for. Clients of more than ``local`` values are grown level by level.
    """
    d, by = len(features), list(by)
    xs = [F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)]
    m = (F.col(weight) if weight else F.lit(1)).cast("double").alias("m")
    rows = df.select(*by, F.col(label).cast("boolean").cast("double").alias("y"), *xs, m).where("y is not null")
    cells = stage(rows.groupBy(*[c for c in rows.columns if c != "m"]).agg(F.sum("m").alias("m")), "counted")
    small, large = by_size(cells, by, d + 2, local)
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + f", base double, edges array<array<double>>, trees array<{TREE}>"
    forest = settle(fit_locally(small, by, lambda t: _grow_client(t, by, d, rounds, depth, rate, l2, least, bins), schema))
    if large is not None:
        binned, edges = _binned(large, by, d, bins)
        small, large = by_size(binned, by, d + 2, local)
        fitting = small.groupBy(*by).cogroup(edges.groupBy(*by))
        made = fitting.applyInArrow(lambda t, e: _grow_binned(t, e, by, d, rounds, depth, rate, l2, least), schema)
        forest = forest.unionByName(settle(made))
        if large is not None:
            forest = forest.unionByName(_grow_large(large, edges, by, d, rounds, depth, rate, l2, least))
    return Forest(forest, tuple(features), tuple(by), depth)


def _predict(rows: pa.Table, forest: pa.Table, kept: Sequence[str], d: int, depth: int) -> pa.Table:
    """Some rows of one client with the label its trees predict, or none where the client has no trees."""
    if not rows.num_rows or not forest.num_rows:
        return rows.select(kept).append_column("__prediction", pa.nulls(rows.num_rows, pa.bool_()))
    base, edges = forest.column("base")[0].as_py(), forest.column("edges")[0].as_py()
    trees = forest.column("trees")[0].as_py()
    size = max((len(t["value"]) for t in trees), default=2)
    feature, cut, value = np.full((len(trees), size), -1, np.int32), np.zeros((len(trees), size), np.int32), np.zeros((len(trees), size))
    for i, tree in enumerate(trees):
        feature[i, :len(tree["feature"])], cut[i, :len(tree["bin"])], value[i, :len(tree["value"])] = tree["feature"], tree["bin"], tree["value"]
    feature, cut, value, start = feature.ravel(), cut.ravel(), value.ravel(), (np.arange(len(trees)) * size)[:, None]
    coded = np.zeros((rows.num_rows, d), np.int32)
    for j in range(d):
        column = rows.column(f"__x{j}").combine_chunks()
        known = column.is_valid().to_numpy(zero_copy_only=False)
        coded[known, j] = np.searchsorted(np.array(edges[j], float), column.fill_null(0.0).to_numpy()[known])
    # Rows alike in all bins go down the trees once.
    place = np.zeros(rows.num_rows, np.int64)
    for j in range(d):
        place = np.unique(place * (len(edges[j]) + 1) + coded[:, j], return_inverse=True)[1]
    first, place = np.unique(place, return_index=True, return_inverse=True)[1:]
    coded = coded[first]
    margin = np.full(len(first), base)
    for at in range(0, len(first), BLOCK):
        bins = coded[at:at + BLOCK]
        each, node = np.arange(len(bins)), np.ones((len(trees), len(bins)), np.int64)
        for _ in range(depth):
            here = start + node
            chosen = feature[here]
            beyond = bins[each, np.maximum(chosen, 0)] > cut[here]
            node = np.where(chosen < 0, node, np.minimum(2 * node + beyond, size - 1))
        for leaf in value[start + node]:
            margin[at:at + BLOCK] += leaf
    return rows.select(kept).append_column("__prediction", pa.array((margin > 0)[place]))


def predict_trees(df: DataFrame, forest: Forest, prediction: str = "prediction") -> DataFrame:
    """Add the predicted label to every row."""
    by, d, depth = list(forest.by), len(forest.features), forest.depth
    df = df.drop(prediction)
    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARE).select(
        *by, F.ceil(F.col("n") / SHARE).cast("int").alias("__shares"))
    size = hot.count() * (len(by) + 1)
    # A client with many rows is predicted in several tasks, each with a copy of its trees.
    rows = df.withColumns({f"__x{j}": F.col(c).cast("double") for j, c in enumerate(forest.features)})
    trees, share = forest.trees, F.lit(0)
    if size:
        hot, shares = settle(hot), F.coalesce("__shares", F.lit(1))
        rows, trees = attach(rows, hot, by, size, df.columns), attach(trees, hot, by, size, by)
        share, trees = F.pmod(F.xxhash64(*df.columns), shares).cast("int"), trees.withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1)))
    else:
        trees = trees.withColumn("__share", share)
    rows = rows.withColumn("__share", share).drop("__shares")
    kept, schema = df.columns, T.StructType([*df.schema.fields, T.StructField("__prediction", T.BooleanType())])
    met = rows.groupBy(*by, "__share").cogroup(trees.groupBy(*by, "__share"))
    return met.applyInArrow(lambda r, f: _predict(r, f, kept, d, depth), schema).withColumnRenamed("__prediction", prediction)


def fit_predict_trees(
    df: DataFrame, spec: FairSpec, features: Sequence[str], train: Column, test: Column,
    by: Sequence[str] | None = None, **options,
) -> DataFrame:
    """Fit per client on the training rows and return the test rows with ``prediction``."""
    by = list(by or spec.client)
    return predict_trees(df.where(test), fit_trees(df.where(train), spec.label, features, by, **{"weight": spec.weight, **options}))
