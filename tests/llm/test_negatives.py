"""Hard negatives against all products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenhand.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, slot int, score double, block string"


def mined(rows, p=negatives.Mining(), divisor=10):
    """All products of whole numbers, one anchor after the other; rows are told apart by their place."""
    valid = []
    for vec_id, vector, label, *_ in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            valid.append((vec_id, [max(-2**63, min(2**63 - 1, math.floor(p.scale * x))) for x in vector], label))
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, (anchor, v, label) in enumerate(valid):
        if anchor is None or anchor % divisor:
            continue
        scores = [(max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), other, l, j) for j, (other, w, l) in enumerate(valid)]
        positives = sorted((s for s in scores if s[2] == label and s[3] != i), key=order)[:p.positives]
        for score, positive, *_ in positives:
            fits = sorted((s for s in scores if s[2] != label and p.low * score <= 100 * s[0] <= p.high * score), key=order)
            out += [(anchor, positive, k + 1, s[1], score, s[0]) for k, s in enumerate(fits[:p.negatives])]
    return out


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], SCHEMA).repartition(3)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def clustered(seed, n, width=12, hot=False):
    rnd, rng = random.Random(seed), np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=width)).tolist(), rnd.randrange(4)) for i in range(n)]
    if hot:
        rows += [(n + i, rows[0][1], rnd.randrange(2)) for i in range(n // 2)]
    return rows


@pytest.mark.parametrize("seed, hot, block", [(1, False, 16_384), (2, True, 16_384), (3, True, 60)])
def test_mined_equal_all_products(spark, seed, hot, block):
    rows = clustered(seed, 1200, hot=hot)
    found = negatives.mine_negatives(given(spark, rows), F.col("vec_id") % 10 == 0, block=block)
    assert ordered(found.collect()) == ordered(mined(rows)) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0], 1), (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.25], 2), (10, [0.25], 1), (20, [], 2), (3, None, 1), (4, [1.0, None], 1),
            (5, [nan, 1.0], 1), (6, [1.0, -inf], 2), (7, [1.0, 1.0], None), (8, [0.3, 0.7], 2), (9, [0.3, 0.7], 3), (30, [-1.0, -1.0], 3), (11, [-0.5, 0.1], 2),
            (None, [0.4, 0.6], 2)]
    found = negatives.mine_negatives(given(spark, rows), F.col("vec_id") % 10 == 0)
    assert ordered(found.collect()) == ordered(mined(rows)) != []
    assert negatives.mine_negatives(given(spark, rows).filter("false"), F.lit(True)).collect() == []
    assert negatives.mine_negatives(given(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]), F.col("vec_id") == 0).collect() == [(0, 1, 1, 2, 0, 0)]


@pytest.mark.parametrize("size", [1e2, 1e6, 1e8, 1e12])
def test_large_components_stay_exact(spark, size):
    rnd = random.Random(size)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(5)], rnd.randrange(3)) for i in range(120)]
    found = negatives.mine_negatives(given(spark, rows), F.col("vec_id") % 10 == 0)
    assert ordered(found.collect()) == ordered(mined(rows))


def test_boxes_are_pruned(monkeypatch):
    """On clustered rows most pages are not opened for an anchor."""
    rng = np.random.default_rng(5)
    n, width = 40_000, 8
    v = np.floor(256 * (np.repeat(np.eye(width), n // width, axis=0) + 0.02 * rng.normal(size=(n, width)))).astype(np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(np.arange(n) % 3), pa.array(np.arange(n) % 4000 == 0),
         pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(v.ravel())), pa.array(np.zeros(n, np.int64))],
        names=["id", "label", "anchor", "v", "part"])
    pages = list(negatives._pack(iter([batch]), width))
    assert sum(p.num_rows for p in pages) >= n // negatives.LEAF
    at = np.arange(0, n, 4000)
    q = negatives.Queries(v[at], at % 3, np.full(len(at), -1), np.full((len(at), 1), negatives.LEAST), np.full((len(at), 1), negatives.MOST), True)
    opened, product = [], negatives.Shape.product

    def counting(self, a, b):
        opened.append((len(a), len(b)))
        return product(self, a, b)

    monkeypatch.setattr(negatives.Shape, "product", counting)
    (found,) = negatives._search(iter(pages), q, negatives.Shape(width, "float64"), 5)
    whole = v[at] @ v.T
    for i, slot in enumerate(at):
        best = sorted((-whole[i, j], j) for j in np.flatnonzero(np.arange(n) % 3 == slot % 3))[:5]
        mine = [(-s, j) for k, s, j in zip(*[c.to_pylist() for c in found.columns]) if k == i]
        assert mine == best
    assert sum(a for a, b in opened if b == negatives.LEAF) < len(at) * n / negatives.LEAF / 2
