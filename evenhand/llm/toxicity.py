"""Toxicity by a linear-chain conditional random field over words, trained on tokens labelled from marked documents.

A word of a document marked toxic is labelled toxic if it or one of its beginnings is found far more often in toxic
documents than in others. The field has two states, an emission weight for each word and beginning, and transition
weights. Forward-backward marginals give the offending words; their largest value and their sum, through a fitted
logistic curve, give the score of a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import text_of
from evenhand.plans.runtime import stage

# Words of a block, the unit that sums run over side by side. Lengths of the beginnings of words that are features.
BLOCK, BEGINNINGS = 50, (4, 5, 6, 7)
TRIM = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and of the fit. ``toxic_rows`` and ``other_rows`` bound the labelled documents used.

    A feature tells toxic words if it is in ``share`` of the sampled toxic documents (three at least) and there
    ``ratio`` times as frequent as in the others. Documents count as toxic from ``decide``.
    """

    toxic_rows: int = 2000
    other_rows: int = 4000
    share: float = 0.01
    ratio: float = 20.0
    steps: int = 25
    rate: float = 0.5
    ridge: float = 1e-3
    decide: float = 0.7


@dataclass
class Field:
    """Weights of features, scores of the first state and of transitions, and the curve from marginals to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    chain: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)


def features(token: str) -> list[str]:
    """The word without punctuation around it, and its beginnings (marked by a star)."""
    word = token.strip(TRIM).lower()
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)] if word else []


class _Emissions(dict):
    """Emission of each token as it stands; forgets all when full, which costs time but changes nothing."""

    def __init__(self, model: Field):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > 300_000:
            self.clear()
        get = self.model.weights.get
        self[token] = out = self.model.bias + sum(get(f, 0.0) for f in features(token))
        return out


def marginals(emissions: Sequence[np.ndarray], chain: tuple[float, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Probability of the toxic state at each word of each text, and expected counts of the four transitions of all.

    Emissions are scores of the toxic state; the other scores 0. A text is one chain whatever its length. It is cut in
    blocks only to work on all blocks at once: products of a block's steps lead from any state before it to any at its
    end, chained products give the sums at the borders, and from there each block is filled in. Sums are scaled at every
    step; only ratios at one place are used, so scales cancel.
    """
    sizes = np.array([len(e) for e in emissions], np.int64)
    blocks = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    rows = int(first[-1])
    if not rows:
        return [np.zeros(0) for _ in emissions], np.zeros(4)
    real = np.zeros((rows, BLOCK), bool)
    score = np.zeros((rows, BLOCK))
    for e, at in zip(emissions, first):
        score.ravel()[at * BLOCK:at * BLOCK + len(e)] = e
        real.ravel()[at * BLOCK:at * BLOCK + len(e)] = True
    enters = real.copy()  # words that another word of the text stands before
    enters[first[:-1][sizes > 0], 0] = False
    score, real, enters = (np.ascontiguousarray(x.T) for x in (score, real, enters))
    # Weights of both states at a word; places behind the end of a text change nothing.
    says = np.where(real, 0.5 * np.stack([1 - np.tanh(score / 2), 1 + np.tanh(score / 2)]), 1.0)
    step = np.exp(np.reshape(chain, (2, 2)) - max(chain))
    moves = np.where(enters, step[:, :, None, None], np.eye(2)[:, :, None, None])  # from, to, place, block

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)

    through = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, rows)).copy()
    for t in range(BLOCK):
        through = np.stack([through[:, 0] * moves[0, j, t] + through[:, 1] * moves[1, j, t] for j in (0, 1)], 1) * says[:, t]
        through = scaled(through, (0, 1))
    into, after = np.ones((2, rows)), np.ones((2, rows))
    for k in range(int(blocks.max()) - 1):
        at = first[:-1][blocks > k + 1] + k
        into[:, at + 1] = scaled((into[:, None, at] * through[:, :, at]).sum(0), 0)
        at = first[1:][blocks > k + 1] - 1 - k
        after[:, at - 1] = scaled((through[:, :, at] * after[None, :, at]).sum(1), 0)

    before, ahead, behind = (np.empty((2, BLOCK, rows)) for _ in range(3))  # sums before a word, at it, and behind it
    a, b = into, after
    for t in range(BLOCK):
        before[:, t] = a
        a = ahead[:, t] = scaled((a[:, None] * moves[:, :, t]).sum(0) * says[:, t], 0)
    for t in range(BLOCK - 1, -1, -1):
        behind[:, t] = b
        b = scaled((moves[:, :, t] * (says[:, t] * b)[None]).sum(1), 0)
    both = ahead * behind
    p = np.ascontiguousarray((both[1] / both.sum(0)).T).ravel()
    change = before[:, None] * step[:, :, None, None] * (says * behind)[None]
    pairs = np.where(enters, change / change.sum((0, 1)), 0.0).sum((2, 3)).ravel()
    return [p[at * BLOCK:at * BLOCK + n] for at, n in zip(first, sizes)], pairs


def _summary(p: np.ndarray) -> tuple[float, float]:
    """The largest marginal, and the log of one more than their sum."""
    return float(p.max(initial=0.0)), math.log1p(float(p.sum()))


def _curve(model: Field, top: float, total: float) -> float:
    c0, c1, c2 = model.curve
    return 1 / (1 + math.exp(-min(max(c0 + c1 * top + c2 * total, -35.0), 35.0)))


def _texts(texts: pa.Array, together: int = 500_000) -> Iterator[list[str]]:
    """Texts in lists of about so many characters."""
    held, size = [], 0
    for t in texts.to_pylist():
        held.append(t or "")
        size += len(held[-1])
        if size >= together:
            yield held
            held, size = [], 0
    if held:
        yield held


def _offending(text: str, p: np.ndarray) -> list[dict]:
    """Spans of neighbouring words with a marginal of one half or more, and their largest marginal."""
    spans: list[dict] = []
    last = -2
    hit = set(np.flatnonzero(p >= 0.5).tolist())
    for i, m in enumerate(WORD.finditer(text)):
        if i not in hit:
            continue
        if i == last + 1:
            spans[-1].update(end=m.end(), p=max(spans[-1]["p"], float(p[i])))
        else:
            spans.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
        last = i
    return spans


def scorer(spark, model: Field):
    """A column function from texts to a struct of the score and the offending spans."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        emissions, scores, spans = _Emissions(shared.value), [], []
        for part in _texts(texts):
            words = [WORD.findall(t) for t in part]
            tables = [np.fromiter(map(emissions.__getitem__, w), float, len(w)) for w in words]
            for t, p in zip(part, marginals(tables, shared.value.chain)[0]):
                scores.append(_curve(shared.value, *_summary(p)))
                spans.append(_offending(t, p) if len(p) and p.max() >= 0.5 else [])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["score", "spans"])

    return F.arrow_udf(score, "struct<score:double,spans:array<struct<start:int,end:int,p:double>>>")


def is_held_out(doc_id: Column) -> Column:
    """Whether a row's label is never learned from: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, t: Training, text: str = "text", doc_id: str = "doc_id",
                    label: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most ``toxic_rows`` and ``other_rows`` labelled documents that are not held out, staged.

    Which ones is decided by a hash of the id. Documents labelled twice count as toxic if any label says so. The
    number of all such labels by class comes along.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic is not null").filter(~is_held_out(F.col("doc_id")))
    known = stage(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
              for c, n in ((1, t.toxic_rows), (0, t.other_rows))]
    chosen = stage(chosen[0].unionByName(chosen[1]), "chosen").withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col(doc_id).alias("__doc"), text_of(text).alias("text"))
    # The sample's bound bounds what is broadcast.
    sample = rows.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "toxic")
    return stage(sample.repartition(12), "sample"), counts


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents of the task each feature is found."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update({f for w in set(WORD.findall(text)) for f in features(w)})
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(
        pa.array([counts[c][f] for f in names], pa.int64()) for c in (1, 0))], names=["feature", "toxic", "other"])


def _encode_sample(batches: Iterator[pa.RecordBatch], ids: dict[str, int], telling: set[int]) -> Iterator[pa.RecordBatch]:
    """Features of every word of a document, how many each word has, and which words are labelled toxic."""
    for batch in batches:
        rows = []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = [[ids[f] for f in features(w) if f in ids] for w in WORD.findall(text)]
            marked = [bool(toxic) and not telling.isdisjoint(w) for w in words]
            rows.append((np.array([i for w in words for i in w], "i4").tobytes(),
                         np.array([len(w) for w in words], "i4").tobytes(), np.array(marked, "u1").tobytes(), toxic))
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns[:3]), pa.array(columns[3], pa.int32())],
                                         names=["ids", "sizes", "marked", "toxic"])


def _emitted(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "i4")
    sizes = [np.frombuffer(s, "i4") for s in batch.column("sizes").to_pylist()]
    owner = np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes) if sizes else [])
    flat = bias + np.bincount(owner, weights[ids], minlength=sum(map(len, sizes)))
    return ids, sizes, np.split(flat, np.cumsum([len(s) for s in sizes])[:-1])


def _gradient(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Expected minus observed counts of features, bias and transitions over the task's documents."""
    weights, bias, chain = shared.value
    out = np.zeros(len(weights) + 6)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, sizes, emissions = _emitted(batch, weights, bias)
        p, pairs = marginals(emissions, chain)
        marked = [np.frombuffer(m, "u1").astype(float) for m in batch.column("marked").to_pylist()]
        words = np.concatenate(p) - np.concatenate(marked)
        out[:len(weights)] += np.bincount(ids, np.repeat(words, np.concatenate(sizes)), minlength=len(weights))
        out[-6] += words.sum()
        for m in marked:
            old, new = m[:-1], m[1:]
            pairs = pairs - [((1 - old) * (1 - new)).sum(), ((1 - old) * new).sum(), (old * (1 - new)).sum(), (old * new).sum()]
            out[-1] += m.sum()
        out[-5:-1] += pairs
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])


def _summaries(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    weights, bias, chain = shared.value
    for batch in batches:
        _, _, emissions = _emitted(batch, weights, bias) if batch.num_rows else (0, 0, [])
        found = np.array([_summary(p) for p in marginals(emissions, chain)[0]]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found[:, 0]), pa.array(found[:, 1])],
                                         names=["toxic", "top", "total"])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a light ridge; x has a column of ones first."""
    c = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [0.01] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ c)
        c -= np.clip(step, -4, 4)
    return c


def fit(docs: DataFrame, labels: DataFrame, t: Training = Training(), text: str = "text", doc_id: str = "doc_id",
        label: str = "toxic") -> Field:
    """Train the field. Each step is one job over the staged sample whose tasks send only sums of gradients.

    Without labelled rows of both classes there is nothing to tell apart: the score is then the share of toxic
    labels everywhere (one half if there are none).
    """
    spark = docs.sparkSession
    sample, counts = training_sample(docs, labels, t, text, doc_id, label)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        known = sum(counts.values())
        share = min(max(counts.get(1, 0) / known, 1e-6), 1 - 1e-6) if known else 0.5
        return Field(curve=(math.log(share / (1 - share)), 0.0, 0.0))
    found = sample.mapInArrow(_count_features, "feature string, toxic bigint, other bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter("toxic >= 3").orderBy("feature").collect()
    ids = {r["feature"]: i for i, r in enumerate(found)}
    telling = {i for i, r in enumerate(found) if r["toxic"] >= t.share * n[1]
               and r["toxic"] / n[1] >= t.ratio * (r["other"] + 0.5) / n[0]}
    lookup = spark.sparkContext.broadcast((ids, telling))
    coded = stage(sample.mapInArrow(lambda it: _encode_sample(it, *lookup.value),
                                    "ids binary, sizes binary, marked binary, toxic int"), "coded")
    weights = np.zeros(len(ids) + 5)
    weights[-5] = -4.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)

    def jobs(task, schema: str) -> list:
        shared = spark.sparkContext.broadcast((weights[:-5], float(weights[-5]), tuple(weights[-4:])))
        rows = coded.mapInArrow(lambda it: task(it, shared), schema).collect()
        shared.unpersist()
        return rows

    for step in range(1, t.steps + 1):
        sums = np.sum([np.frombuffer(r["sums"]) for r in jobs(_gradient, "sums binary")], axis=0)
        grad = sums[:-1] / max(sums[-1], 1.0) + t.ridge * weights
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        weights -= t.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
    rows = jobs(_summaries, "toxic int, top double, total double")
    y = np.array([r["toxic"] for r in rows], float)
    curve = _logistic(np.array([(1.0, r["top"], r["total"]) for r in rows]), y)
    # The sample holds more of the toxic rows than there are; the intercept is set back to their real share.
    curve[0] += math.log(counts[1] / counts[0]) - math.log(n[1] / n[0])
    kept = {f: float(weights[i]) for f, i in ids.items() if abs(weights[i]) > 1e-3}
    return Field(kept, float(weights[-5]), tuple(map(float, weights[-4:])), tuple(map(float, curve)))


def score_documents(docs: DataFrame, model: Field, t: Training = Training(), text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; spans are offending words in code points.

    A null or empty text has no words and gets the score of no marginals. Rows are scored by themselves, so repeated
    rows and null ids (never learned from) need no care; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), is_held_out(F.col(doc_id)).alias("held_out"),
                       scorer(docs.sparkSession, model)(text_of(text)).alias("s"))
    return rows.select("doc_id", "held_out", F.col("s.score").alias("score"),
                       (F.col("s.score") >= t.decide).cast("int").alias("predicted"), F.col("s.spans").alias("spans"))
