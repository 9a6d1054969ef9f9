"""Hard negatives by an R-tree: rows of another label whose inner product with an anchor is a share of a positive's.

Rows are packed by sort-tile-recursive order: dealt by range of label and widest coordinate over tasks, and tiled by further
coordinates inside them. A page holds up to 256 rows and its minimum bounding box. A box bounds each coordinate's product with
an anchor, and so the scores inside it. A queue takes boxes in the order of their upper bounds; boxes outside an anchor's score
windows, or strictly below the worst score it still keeps, are not opened.

The anchors are a stated set of queries. They meet the pages in blocks of bounded size, one pass over the pages a block, and a
pass yields only what a task keeps of each anchor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import range_parts
from evenhand.plans.runtime import stage

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
# Rows of a page, pages of an inner box, rows tiled together, rows whose pages are searched together, and anchors scored together.
LEAF, FANOUT, TILED, GROUP, TOGETHER = 256, 16, 16_384, 131_072, 1024
# Anchors of a block, so that a block of vectors is small enough to broadcast. Also candidates held before they are ranked.
BLOCK, WAITING = 16_384, 50_000


@dataclass(frozen=True)
class Mining:
    """How many positives an anchor has and negatives a positive, the negatives' scores in percent of the positive's, and
    the factor that turns components into whole numbers."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


@dataclass(frozen=True)
class Shape:
    """Width of the vectors and the type in which scores are exact."""

    width: int
    kind: str

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of rows of a and b; beyond the range of a long they stay at its ends."""
        if self.kind == "object":
            return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)
        return (a.astype(self.kind) @ b.astype(self.kind).T)


def _shape(rows: DataFrame) -> tuple[Shape, int]:
    """The shape of the vectors, and the coordinate that varies most."""
    found = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(
        F.var_pop("x").alias("spread"), F.max(F.abs(F.col("x").cast("double"))).alias("most")).collect()
    if not found:
        return Shape(1, "float64"), 0
    width, most = 1 + max(r.j for r in found), max(r.most for r in found)
    bound = width * most * most
    kind = "float32" if bound < 2**24 else "float64" if bound < 2**53 else "int64" if bound < 2**62 else "object"
    return Shape(width, kind), max(found, key=lambda r: (r.spread, -r.j)).j


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _tiles(vectors: np.ndarray, rows: np.ndarray, turns: int = 3) -> Iterator[np.ndarray]:
    """Sort by the widest coordinate, cut into slabs, and each slab again by its own, down to pages."""
    pages = -(-len(rows) // LEAF)
    if pages <= 1:
        yield rows
        return
    axis = int(np.argmax(vectors[rows].astype(float).var(axis=0))) if vectors.shape[1] else None
    if axis is not None:
        rows = rows[np.argsort(vectors[rows, axis], kind="stable")]
    slabs = max(2, round(pages ** (1 / turns))) if turns > 1 else pages
    size = -(-pages // slabs) * LEAF
    for at in range(0, len(rows), size):
        yield from _tiles(vectors, rows[at:at + size], max(turns - 1, 1))


PAGE = "first bigint, ids binary, labels binary, anchors binary, vectors binary, low binary, high binary"
_PAGE = pa.schema([("first", pa.int64()), *[(c, pa.binary()) for c in ("ids", "labels", "anchors", "vectors", "low", "high")]])


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pages of a task's sorted rows; every row has a number of its own."""
    made = 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILED):
            part = batch.slice(at, TILED)
            ids = part.column(0).fill_null(MOST).to_numpy()
            labels, anchors = part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
            vectors, base = _vectors(part.column(3), width), part.column(4)[0].as_py() << 40
            pages = []
            for rows in _tiles(vectors, np.arange(part.num_rows)):
                v = vectors[rows]
                pages.append([base + made * LEAF, *[np.ascontiguousarray(x).tobytes() for x in (
                    ids[rows], labels[rows], anchors[rows], v, v.min(axis=0), v.max(axis=0))]])
                made += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pages), _PAGE.types)], schema=_PAGE)


def pack(rows: DataFrame, shape: Shape, axis: int) -> DataFrame:
    """The leaves of the tree: rows (id, label, anchor, v) dealt by range and tiled, one page a row, staged."""
    order = ["label", F.get("v", F.lit(axis)), F.xxhash64("id", "v")]
    parts = range_parts(rows, 8 * F.size("v") + 32)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "id", "label", "anchor", "v", F.spark_partition_id().cast("bigint").alias("part"))
    return stage(dealt.mapInArrow(lambda it: _pack(it, shape.width), PAGE), "pages")


class Best:
    """The best k of each slot so far: highest score first, then smallest id."""

    def __init__(self, slots: int, k: int):
        self.k, self.kept, self.new, self.waiting = k, [np.zeros(0, np.int64)] * 3, [], 0
        self.kth, self.kth_id = np.full(slots, LEAST), np.full(slots, MOST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.kth[slot]) | ((score == self.kth[slot]) & (ids < self.kth_id[slot]))
        self.new.append((slot[better], score[better], ids[better]))
        self.waiting += int(better.sum())
        if self.waiting > WAITING:
            self.rank()

    def rank(self) -> None:
        if not self.waiting:
            return
        slot, score, ids = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        last = rank == self.k - 1
        self.kth[slot[last]], self.kth_id[slot[last]] = score[last], ids[last]
        self.kept = [x[rank < self.k] for x in (slot, score, ids)]
        self.new, self.waiting = [], 0


class Boxes:
    """Minimum bounding boxes with the range of labels inside."""

    def __init__(self, low, high, label_low, label_high):
        self.low, self.high, self.label_low, self.label_high = low, high, label_low, label_high

    def joined(self, fanout: int) -> Boxes:
        """One box around each run of neighbours."""
        at = np.arange(0, len(self.low), fanout)
        return Boxes(np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at),
                     np.minimum.reduceat(self.label_low, at), np.maximum.reduceat(self.label_high, at))

    def bounds(self, vectors: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of each vector (rows) in each box (columns)."""
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        if shape.kind == "object":
            low = [a.astype(object) @ b.astype(object).T for a, b in ((up, self.low), (down, self.high))]
            high = [a.astype(object) @ b.astype(object).T for a, b in ((up, self.high), (down, self.low))]
            return tuple(np.clip(x + y, LEAST, MOST).astype(np.int64) for x, y in (low, high))
        return (shape.product(up, self.low) + shape.product(down, self.high),
                shape.product(up, self.high) + shape.product(down, self.low))


@dataclass
class Queries:
    """Anchors with their windows of scores: vectors, labels, row numbers, and low and high by anchor and window."""

    vectors: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool


def _search_some(pages: list, boxes: Boxes, q: Queries, at: slice, shape: Shape, best: Best) -> None:
    """Best-first over the boxes of some pages for the anchors ``at``."""
    vectors, labels, windows = q.vectors[at], q.labels[at], q.low.shape[1]
    low, high = q.low[at], q.high[at]
    slots = np.arange(len(q.labels))[at][:, None] * windows + np.arange(windows)
    inner = boxes.joined(FANOUT)
    levels = [(b, *b.bounds(vectors, shape)) for b in (inner, boxes)]

    def wanted(level: int, i: int) -> np.ndarray:
        """Which anchors may find something in box i."""
        box, least, most = levels[level]
        worst = np.maximum(low, best.kth[slots])
        open_ = ((most[:, i, None] >= worst) & (least[:, i, None] <= high)).any(axis=1)
        if q.same:
            return open_ & (labels >= box.label_low[i]) & (labels <= box.label_high[i])
        return open_ & ~((labels == box.label_low[i]) & (labels == box.label_high[i]))

    queue: list[tuple[float, int, int]] = []

    def push(level: int, numbers: range) -> None:
        for i in numbers:
            chosen = wanted(level, i)
            if chosen.any():
                heapq.heappush(queue, (-float(levels[level][2][chosen, i].max()), level, i))

    push(0, range(len(inner.low)))
    while queue:
        _, level, i = heapq.heappop(queue)
        if level == 0:
            push(1, range(i * FANOUT, min((i + 1) * FANOUT, len(pages))))
            continue
        chosen = np.flatnonzero(wanted(1, i))
        if not len(chosen):
            continue
        first, ids, page_labels, page = pages[i]
        scores = shape.product(vectors[chosen], page)
        fits = labels[chosen, None] == page_labels if q.same else labels[chosen, None] != page_labels
        worst = np.maximum(low[chosen], best.kth[slots[chosen]])
        fits &= (scores >= worst.min(axis=1)[:, None]) & (scores <= high[chosen].max(axis=1)[:, None])
        a, j = np.nonzero(fits)
        score = scores[a, j].astype(np.int64)
        if q.same:
            other = q.rows[at][chosen[a]] != first + j
            a, j, score = a[other], j[other], score[other]
        for w in range(windows):
            inside = (score >= worst[a, w]) & (score <= high[chosen[a], w])
            best.add(slots[chosen[a[inside]], w], score[inside], ids[j[inside]])


def _search(batches: Iterator[pa.RecordBatch], q: Queries, shape: Shape, k: int) -> Iterator[pa.RecordBatch]:
    """(slot, score, id): what a task's pages offer each slot (anchor and window), k rows at most."""
    best, held, rows = Best(q.low.size, k), [], 0
    kind = shape.kind if shape.kind != "object" else "int64"

    def look() -> None:
        columns = list(zip(*held))
        pages = [(first, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64),
                  np.frombuffer(v, np.int64).reshape(-1, shape.width).astype(kind))
                 for first, ids, labels, v in zip(columns[0], columns[1], columns[2], columns[4])]
        low, high = (np.stack([np.frombuffer(x, np.int64) for x in c]) for c in columns[5:7])
        boxes = Boxes(low, high, *(np.array([f(p[2]) for p in pages]) for f in (np.min, np.max)))
        for at in range(0, len(q.labels), TOGETHER):
            _search_some(pages, boxes, q, slice(at, at + TOGETHER), shape, best)

    for batch in batches:
        for page in zip(*[c.to_pylist() for c in batch.columns]):
            held.append(page)
            rows += len(page[1]) // 8
            if rows >= GROUP:
                look()
                held, rows = [], 0
    if held:
        look()
    best.rank()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.kept], names=["slot", "score", "id"])


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, ids, labels, anchors, v, _, _ in zip(*[c.to_pylist() for c in batch.columns]):
            at = np.flatnonzero(np.frombuffer(anchors, bool))
            vectors = np.frombuffer(v, np.int64).reshape(-1, width)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + at), pa.array(np.frombuffer(ids, np.int64)[at]), pa.array(np.frombuffer(labels, np.int64)[at]),
                 pa.array([x.tobytes() for x in vectors], pa.binary())], names=["row", "id", "label", "v"])


def _found(pages: DataFrame, q: Queries, shape: Shape, k: int) -> DataFrame:
    """(slot, place, score, id): the best k of every slot over all tasks."""
    shared = pages.sparkSession.sparkContext.broadcast(q)
    offered = pages.mapInArrow(lambda it: _search(it, shared.value, shape, k), "slot bigint, score bigint, id bigint")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("id")))
    return offered.withColumn("place", place).filter(F.col("place") <= k)


def _window(score: int, p: Mining) -> tuple[int, int]:
    """The scores that are between the shares of a positive's."""
    return max(-(-p.low * score // 100), LEAST), min(p.high * score // 100, MOST)


def mine_negatives(rows: DataFrame, anchor: Column, p: Mining = Mining(), vec_id: str = "vec_id", label: str = "label",
                   vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` chooses.

    Components become floor(scale * x), a score is the inner product of two rows. An anchor's positives are the best other
    rows of its label, a positive's negatives the best rows of another label whose score is between ``low`` and ``high``
    percent of the positive's; higher scores come first, then smaller ids. Fewer are returned where there are fewer.

    Rows with a null label, a null vector or a component that is null or not finite take no part. A null id comes last among
    ties; a null ``anchor`` is no anchor. Shorter vectors are filled with zeros. Scores beyond a long stay at its ends.
    Rows that repeat an id are rows of their own, as anchors too. An empty table gives no rows. Other columns are not looked at.
    """
    spark = rows.sparkSession
    x = lambda c: c.cast("double")
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    valid = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~odd).select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(vector, lambda c: F.floor(x(c) * p.scale)).alias("v"))
    shape, axis = _shape(valid)
    pages = pack(valid, shape, axis)
    anchors = stage(pages.mapInArrow(lambda it: _anchors(it, shape.width), "row bigint, id bigint, label bigint, v binary"), "anchors")
    numbered = anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-anchors.count() * 2 // block)))).alias("block"))
    made = None
    for (number,) in numbered.select("block").distinct().orderBy("block").collect():
        one = _mine_block(pages, numbered.filter(F.col("block") == number).orderBy("row").toArrow(), shape, p)
        made = one if made is None else made.unionByName(one)
    if made is None:
        made = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return made


def _mine_block(pages: DataFrame, anchors: pa.Table, shape: Shape, p: Mining) -> DataFrame:
    """The negatives of one block of anchors, staged; its anchors and positives are held by the driver."""
    spark, n = pages.sparkSession, anchors.num_rows
    ids, labels, rows = (anchors.column(c).to_numpy() for c in ("id", "label", "row"))
    vectors = np.frombuffer(b"".join(anchors.column("v").to_pylist()), np.int64).reshape(n, shape.width)
    q = Queries(vectors, labels, rows, np.full((n, 1), LEAST), np.full((n, 1), MOST), same=True)
    chosen = _found(pages, q, shape, p.positives).orderBy("slot", "place").toArrow()
    slot, place, score, positive = (chosen.column(c).to_numpy() for c in ("slot", "place", "score", "id"))
    low, high = np.full((n, p.positives), MOST), np.full((n, p.positives), LEAST)
    for s, k, value in zip(slot.tolist(), place.tolist(), score.tolist()):
        low[s, k - 1], high[s, k - 1] = _window(value, p)
    found = _found(pages, Queries(vectors, labels, rows, low, high, same=False), shape, p.negatives)
    named = pa.table({"slot": slot * p.positives + place - 1, "anchor_id": ids[slot], "positive_id": positive, "positive_score": score})
    known = lambda c: F.when(F.col(c) != int(MOST), F.col(c)).alias(c)
    out = found.withColumnRenamed("id", "negative_id").join(F.broadcast(spark.createDataFrame(named)), "slot")
    return stage(out.select(known("anchor_id"), known("positive_id"), F.col("place").cast("int").alias("rank"), known("negative_id"),
                            "positive_score", F.col("score").alias("negative_score")), "mined")
