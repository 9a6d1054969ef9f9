"""Token ids in ORC: stripes with run-length encoded integers, row indexes, and Bloom filters on document ids.

Files hold the documents in ascending order of id, file after file, so that a reader takes stripes in parallel,
and statistics and Bloom filters skip the stripes and row groups that cannot hold a wanted document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenhand.llm.chunks import PieceEncoder
from evenhand.plans.runtime import scratch_path

# What ORC is told: Bloom filter and its error rate, documents per row group of the index, bytes per stripe.
FORMAT = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
          "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
# Pieces in each of two generations of a worker's cache; encoding is most of the work here and memory is free.
REMEMBERED = 350_000


class FileTokenizer:
    """A tokenizer read from the JSON of the tokenizers library. Texts of byte-level ones are encoded by pieces."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        rule = str(self.tokenizer.pre_tokenizer)
        by_piece = (rule.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in rule
                    and self.tokenizer.normalizer is None)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.newline, *more) = self._ids(["\n"])[0] if by_piece else (None, None)
        self.encoder = PieceEncoder(self._many, special, REMEMBERED) if by_piece and not more else None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, texts: list[str]) -> list[bytes]:
        """Pieces led by a space are encoded in one go with line breaks between, each of which is one token."""
        joined = [i for i, t in enumerate(texts) if t[:1] == " " and "\n" not in t and t[1:2].strip() and len(t) < 500]
        out: list[bytes] = [b""] * len(texts)
        taken = set(joined)
        others = [i for i in range(len(texts)) if i not in taken]
        for i, ids in zip(others, self._ids([texts[i] for i in others])):
            out[i] = np.array(ids, "<u4").tobytes()
        if joined:
            ids = np.array(self._ids(["\n".join(texts[i] for i in joined)])[0], "<u4")
            cuts, packed = 4 * np.flatnonzero(ids == self.newline), ids.tobytes()
            if len(cuts) != len(joined) - 1:
                raise ValueError("a line break between pieces is not one token of its own")
            for i, at, end in zip(joined, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(packed)]):
                out[i] = packed[at:end]
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        if self.encoder:
            yield from self.encoder.encode(texts)
        else:
            for text in texts:
                yield np.array(self._ids([text])[0], "<u4").tobytes()


@lru_cache(maxsize=1)
def _tokenizer(content: str) -> FileTokenizer:
    return FileTokenizer(content)


def _encoded(batches: Iterator[pa.RecordBatch], content: str, end: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, pos, n_tokens, ids) of one range of documents; pos counts the ids before it in its part."""
    coder, tail, pos = _tokenizer(content), np.array([end], "<u4").tobytes(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = batch.slice(at, 2000)
            packed = [p + tail for p in coder.encode(t or "" for t in rows.column(2).to_pylist())]
            sizes = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(pos + ends[:-1]), pa.array(sizes), ids],
                names=["doc_id", "part", "pos", "n_tokens", "ids"])
            pos += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, text: str = "text",
                 doc_id: str = "doc_id") -> None:
    """Encode every whole text with the tokenizer file, append ``end``, and write ORC in ascending order of id.

    Texts are dealt by range before they are encoded, so each is encoded once and only ids are written. A null
    text is an empty one (its only id is ``end``); null ids come first; rows that repeat an id are ordered by
    text; an empty table gives an empty folder of files. Other columns are not looked at.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind, parts = rows.dtypes[0][1], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text").select(
        "doc_id", F.spark_partition_id().alias("part"), "text")
    encoded = ordered.mapInArrow(lambda it: _encoded(it, content.value, end),
                                 f"doc_id {kind}, part int, pos bigint, n_tokens bigint, ids array<int>")
    encoded.write.options(**FORMAT).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a written folder, or those wanted.

    ``start`` is the number of ids of all documents before it. It comes from the sums of the parts, one small row
    for each, which are read from the narrow columns alone. A list of ids is pushed into the scan, where Bloom
    filters and statistics skip what cannot hold them.
    """
    rows = spark.read.orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    wanted = rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))
    return wanted.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("before") + F.col("pos")).alias("start"), "n_tokens", "ids")


def checksum(ids: str = "ids"):
    """Unsigned crc32 of a column of ids as little-endian unsigned 32-bit integers, null for null."""
    def crc(arrays: pa.Array) -> pa.Array:
        values = np.ascontiguousarray(arrays.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))
        view, ends = memoryview(values).cast("B"), arrays.offsets.to_numpy()
        return pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64(),
                        mask=arrays.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(crc, "bigint")(ids)


def token_path(spark: SparkSession) -> str:
    """A new folder for token files in the folder that all executors share."""
    return scratch_path(spark, "tokens")
