"""Byte-level BPE with sentencepiece: a model serialised straight from a vocabulary of ranks, nothing trained.

Each token's bytes are written as characters, one for each byte, with its negative rank as score; the model's
normalisation is the identity. Of two neighbours, the pair whose join scores best is merged, which is the pair of
least rank. Texts are split by the vocabulary's pattern and each match is encoded by itself.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.chunks import REMEMBERED, PieceEncoder
from evenhand.llm.common import in_parts, text_of

# Pieces in each generation of the cache of a streaming task, whose worker shares its memory with other stages.
STREAMED = 50_000


@lru_cache
def byte_characters() -> str:
    """A visible character for each of the 256 bytes: itself where printable, else from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(others)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 of the bytes, then the rank) in order of rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(pairs))):
        raise ValueError(f"the ranks in {path} are not 0 to {len(pairs) - 1}, each once")
    return [tokens[i] for i in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model in its file format; the piece of rank r has id r, and one unknown piece follows.

    Fixed values of the format: piece 1, score 2, kind 3 (1 normal, 2 unknown); trainer 2 with kind 3 (2 is BPE)
    and size 4; normaliser 3 with name 1, dummy prefix 3, extra spaces 4, escaping 5.
    """
    chars = byte_characters()
    out = [_message(1, _message(1, "".join(chars[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -rank)
                    + _number(3, 1)) for rank, t in enumerate(tokens)]
    out.append(_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", -len(tokens)) + _number(3, 2)))
    out.append(_message(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens))))
    out.append(_message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class Coder:
    """Encoder and decoder around a serialised model."""

    def __init__(self, model: bytes, pattern: str, remembered: int = REMEMBERED):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(byte_characters())}
        size = self.pieces.get_piece_size() - 1
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.tokens = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(size)]
        self.whole = {self.pieces.id_to_piece(i): struct.pack("<I", i) for i in range(size)}
        self.table = pa.array(self.tokens, pa.large_binary())
        self.split = regex.compile(pattern).findall
        # Whether a space with letters of ASCII after it is one match, whatever their case.
        self.plain = all(self.split(t) == [t] for t in (" a", " A", " aB", " Ba", " ABc", " abcDEF"))
        self.encoder = PieceEncoder(self._encode_many, remembered=remembered)

    def _form(self, match: str) -> str:
        """The characters that stand for a match's bytes."""
        return match.encode().decode("latin-1").translate(self.chars)

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        """A match that is a token as it stands takes its id; all others are merged by the model."""
        space, whole = self.chars[0x20], self.whole
        # Letters of ASCII stand for themselves.
        forms = [space + t[1:] if self.plain and t[:1] == " " and t.isascii() and t[1:].isalpha() else
                 [self._form(m) for m in self.split(t)] for t in texts]
        merge = list({m for f in forms for m in ((f,) if type(f) is str else f) if m not in whole})
        packed = {m: array("I", x).tobytes() for m, x in zip(merge, self.pieces.encode(merge, num_threads=1))}
        return [whole.get(f) or packed[f] if type(f) is str else b"".join([whole.get(m) or packed[m] for m in f]) for f in forms]

    def decode(self, packed: bytes) -> bytes:
        return self.decode_all(pa.array([packed], pa.binary()))[0].as_py()

    def decode_all(self, packed: pa.Array) -> pa.Array:
        """The bytes of packed ids, null for null: one lookup for all ids, cut where the rows' ids end."""
        packed = packed.cast(pa.large_binary())
        offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1]
        ids = np.frombuffer(packed.buffers()[2] or b"", "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if offsets[-1] > offsets[0] else []
        found = self.table.take(pa.array(ids, pa.uint32()))
        ends = np.frombuffer(found.buffers()[1], np.int64)[:len(found) + 1] if len(found) else np.zeros(1, np.int64)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(packed), [
            None, pa.py_buffer(np.ascontiguousarray(ends[(offsets - offsets[0]) // 4])), found.buffers()[2] if len(found) else pa.py_buffer(b"")])
        return pc.if_else(packed.is_valid(), out, None).cast(pa.binary())


@lru_cache(maxsize=2)
def _coder(model: bytes, pattern: str, remembered: int = REMEMBERED) -> Coder:
    return Coder(model, pattern, remembered)


class BytePairs:
    """Encoding and decoding columns by a rank file at ``path`` and a splitting pattern.

    The model is built on the driver and broadcast; its size is that of the vocabulary. Ids are packed as
    little-endian unsigned 32-bit integers in a binary column; ``ids`` unpacks them.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        model = spark.sparkContext.broadcast(serialise_model(read_ranks(path)))

        def coded(coder: Coder, batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
            for texts in in_parts(batches):
                yield pa.array(list(coder.encoder.encode(t or "" for t in texts.to_pylist())), pa.binary())

        def streamed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from coded(_coder(model.value, pattern, STREAMED), batches)

        def encode(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays(list(coded(_coder(model.value, pattern), [texts])))

        def decode(packed: pa.Array) -> pa.Array:
            return _coder(model.value, pattern).decode_all(packed)

        def unpack(packed: pa.Array) -> pa.Array:
            return pa.array([None if p is None else np.frombuffer(p, "<u4").astype("i4") for p in packed.to_pylist()],
                            pa.list_(pa.int32()))

        self._encode, self._decode = F.arrow_udf(encode, "binary"), F.arrow_udf(decode, "binary")
        self._streamed = F.arrow_udf(streamed, "binary")
        self._unpack = F.arrow_udf(unpack, "array<int>")

    def encode(self, text: Column, streamed: bool = False) -> Column:
        """Packed ids of each whole text; an empty text has none, null counts as empty.

        If ``streamed``, a task hands ids on after every few megabytes of text, so it never holds a whole batch of them; a
        column made of them by Python then has to send them there again.
        """
        return (self._streamed if streamed else self._encode)(F.coalesce(text.cast("string"), F.lit("")))

    def decode(self, packed: Column) -> Column:
        """The bytes that the ids stand for, null for null; ids beyond the vocabulary fail."""
        return self._decode(packed)

    def ids(self, packed: Column) -> Column:
        return self._unpack(packed)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, n_tokens) of every row: packed ids. Rows are independent, so repeated rows, null ids and very
    long texts need no care; a null text is an empty one, an empty table gives no rows."""
    pairs = BytePairs(docs.sparkSession, path, pattern)
    ids = docs.select(F.col(doc_id).alias("doc_id"), pairs.encode(text_of(text)).alias("ids"))
    return ids.withColumn("n_tokens", F.shiftright(F.octet_length("ids"), 2).cast("long"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The encoded rows with the bytes that their ids stand for, as ``decoded``."""
    return encoded.withColumn("decoded", BytePairs(encoded.sparkSession, path, pattern).decode(F.col("ids")))
