"""Secrets in texts: patterns propose them, and candidates in base64 or hex are decoded and confirmed by structure.

A decoded candidate is reported if its bytes are a key from end to end: DER whose nested lengths fit and whose
fields are those of a key, the length-prefixed strings of an OpenSSH key, or a signed token whose header is JSON
and names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import text_of

#: Kinds in the order in which spans of one start are listed: by pattern alone, then confirmed by structure.
PATTERN_KINDS, STRUCTURE_KINDS = ("assign", "access", "hex"), ("der", "openssh", "jwt")
KINDS = PATTERN_KINDS + STRUCTURE_KINDS
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# Equal to the shorter patterns followed by a check of length, as both take maximal runs.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
# Runs of base64 or hex whose first characters can open a DER sequence, an OpenSSH key or a JSON object. The second
# look-behind sees the character before the first one, so that only whole runs are taken. Lines may also end as JSON
# writes them, in a backslash and a letter; a line of dashes ends a block.
_RUN = "A-Za-z0-9+/_-"
_BREAK = r"(?:\r?\n|(?:\\r)?\\n)"
BREAK = re.compile(_BREAK)
BASE64 = re.compile(rf"[MAbe](?:(?<![{_RUN}].)|(?<=\\[nr].))(?:(?<=M)[{_RUN}]|(?<=A)AAA|(?<=b)3Bl|(?<=e)(?:y[AIJ]|w[0o]))[{_RUN}]{{16,}}"
                    rf"(?:{_BREAK}(?!-----)[{_RUN}]{{16,}})*(?:{_BREAK}(?!-----)[{_RUN}]+)?={{0,2}}", re.DOTALL)
OPENS = re.compile(rf"(?:M|AAAA|b3Bl)(?=[{_RUN}]{{17}})")
HEX_DER = re.compile(r"3(?<![0-9A-Fa-f].)0[0-9A-Fa-f]{46,}", re.DOTALL)
TOKEN = re.compile(r"e(?<![A-Za-z0-9_-].)[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*", re.DOTALL)
# Of each algorithm, the strings of its public key: the name, and numbers, a curve and point, a key, or an application.
ALGORITHMS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3,
              b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3}
MAGIC = b"openssh-key-v1\0"
INTEGER, BITS, OCTETS, OID, SEQUENCE, TAGGED = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0


def decode_base64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, with or without padding and line breaks; None if it is none."""
    plain = re.sub(r"[\r\n=]|\\[rn]", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of each DER element in ``data``; None if a length does not fit exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            length, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + length > len(data):
            return None
        out.append((tag, data[at:at + length]))
        at += length
    return out


def is_der_key(data: bytes) -> bool:
    """One sequence to the last byte, with the fields of a private or public key of the usual standards."""
    top = der_fields(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    fields = der_fields(top[0][1])
    if not fields:
        return False
    tags = [tag for tag, _ in fields]
    named = lambda content: (der_fields(content) or [(0, b"")])[0][0] == OID
    if tags[:9] == [INTEGER] * 9 and fields[0][1] in (b"\0", b"\1"):  # RSA, private
        return True
    if tags == [INTEGER] * 2 and len(fields[0][1]) >= 64 and len(fields[1][1]) <= 8:  # RSA, public
        return True
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and len(fields[0][1]) == 1:  # private, any algorithm
        return named(fields[1][1])
    if tags == [SEQUENCE, OCTETS]:  # private, encrypted
        return named(fields[0][1])
    if tags == [SEQUENCE, BITS]:  # public, any algorithm
        return named(fields[0][1])
    return tags[:2] == [INTEGER, OCTETS] and fields[0][1] == b"\1" and set(tags[2:]) <= {TAGGED, TAGGED + 1} and (
        len(fields[1][1]) >= 20)  # elliptic curve, private


def _strings(data: bytes) -> list[bytes] | None:
    """Strings that are each led by their length in four bytes; None if they do not end with the data."""
    out, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at:at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        out.append(data[at + 4:end])
        at = end
    return out


def is_openssh_key(data: bytes) -> bool:
    if data.startswith(MAGIC):
        at, lead = len(MAGIC), []
        for _ in range(3):  # cipher, key derivation, its options
            end = at + 4 + int.from_bytes(data[at:at + 4], "big")
            if end + 4 > len(data):
                return False
            lead.append(data[at + 4:end])
            at = end
        keys, rest = int.from_bytes(data[at:at + 4], "big"), _strings(data[at + 4:])
        return 1 <= keys <= 64 and rest is not None and len(rest) == keys + 1 and all(lead[:2])
    parts = _strings(data)
    return bool(parts) and len(parts) == ALGORITHMS.get(parts[0]) and all(parts)


class _Bytes:
    """The bytes that base64 without breaks stands for from some place on, decoded only where they are looked at."""

    def __init__(self, plain: str, start: int):
        self.plain, self.start = plain, start

    def __getitem__(self, wanted: slice) -> bytes:
        first = wanted.start // 3
        part = self.plain[self.start + 4 * first:self.start + 4 * (-(-wanted.stop // 3))]
        part = part[:len(part) - (len(part) % 4 == 1)]
        return (decode_base64(part) or b"")[wanted.start - 3 * first:wanted.stop - 3 * first]

    def number(self, at: int) -> int:
        return int.from_bytes(self[at:at + 4], "big")


def _key_size(data: _Bytes) -> int | None:
    """How many of the first bytes of ``data`` can be a key, as its lengths say; only the lengths are decoded."""
    opens = data[0:6]
    if opens[:1] == bytes([SEQUENCE]) and len(opens) == 6:
        width = opens[1] & 0x7F if opens[1] & 0x80 else 0
        return 2 + width + int.from_bytes(opens[2:2 + width], "big") if width else 2 + opens[1]
    at, end = 0, 3 * len(data.plain) // 4
    if data[0:len(MAGIC)] == MAGIC:
        at = len(MAGIC)
        for place in range(3):
            size = data.number(at)
            at += 4 + size
            if at > end or place < 2 and not size:
                return None
        keys, at = data.number(at), at + 4
        strings = keys + 1 if 1 <= keys <= 64 else 0
    else:
        strings = ALGORITHMS.get(data[4:4 + data.number(0)] if data.number(0) < 64 else b"", 0)
    for _ in range(strings):
        if at > end:
            return None
        at += 4 + data.number(at)
    return at if strings else None


def _keys(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in lines of base64.

    A key fills whole lines, from the one that opens it to the one at which its own lengths end, so that neither words
    around it nor other keys hide it.
    """
    breaks = list(BREAK.finditer(text, start, end))
    starts, ends = [start, *(b.end() for b in breaks)], [*(b.start() for b in breaks), end]
    upto = list(accumulate((len(text[a:b].rstrip("=")) for a, b in zip(starts, ends)), initial=0))
    plain = "".join(text[a:b].rstrip("=") for a, b in zip(starts, ends))
    line = 0
    while line < len(starts):
        at, line = line, line + 1
        size = _key_size(_Bytes(plain, upto[at])) if OPENS.match(text, starts[at], ends[at]) else None
        if not size:
            continue
        last = bisect_left(upto, upto[at] + (size * 4 + 2) // 3)
        if last == len(upto) or upto[last] != upto[at] + (size * 4 + 2) // 3:
            continue
        key = decode_base64(text[starts[at]:ends[last - 1]])
        kind = "openssh" if key and is_openssh_key(key) else "der" if key and is_der_key(key) else None
        if kind:
            yield kind, starts[at], ends[last - 1]
            line = last


def is_signed_token(text: str) -> bool:
    """Whether header and body are base64 of JSON objects and the header names its algorithm."""
    for place, part in enumerate(text.split(".")[:2]):
        try:
            said = json.loads(decode_base64(part) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(said, dict) or place == 0 and not isinstance(said.get("alg"), str):
            return False
    return True


def find_secrets(text: str) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end) of all spans, by start; offsets in code points, ends exclusive."""
    return sorted(_spans(text))


def _spans(text: str) -> Iterator[tuple[int, int, str, int]]:
    def span(kind: str, match: re.Match) -> tuple[int, int, str, int]:
        return match.start(), KINDS.index(kind), kind, match.end()

    if ":" in text or "=" in text:
        yield from (span("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 8)
    if "AKIA" in text:
        yield from (span("access", m) for m in ACCESS.finditer(text))
    yield from (span("hex", m) for m in HEX.finditer(text))
    for m in BASE64.finditer(text):
        yield from ((start, KINDS.index(kind), kind, end) for kind, start, end in _keys(text, *m.span()))
    for m in HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            yield span("der", m)
    for m in TOKEN.finditer(text):
        if is_signed_token(m[0]):
            yield span("jwt", m)


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row: kind, start, end and value of all spans in its whole text, by start.

    Spans of different kinds may overlap. A null or empty text has none. Rows are independent, so repeated rows and
    null ids need no care; an empty table gives no rows; other columns are not looked at.
    """
    def scan(texts: pa.Array) -> pa.Array:
        found = [[{"kind": kind, "start": start, "end": end, "value": t[start:end]}
                  for start, _, kind, end in find_secrets(t)] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                                   ("value", pa.string())])))

    scanned = F.arrow_udf(scan, "array<struct<kind:string,start:int,end:int,value:string>>")
    return docs.select(F.col(doc_id).alias("doc_id"), scanned(text_of(text)).alias("spans"))
