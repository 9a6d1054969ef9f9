"""URL filters by Bloom filter cascades over all keys of the corpus: exact membership, and no join with the pages.

The first filter of a cascade holds the listed keys, the second those other keys of the corpus that the first lets
through, the third the listed keys that the second lets through, and so on until none is left. A key of the
corpus is listed exactly if the first filter that rejects it stands at an even place. Keys are dealt to shards by
hash; each shard's cascade is built in one bounded group and serves the rows wherever they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.plans.runtime import stage

# Distinct keys of a shard, so that one group stays small, and bytes of filters that are sent to tasks at a time.
SHARD_KEYS, BLOCK_BYTES = 500_000, 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Allow or block what lies at a host, or below it, on paths that start with ``path``."""

    verdict: str
    host: str
    path: str = ""

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block") or not self.host or self.path[:1] not in ("", "/"):
            raise ValueError("a rule allows or blocks a host, with an empty path or one that starts with a slash")

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, number sign or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    step = h2 | np.uint64(1)
    at = h1 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    at = (at ^ (at >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([((at + np.uint64(j) * step) >> np.uint64(3)) % np.uint64(bits) for j in range(hashes)])


def _passes(level: tuple[int, int, np.ndarray], number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    hashes, bits, table = level
    at = _positions(h1, h2, number, hashes, bits)
    return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build_cascade(listed: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(hashes, bits, packed bits) of each level for the keys (h1, h2), of which ``listed`` marks the listed ones."""
    inside, outside, levels = (h1[listed], h2[listed]), (h1[~listed], h2[~listed]), []
    while len(inside[0]):
        if len(levels) > 200:
            raise ValueError("a listed key and another one have equal hashes")
        n, others = len(inside[0]), max(len(outside[0]), 1)
        rate = min(0.5, n / others * math.sqrt(0.5)) if not levels else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(n * hashes / math.log(2)))
        table = np.zeros((bits + 7) // 8, np.uint8)
        at = _positions(*inside, len(levels), hashes, bits).ravel()
        np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append((hashes, bits, table))
        wrong = _passes(levels[-1], len(levels) - 1, *outside)
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return levels


def in_cascade(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the parity of the first level that rejects it, or of all levels if none does."""
    found, live = np.zeros(len(h1), bool), np.arange(len(h1))
    for number, level in enumerate(levels):
        passed = _passes(level, number, h1[live], h2[live])
        found[live[~passed]] = number % 2 == 1
        live = live[passed]
    found[live] = len(levels) % 2 == 1
    return found


class Cascades:
    """Named cascades over a universe of keys. ``keys`` has a column key and one boolean column for each name.

    A key may occur often and counts as listed where any of its rows says so. Null keys are left out.
    """

    def __init__(self, keys: DataFrame, names: Sequence[str]):
        self.names = tuple(names)
        flagged = keys.filter("key is not null").groupBy(F.xxhash64("key").alias("h1"), _second("key").alias("h2")).agg(
            *[F.max(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in self.names])
        flagged = stage(flagged, "keys")
        self.shards = max(1, math.ceil(flagged.count() / SHARD_KEYS))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
            rows = [(int(pdf["shard"].iloc[0]), name, number, hashes, bits, table.tobytes()) for name in names
                    for number, (hashes, bits, table) in enumerate(build_cascade(pdf[name].to_numpy(bool), h1, h2))]
            return pd.DataFrame(rows, columns=["shard", "name", "level", "hashes", "bits", "table"])

        built = flagged.withColumn("shard", _shard(F.col("h1"), self.shards)).groupBy("shard").applyInPandas(
            build, "shard int, name string, level int, hashes int, bits bigint, table binary")
        self.filters = stage(built, "cascades")

    def blocks(self) -> list[tuple[int, int]]:
        """Ranges of shards whose filters together stay below BLOCK_BYTES (one shard has less than that)."""
        sizes = self.filters.groupBy("shard").agg(F.sum(F.octet_length("table")).alias("n")).orderBy("shard").collect()
        out, held = [[0, 0]], 0
        for row in sizes:
            if held and held + row["n"] > BLOCK_BYTES:
                out.append([row["shard"], row["shard"]])
                held = 0
            out[-1][1], held = row["shard"] + 1, held + row["n"]
        out[-1][1] = self.shards
        return [tuple(b) for b in out]

    def mark(self, rows: DataFrame, keys: str) -> DataFrame:
        """Add for each name an array of booleans: which entries of the array column ``keys`` are listed.

        Filters are broadcast block by block; after each block but the last, the narrow rows are written out, so
        that only one block is in memory at a time.
        """
        first = F.transform(keys, lambda k: F.xxhash64(k))
        rows = rows.withColumns({"__h1": first, "__h2": F.transform(keys, lambda k: _second(k)),
                                 **{n: F.transform(keys, lambda k: F.lit(False)) for n in self.names}})
        blocks = self.blocks()
        for number, (low, high) in enumerate(blocks):
            kept: dict = {n: {} for n in self.names}
            for r in self.filters.filter(F.col("shard").between(low, high - 1)).orderBy("shard", "name", "level").collect():
                kept[r["name"]].setdefault(r["shard"], []).append((r["hashes"], r["bits"], bytes(r["table"])))
            shared = rows.sparkSession.sparkContext.broadcast(kept)
            for name in self.names:
                test = _tester(shared, name, self.shards)("__h1", "__h2")
                rows = rows.withColumn(name, F.zip_with(name, test, lambda a, b: a | b))
            if number + 1 < len(blocks):
                rows = stage(rows, "marked")
                shared.unpersist()
        return rows.drop("__h1", "__h2")


def _second(key: Column | str) -> Column:
    return F.xxhash64(F.lit(1), key)


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(h1, F.lit(shards)).cast("int")


def _tester(shared, name: str, shards: int):
    def test(h1s: pa.Array, h2s: pa.Array) -> pa.Array:
        h1, h2 = (np.ascontiguousarray(a.flatten().to_numpy(zero_copy_only=False)).view(np.uint64) for a in (h1s, h2s))
        ends = np.concatenate([[0], np.cumsum(h1s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        shard = h1.view(np.int64) % shards
        found = np.zeros(len(h1), bool)
        for s, levels in shared.value[name].items():
            mine = np.flatnonzero(shard == s)
            if len(mine):
                tables = [(k, bits, np.frombuffer(table, np.uint8)) for k, bits, table in levels]
                found[mine] = in_cascade(tables, h1[mine], h2[mine])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))

    return F.arrow_udf(test, "array<boolean>")


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], listed: DataFrame | None = None, url: str = "url",
               page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest rule that fits decides (blocking wins among equally long ones); ``rule`` is null where none fits.
    Such a page is blocked if its host or a domain above it is in ``listed`` (a column host), else allowed. Null
    urls and urls without ``://`` have an empty host and path, fit nothing and are allowed. Rows are judged by
    themselves, repeated ones alike; an empty table gives no rows; other columns are not looked at.
    """
    labels = max((r.host.count(".") + 1 for r in rules), default=1)
    lengths = sorted({len(r.path) for r in rules} or {0})
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("u")).select(
        "page_id", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"))
    parts = F.split("host", r"\.")
    # All domains of a host when there is a list, else those that a rule's host can equal.
    most = F.size(parts) if listed is not None else F.least(F.size(parts), F.lit(labels))
    rows = rows.withColumn("domains", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, -n, n), "."))))
    short = F.filter("domains", lambda d: F.size(F.split(d, r"\.")) <= labels)
    def led_by(n: int) -> Column:
        keys = F.transform(short, lambda d: F.concat(F.lit("rule "), d, F.substring("path", 1, n)))
        return F.when(F.length("path") >= n, keys).otherwise(F.array().cast("array<string>"))

    hosts = F.transform("domains", lambda d: F.concat(F.lit("host "), d))
    rows = rows.withColumn("keys", F.concat(*[led_by(n) for n in lengths], hosts)).drop("domains")

    spark = pages.sparkSession
    said = spark.createDataFrame([(f"rule {r.text}", True, r.verdict == "block") for r in rules],
                                 "key string, listed boolean, block boolean")
    universe = rows.select(F.explode("keys").alias("key")).distinct().withColumns({"listed": F.lit(False), "block": F.lit(False)})
    keys = universe.unionByName(said)
    if listed is not None:
        keys = keys.unionByName(listed.select(
            F.concat(F.lit("host "), F.translate("host", UPPER, LOWER)).alias("key"), F.lit(True).alias("listed"), F.lit(True).alias("block")))
    marked = Cascades(keys, ("listed", "block")).mark(rows, "keys")
    hits = F.filter(F.arrays_zip("keys", "listed", "block"), lambda k: k["listed"])
    rank = lambda k: F.struct(F.length(k["keys"]).alias("n"), k["block"].alias("block"), k["keys"].alias("key"))
    best = F.array_max(F.transform(F.filter(hits, lambda k: k["keys"].startswith("rule ")), rank))
    bad_host = F.exists(hits, lambda k: k["keys"].startswith("host "))
    marked = marked.withColumns({"best": best, "bad": bad_host})
    blocked = F.coalesce(F.col("best.block"), F.col("bad"))
    return marked.select("page_id", "host", "path", F.substring(F.col("best.key"), 6, 1 << 30).alias("rule"),
                         F.when(blocked, "block").otherwise("allow").alias("verdict"))


def hosts_with_words(pages: DataFrame, words: Sequence[str], url: str = "url") -> DataFrame:
    """The distinct hosts of the pages that have one of the words between dots and hyphens: a list to block."""
    wanted = F.array(*[F.lit(w) for w in words])
    return pages.select(url_host(F.col(url).cast("string")).alias("host")).distinct().filter(
        F.arrays_overlap(F.split("host", "[.-]"), wanted))
