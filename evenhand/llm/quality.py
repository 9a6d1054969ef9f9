"""Quality rules by document and by host: host failure rates, shrunk with an empirical beta prior, meet the documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import carry, in_parts, text_of
from evenhand.plans.runtime import attach, stage

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
# Bytes that no word holds, and those that continue a code point.
SPACES, CONTINUING = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# Rules on one document that fail it by itself.
BASE_RULES = {"few_words": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words"}
# Rules that only count against its host, besides those above.
HOST_RULES = {"symbols": "10 * n_symbols > n_words", "same_lines": "10 * n_dup_lines > 3 * n_lines",
              "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words"}


@dataclass(frozen=True)
class HostRules:
    """A host whose shrunk failure rate exceeds ``most`` loses all its documents."""

    most: float = 0.5
    base: tuple[str, ...] = tuple(BASE_RULES.values())
    extra: tuple[str, ...] = tuple(HOST_RULES.values())


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Hashes of windows find candidates, the windows' words confirm them.
    """
    starts = len(words) - width + 1
    if starts < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(starts, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k:starts + k]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():
        seen.setdefault(tuple(words[i:i + width]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(edges, places, 1)
            np.add.at(edges, np.array(places) + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), len(text.translate(None, SPACES + CONTINUING)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def measures(text: Column) -> Column:
    """Struct of the counts in MEASURES of each whole text; all are 0 for an empty text."""
    def measure(texts: pa.Array) -> pa.Array:
        found = np.array([_measure(t) for part in in_parts([texts]) for t in part.cast(pa.large_binary()).to_pylist()], np.int64)
        columns = found.reshape(-1, len(MEASURES)).T
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=MEASURES)

    return F.arrow_udf(measure, "struct<" + ", ".join(f"{m}:bigint" for m in MEASURES) + ">")(text)


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, failed, rate) with ``rate`` shrunk towards the rate of all, from rows (host, failed 0/1).

    The prior is a beta distribution fitted to the hosts by moments: its mean is the failure rate of all rows, and
    its strength follows from how much more the hosts' rates differ than chance would make them. Where they
    differ no more, every host has the rate of all. Only five sums leave the cluster.
    """
    hosts = stage(judged.groupBy("host").agg(F.count("*").alias("n"), F.sum("failed").alias("failed")), "hosts")
    s = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("x"),
                  F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
                  F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("xx")).first()
    mean = s["x"] / s["n"] if s["n"] else 0.0
    chance = mean * (1 - mean)
    spread = s["n"] - s["nn"] / s["n"] - (s["k"] - 1) if s["n"] else 0.0
    alike = (s["xx"] - s["n"] * mean * mean - chance * (s["k"] - 1)) / (chance * spread) if chance * spread > 0 else 0.0
    if alike <= 0:
        rate: Column = F.lit(mean)
    else:
        strength = 1 / min(alike, 1.0) - 1
        rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate.cast("double"))


def _judged(measured: DataFrame, rules: HostRules) -> DataFrame:
    """Base failure of each row, and whether any rule counts against its host."""
    any_of = lambda names: F.expr(" or ".join(f"({r})" for r in names))
    return measured.withColumn("base_failed", any_of(rules.base)).withColumn(
        "failed", any_of((*rules.base, *rules.extra)).cast("int"))


def _with_verdicts(rows: DataFrame, hosts: DataFrame, rules: HostRules, spread: str) -> DataFrame:
    known = hosts.select("host", "rate")
    joined = attach(rows, known, ["host"], 2 * hosts.count(), [spread])
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("rate") <= rules.most))


def judge_quality(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text", doc_id: str = "doc_id",
                  host: str = "source") -> DataFrame:
    """(doc_id, host, the measures, base_failed, rate, kept) of every row.

    A null or empty text has no words and fails. Rows without a host form one host of their own. Repeated rows
    count as often as they occur. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), measures(text_of(text)).alias("m"))
    judged = stage(_judged(rows.select("doc_id", "host", "m.*"), rules), "judged")
    return _with_verdicts(judged, host_rates(judged), rules, "doc_id").drop("failed")


def drop_low_quality(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text",
                     host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps.

    Texts are measured twice, for the hosts' rates and for their own verdict, so that they need not be written in between.
    """
    whole = carry(docs, host=F.col(host), m=measures(text_of(text)))
    judged = _judged(whole.select("host", "__row", "m.*"), rules)
    left = judged.filter("not base_failed").select("host", "__row", "base_failed", F.hash("n_words", "word_chars").alias("deal"))
    return _with_verdicts(left, host_rates(judged.select("host", "failed")), rules, "deal").filter("kept").select("__row.*")
