"""Near duplicates by circulant MinHash: two permutations give every signature coordinate, then banding, then exact
Jaccard verification on full shingle sets.

Three things keep the work linear in groups of any size. Documents with equal shingle sets form a class and only
its representative goes on. Every member of a bucket is compared with one hub of the bucket, not with all
members. Only members that are then still in another component than the rest of their bucket are compared with
the others, so that no link is lost. Texts are read twice; sets exist only for documents that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import attach_groups, carry, component_labels, in_parts, unpack
from evenhand.plans.runtime import stage

SKETCH = ("s0", "s1", "s2", "s3", "s4", "s5")
# Shingles whose coordinates are computed at a time, so that a very long text needs no more memory.
BLOCK = 2048
# Outsiders and members of a cluster that are compared in one group.
OUTSIDERS, MEMBERS = 128, 256


@dataclass(frozen=True)
class NearDedup:
    """Words a shingle has, similarity in percent from which documents are linked, and the shape of the signature.

    With 24 bands of 4 coordinates, a pair at 80 % is missed with probability (1 - 0.8^4)^24 = 3e-6, and sharing
    no band is the only way to be missed besides agreeing in fewer than ``least_agreeing`` of the 96 coordinates
    (five standard deviations below the mean at 80 %).
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    least_agreeing: int = 58
    seed: int = 1

    def __post_init__(self) -> None:
        if self.bands * self.rows != 16 * len(SKETCH):
            raise ValueError(f"bands times rows must be {16 * len(SKETCH)}, the coordinates a sketch holds")


class _WordHashes(dict):
    """A 64-bit hash for each word; forgets all when full, which costs time but changes nothing."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text: A-Z lower-cased, words between white space of ASCII."""
    words = text.lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(w))
    if not width:
        return w
    out = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[k:len(w) - width + 1 + k]
    return np.unique(_mix(out))


def _set_sums(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two keys of a whole set."""
    return shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles * (shingles | np.uint64(1)))


def signature(shingles: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """Circulant MinHash: sigma deals shingles over a ring of 2^32 places, pi is read at each place shifted by k.

    Coordinate k is the least pi(sigma(s) - k) over all shingles s; pi is one multiply-and-shift bijection of the
    ring and its circular shifts serve as all further permutations.
    """
    ring = (_mix(shingles + np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(ring), BLOCK):
        x = ring[None, at:at + BLOCK] - shifts
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x9E3779B1)
        least = np.minimum(least, x.min(axis=1))
    return least


def _sketches(batches: Iterator[pa.RecordBatch], p: NearDedup) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in in_parts(batches):
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        n = len(texts)
        count, keys = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
        bands, sketch = np.zeros((n, p.bands), np.uint64), np.zeros((n, len(SKETCH)), np.uint64)
        for i, text in enumerate(texts):
            s = shingle_set(text or b"", p.shingle, hashes)
            if not len(s):
                continue
            count[i], keys[:, i] = len(s), _set_sums(s)
            least = signature(s, p.bands * p.rows, p.seed).astype(np.uint64)
            band = np.arange(p.bands, dtype=np.uint64)
            for k in least.reshape(p.bands, p.rows).T:
                band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + k)
            bands[i] = band
            nibbles = (_mix(least) & np.uint64(15)).reshape(len(SKETCH), 16)
            sketch[i] = np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)
        lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * p.bands, p.bands, dtype=np.int32),
                                         pa.array(bands.view(np.int64).ravel()))
        longs = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (*keys, *sketch.T)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), *longs[:2], lists, *longs[2:]],
                                         names=["doc_id", "n_shingles", "h1", "h2", "bands", *SKETCH])


def _sets(batches: Iterator[pa.RecordBatch], p: NearDedup) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in in_parts(batches):
        sets = [shingle_set(t or b"", p.shingle, hashes).view(np.int64)
                for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
        keys = np.array([_set_sums(s.view(np.uint64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                                          pa.ListArray.from_arrays(ends, values)], names=["v", "h1", "h2", "items"])


def sketches(docs: DataFrame, p: NearDedup, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Set size, two keys of the whole set, band keys and a sketch of 4 bits a coordinate for every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.dtypes[0][1]
    longs = ", ".join(f"{c} bigint" for c in SKETCH)
    return rows.mapInArrow(lambda it: _sketches(it, p),
                           f"doc_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, {longs}")


def _agreeing(a: str, b: str) -> Column:
    """In how many coordinates two sketches agree: 16 nibbles a long, nibbles of their xor that are zero."""
    def differing(c: str) -> Column:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(
            F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(16 * len(SKETCH)) - reduce(lambda x, y: x + y, map(differing, SKETCH))


def _promising(pairs: DataFrame, classes: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out, with their agreement."""
    said = lambda c: classes.select(F.col("rep").alias(c), F.struct("n_shingles", *SKETCH).alias(f"of_{c}"))
    n, m = F.col("of_a.n_shingles"), F.col("of_b.n_shingles")
    return (pairs.join(said("a"), "a").join(said("b"), "b")
            .filter(F.least(n, m) * 100 >= F.greatest(n, m) * p.percent)
            .select("a", "b", _agreeing("of_a", "of_b").alias("agreeing"))
            .filter(F.col("agreeing") >= p.least_agreeing))


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs whose full sets are similar enough: each pair brings its two sets together once."""
    one = sets.select(F.col("v").alias("a"), F.col("items").alias("in_a"))
    two = sets.select(F.col("v").alias("b"), F.col("items").alias("in_b"))
    both = F.size(F.array_intersect("in_a", "in_b")).cast("long")
    union = F.size("in_a").cast("long") + F.size("in_b") - F.col("both")
    return (pairs.join(one, "a").join(two, "b").withColumn("both", both)
            .filter(F.col("both") * 100 >= union * p.percent).select("a", "b"))


def _labelled(column: str, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the component of one of their columns; a representative without links is its own component."""
    found = labels.select(F.col("vertex").alias(column), F.col("label").alias("found"))
    return rows.join(found, column, "left").withColumn(f"c_{column}", F.coalesce("found", column)).drop("found")


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    return _labelled("b", _labelled("a", pairs, labels), labels).filter("c_a <> c_b").drop("c_a", "c_b")


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; rows of linked texts share a component.

    ``component_id`` is the smallest id that links reach, kept says whether a row has it. A null or wordless text
    has no shingles, no links and is its own component; fewer words than a shingle count as one shingle. Rows
    with a null id stay apart in their own component (null) and are kept. Repeated ids and repeated rows fall
    into one component, with all that any of their texts is linked to, and all carry its decision. An empty table
    gives no rows.

    A representative is the smallest id of its class. Where an id has several texts it may stand for several classes:
    it is then one vertex with several sets.
    """
    said = stage(sketches(docs, p, text, doc_id), "sketches")
    live = said.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(live.groupBy("n_shingles", "h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")).withColumn("key", _set_key()), "classes")
    named = stage(live.join(classes.select("n_shingles", "h1", "h2", F.col("rep").alias("doc_id"), "rep"),
                            ["n_shingles", "h1", "h2", "doc_id"])
                  .select("rep", "n_shingles", "h1", "h2", "bands", *SKETCH).dropDuplicates(["rep", "h1", "h2"]), "representatives")
    ties = _ties(live, classes)

    members = named.select("rep", F.explode("bands").alias("bucket"))
    hubs = stage(members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).filter("m > 1"), "hubs")
    shared = stage(members.join(hubs, "bucket"), "shared")
    pairs = shared.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = stage(_promising(stage(pairs, "pairs"), named, p), "promising")
    labels = _linked(docs, pairs, p, text, doc_id)

    # Members of a bucket outside its commonest component may be linked with any other member.
    placed = stage(_labelled("rep", shared.filter("m > 2"), labels).select("bucket", "rep", "c_rep"), "placed")
    more = stage(_leftover_links(docs, placed, named, p, text, doc_id), "leftover")
    if not more.isEmpty() or not ties.isEmpty():
        known = labels.filter("vertex <> label").select(F.col("vertex").alias("a"), F.col("label").alias("b"))
        labels = component_labels(known.unionByName(more).unionByName(ties))

    final = _labelled("rep", classes.select("key", "rep", "copies"), labels)
    final = stage(final.select("key", F.col("c_rep").alias("component_id"), "copies"), "components")
    rows = live.select("doc_id", "n_shingles", _set_key().alias("key"))
    found = attach_groups(rows, final, "key", "copies", said.count()).select("doc_id", "n_shingles", "component_id")
    alone = said.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ties(live: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b), staged, between the representatives of all classes that one id has texts in."""
    whole = F.xxhash64("n_shingles", "h1", "h2")
    several = stage(live.groupBy("doc_id").agg(F.min(whole).alias("one"), F.max(whole).alias("other"), F.count("*").alias("n"))
                    .filter("one <> other").select("doc_id", "n"), "several")
    if several.isEmpty():
        return live.sparkSession.createDataFrame([], f"a {dict(live.dtypes)['doc_id']}, b {dict(live.dtypes)['doc_id']}")
    rows = attach_groups(live.select("doc_id", _set_key().alias("key")), several, "doc_id", "n", live.count())
    rows = stage(rows.select("doc_id", "key").distinct(), "texts")
    keyed = stage(attach_groups(rows, classes.select("key", "rep", "copies"), "key", "copies", rows.count())
                  .select("doc_id", "rep"), "keyed")
    least = stage(keyed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("n")), "least")
    return stage(attach_groups(keyed, least, "doc_id", "n", keyed.count()).select("a", F.col("rep").alias("b"))
                 .filter("a <> b").distinct(), "ties")


def _leftover_links(docs: DataFrame, placed: DataFrame, named: DataFrame, p: NearDedup, text: str, doc_id: str) -> DataFrame:
    """Links (a, b) between documents of different components that share a bucket, one of them at least being
    outside the commonest component of that bucket.

    Buckets with the same commonest component form a cluster, so a pair in many buckets is met once. The outsiders of
    a cluster and all its members are dealt in blocks, each pair of blocks to one bounded group, which yields only
    the links it finds, the first for each component that an outsider is linked to.
    """
    shares = placed.groupBy("bucket", "c_rep").agg(F.count("*").alias("n"))
    open_buckets = stage(shares.groupBy("bucket").agg(
        F.max_by("c_rep", F.struct("n", "c_rep")).alias("cluster"), F.count("*").alias("parts")).filter("parts > 1"), "open")
    members = stage(placed.join(open_buckets.select("bucket", "cluster"), "bucket").select(
        "cluster", "rep", "c_rep", (F.col("c_rep") != F.col("cluster")).alias("out")).distinct(), "members")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    sizes = stage(members.groupBy("cluster").agg(
        blocks(F.count_if("out"), OUTSIDERS).alias("n_out"), blocks(F.count("*"), MEMBERS).alias("n_all")), "sizes")
    dealt = members.join(sizes, "cluster")
    deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.filter("out").select("cluster", "rep", "c_rep", F.lit(True).alias("asks"), "out", deal(F.col("n_out")).alias("o"), every("n_all").alias("m"))
    asked = dealt.select("cluster", "rep", "c_rep", F.lit(False).alias("asks"), "out", every("n_out").alias("o"), deal(F.col("n_all")).alias("m"))
    sets = _sets_of(docs, members.select(F.col("rep").alias("v")).distinct(), p, text, doc_id)
    known = stage(sets.withColumnRenamed("v", "rep").join(named.select("rep", "h1", "h2", *SKETCH), ["rep", "h1", "h2"])
                  .drop("h1", "h2"), "known")
    rows = stage(asking.unionByName(asked), "dealt").join(known, "rep")
    kind = dict(named.dtypes)["rep"]
    return rows.groupBy("cluster", "o", "m").applyInArrow(lambda t: _block_links(t, p), f"a {kind}, b {kind}").distinct()


def _block_links(table: pa.Table, p: NearDedup) -> pa.Table:
    """Links between the asking rows of a pair of blocks and the others, by sketches first and then by full sets."""
    reps, comps = table.column("rep").to_pylist(), table.column("c_rep").to_pylist()
    asks, out = (np.array(table.column(c).to_pylist(), bool) for c in ("asks", "out"))
    sketch = np.stack([table.column(c).to_numpy().view(np.uint64) for c in SKETCH])
    lists = table.column("items").combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    sets = [values[i:j] for i, j in zip(ends[:-1], ends[1:])]
    sizes = np.diff(ends).astype(np.int64)
    others, links = np.flatnonzero(~asks), []
    for i in np.flatnonzero(asks).tolist():
        x = sketch[:, others] ^ sketch[:, i, None]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        agreeing = 16 * len(SKETCH) - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=0, dtype=np.int64)
        near = np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * p.percent
        chosen = np.flatnonzero((agreeing >= p.least_agreeing) & near)
        joined = {comps[i]}
        for j in others[chosen[np.argsort(-agreeing[chosen], kind="stable")]].tolist():
            if comps[j] in joined or (out[j] and reps[j] < reps[i]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * 100 >= (sizes[i] + sizes[j] - both) * p.percent:
                joined.add(comps[j])
                links.append((reps[i], reps[j]))
    kind = table.schema.field("rep").type
    return pa.table({"a": pa.array([a for a, _ in links], kind), "b": pa.array([b for _, b in links], kind)})


def _sets_of(docs: DataFrame, needed: DataFrame, p: NearDedup, text: str, doc_id: str) -> DataFrame:
    """(v, items), staged: the full shingle sets of the documents whose ids are in ``needed``."""
    rows = docs.select(F.col(doc_id).alias("v"), F.col(text).cast("string").alias("text")).filter("text is not null")
    kind = rows.dtypes[0][1]
    return stage(rows.join(stage(needed, "needed"), "v", "left_semi").mapInArrow(
        lambda it: _sets(it, p), f"v {kind}, h1 bigint, h2 bigint, items array<bigint>").dropDuplicates(["v", "h1", "h2"]), "sets")


def _set_key() -> Column:
    """One key of a whole set: its size and two sums over its shingles."""
    return F.concat_ws(":", "n_shingles", F.hex("h1"), F.hex("h2"))


def _linked(docs: DataFrame, pairs: DataFrame, p: NearDedup, text: str, doc_id: str) -> DataFrame:
    """Components after confirming pairs: first the most promising pair of each document, then those still open."""
    spark = docs.sparkSession
    kind = pairs.dtypes[0][1]
    if pairs.isEmpty():
        return spark.createDataFrame([], f"vertex {kind}, label {kind}")
    sets = _sets_of(docs, pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct(), p, text, doc_id)
    best = pairs.groupBy("b").agg(F.max_by("a", "agreeing").alias("a")).select("a", "b")
    best = stage(best, "best")
    links = stage(_confirmed(best, sets, p), "links")
    labels = component_labels(links)
    open_pairs = stage(_crossing(pairs.select("a", "b"), labels).join(best, ["a", "b"], "left_anti"), "open")
    if open_pairs.isEmpty():
        return labels
    return component_labels(stage(links.unionByName(_confirmed(open_pairs, sets, p)), "links"))


def drop_near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), text: str = "text",
                         doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``; rows repeating its id stay too."""
    gone = near_duplicates(docs, p, text, doc_id).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    whole = carry(docs, __id=F.col(doc_id))
    return unpack(whole.join(stage(gone, "gone"), F.col("__id") == F.col("gone"), "left_anti"))
