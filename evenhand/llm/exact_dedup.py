"""Exact duplicates by a persistent digest index, bucketed and sorted by hash.

Only narrow rows (id, digest) are shuffled to build and query the index. A batch of new documents meets the
index in a sort-merge anti-join that reads the index bucket by bucket without shuffling it; the digests that it
lacks are appended to its buckets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.common import attach_groups, carry, text_of, unpack
from evenhand.plans.runtime import scratch_path, stage


class DigestIndex:
    """One row for each digest ever appended: which document stays for it, and how many rows its batch had.

    ``path`` lies in a folder that all executors share. A later session opens the same path again, with the
    number of buckets it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Named by the whole path, so that folders of one name in different places are different indexes.
        self.table = "digest_index_" + hashlib.sha256(self.path.rstrip("/").encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id {id_type}, keep_row BIGINT, "
                  f"group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Add the groups whose digest the index lacks; adding the same groups again changes nothing."""
        fresh = groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "keep_row", "group_size").repartition(self.buckets, "digest").write.insertInto(
            self.table)

    def close(self) -> None:
        """Forget the table's name. The files stay, and the same path opens them again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, row): SHA-256 of each whole text in UTF-8, null as empty; ``row`` tells repeated rows apart."""
    return stage(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.encode(text_of(text), "UTF-8"), 256).alias("digest"))
                 .withColumn("row", F.monotonically_increasing_id()), "digests")


def duplicate_groups(rows: DataFrame, *by: str) -> DataFrame:
    """Of each digest (and ``by``) the largest id, one of its rows, and the number of rows; combined on the map side."""
    return rows.groupBy(*by, "digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"),
        F.count("*").alias("group_size"))


def _decisions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What the staged groups ``known`` say of each row."""
    found = attach_groups(rows, known, "digest", "group_size", rows.count())
    return found.select("doc_id", "digest", "keep_id", "group_size", "row",
                        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """Say of every row which row of equal text stays: (doc_id, digest, keep_id, group_size, kept).

    The row with the largest id stays; of rows that repeat this id too, exactly one. Null texts count as empty,
    rows with a null id stay only if no row of their text has one. With an ``index`` of earlier batches, rows
    whose text it holds are dropped in favour of the document it names. An empty table gives no rows, and columns
    other than the two named are not looked at.
    """
    rows = digests(docs, text, doc_id)
    groups = stage(duplicate_groups(rows), "groups")
    if index is None:
        index = DigestIndex(docs.sparkSession, id_type=docs.select(doc_id).dtypes[0][1])
        index.append(groups)
        known = index.rows()
    else:
        before = index.rows().select("digest", F.col("keep_id").alias("old_id"))
        known = stage(groups.join(before, "digest", "left").select(
            "digest", F.coalesce("old_id", "keep_id").alias("keep_id"),
            F.when(F.col("old_id").isNull(), F.col("keep_row")).alias("keep_row"), "group_size"), "known")
        index.append(groups)
    return _decisions(rows, known)


def duplicates_by_batch(docs: DataFrame, number: int = 3, path: str | None = None, text: str = "text",
                        doc_id: str = "doc_id") -> DataFrame:
    """As ``exact_duplicates`` without an index, with the rows appended to a new index at ``path`` in batches.

    The batches are ranges of id of like sizes, the largest ids first and null ids last, so what the index holds is
    what stays. Each batch opens the index anew from its path, is deduplicated against it, and closes it. Ids are
    numbers; an empty table gives no rows.
    """
    spark, id_type = docs.sparkSession, docs.select(doc_id).dtypes[0][1]
    rows = digests(docs, text, doc_id)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / number for k in range(1, number)]).alias("at")).first()["at"] or []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.coalesce(F.col("doc_id") <= cut, F.lit(True)).cast("int")
    groups = stage(duplicate_groups(rows.withColumn("batch", batch), "batch"), "groups")
    path = path or scratch_path(spark, "digest-index")
    for k in range(len(cuts) + 1):
        index = DigestIndex(spark, path, id_type=id_type)
        index.append(groups.filter(F.col("batch") == k))
        index.close()
    index = DigestIndex(spark, path, id_type=id_type)
    sizes = groups.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    known = stage(index.rows().drop("group_size").join(sizes, "digest"), "known")
    index.close()
    return _decisions(rows, known)


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, text: str = "text",
                          doc_id: str = "doc_id") -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with the columns of ``docs``.

    Rows meet the decisions by digest and id together, so a text with many copies does not gather in one task.
    """
    found = exact_duplicates(docs, index, text, doc_id)
    kept = found.filter("kept").select("digest", F.col("keep_id").alias("doc_id"))
    whole = carry(docs, doc_id=F.col(doc_id), digest=F.sha2(F.encode(text_of(text), "UTF-8"), 256))
    renamed = kept.select(F.col("digest").alias("k"), F.col("doc_id").alias("i"))
    left = whole.join(renamed, (F.col("digest") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    again = stage(found.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")) )
                  .select("digest", "doc_id").distinct(), "repeated")
    if again.isEmpty():
        return unpack(left)
    same = again.select(F.col("digest").alias("k"), F.col("doc_id").alias("i"))
    on = (F.col("digest") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i"))
    once = left.join(same, on, "left_semi").dropDuplicates(["digest"])
    return unpack(left.join(same, on, "left_anti").unionByName(once))
