"""Each stage of the pipeline against a plain rebuild of it."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from evenhand.llm import queries
from evenhand.llm.bpe import BytePairs, read_ranks
from evenhand.llm.common import in_parts
from evenhand.plans.runtime import stage
from tests.llm.test_operators import plain_components, plain_measures

SF = "/root/testdata/sf0.001"


def test_stages_on_small_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, steps = zip(*corpus_pipeline.STAGES)
    quality, exact, near, mix, encode = steps
    rows = {r.doc_id: r for r in docs.collect()}

    def kept(df):
        assert sorted(df.columns) == sorted(docs.columns)
        return sorted(r.doc_id for r in df.collect())

    one = quality(spark, docs, SF)
    first = [i for i, r in rows.items() for n in [plain_measures(r.text or "")] if n[0] >= 20 and (n[5] is None or 100 * n[5] <= 30 * n[0])]
    assert kept(one) == sorted(first)
    two = exact(spark, docs, SF)
    groups = {}
    for i, r in rows.items():
        groups.setdefault(hashlib.sha256((r.text or "").encode()).digest(), []).append(i)
    assert kept(two) == sorted(map(max, groups.values()))
    three = near(spark, docs, SF)
    assert kept(three) == sorted(i for i, (_, c) in plain_components([(i, r.text or "") for i, r in rows.items()], 5).items() if i == c)
    four = kept(mix(spark, docs, SF))
    assert {four.count(i) for i in rows} <= {0, 1, 2} and len(four) > len(rows)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        t: i for i, t in enumerate(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))})
    for r in encode(spark, docs, SF).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(rows[r.doc_id].text or "")


def test_run_keeps_whole_texts_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "source", "n_tokens", "ids"}


def test_encoding_keeps_the_order_of_many_part_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, SF)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 13)
    try:
        mixed.write.parquet(f"{tmp_path}/mixed")
        wanted = [r.doc_id for r in mixed.select("doc_id").collect()]
        # The part that comes last is the largest, so a plain scan reads it first.
        more = docs.limit(60).coalesce(1).write.option("maxRecordsPerFile", 0)
        more.parquet(f"{tmp_path}/more")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    last = next((tmp_path / "more").glob("part-*"))
    (tmp_path / "mixed" / "part-100000-0a-c000.snappy.parquet").write_bytes(last.read_bytes())
    wanted += [r.doc_id for r in docs.limit(60).collect()]
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 8
    coded = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).collect()
    assert sorted(r.position for r in coded) == list(range(len(wanted)))
    assert [r.doc_id for r in sorted(coded, key=lambda r: r.position)] == wanted
    assert [r.doc_id for r in coded] != wanted


def test_run_returns_rows_by_position_in_training(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(corpus_pipeline, "stage", lambda df, name: steps.append(stage(df.repartition(3) if name == "encoding" else df, name)) or steps[-1])
    out = [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()]
    named = [r.doc_id for r in steps[-1].orderBy("position").collect()]
    assert out == named and len(set(out)) > 1


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.REGISTRY) == list(range(1, 11))


def test_encoding_holds_a_few_megabytes_of_a_batch(spark):
    pairs = BytePairs(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = pa.array([f"word {i} and more \u00fc words {i * i}" * 40 for i in range(10_000)] + [None, ""], pa.string())
    parts = list(pairs._streamed.func(iter([texts, texts.slice(0, 0)])))
    assert max(len(p) for p in parts) < len(texts) / 2 and max(p.nbytes for p in parts) < 12 << 20
    assert pa.concat_arrays(parts).equals(pairs._encode.func(texts)) and parts[-2][-1].as_py() == b""
    assert [len(p) for p in in_parts([texts], 1)] == [1] * len(texts)
