"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import (bpe, exact_dedup, mixing, near_dedup, negatives, ngram_join, pii, quality, repair, secrets, token_files,
                          toxicity, url_filter)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op5_exact_dedup(spark, sf):
    found = exact_dedup.duplicates_by_batch(documents(spark, sf))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query
def op10_near_dedup(spark, sf):
    return near_dedup.near_duplicates(documents(spark, sf), near_dedup.NearDedup(shingle=4))


SIMILAR = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < SIZE THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i+SIZE-1], ' ') FOR i IN range(1, len(w) - SIZE + 2)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN least USING (doc_id)"""
ORACLES["op10_near_dedup"] = "SELECT *, doc_id = component_id AS kept FROM (" + SIMILAR.replace("SIZE", "4") + ")"


@query
def op13_ngram_join(spark, sf):
    return ngram_join.similar_documents(documents(spark, sf))


ORACLES["op13_ngram_join"] = SIMILAR.replace("SIZE", "5")


@query
def op2_token_orc(spark, sf):
    path = token_files.token_path(spark)
    token_files.write_tokens(documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", token_files.checksum().alias("ids_crc32"))


@query
def op7_byte_bpe(spark, sf):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode_documents(bpe.encode_documents(documents(spark, sf), *vocabulary), *vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_host_quality(spark, sf):
    found = quality.judge_quality(documents(spark, sf))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        F.round("rate", 6).alias("host_rate"), "kept")


ORACLES["op6_host_quality"] = """
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')] AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i:i+7] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM m),
h AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS x FROM j GROUP BY source),
s AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(x) / sum(n) AS p, CAST(sum(n * n) AS DOUBLE) AS nn, sum(x * x / n) AS xx FROM h),
f AS (SELECT p, (xx - n * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * (n - nn / n - (k - 1))) AS alike FROM s),
r AS (SELECT source, CASE WHEN alike <= 0 THEN p ELSE (x + p * (1 / least(alike, 1) - 1)) / (n + 1 / least(alike, 1) - 1) END AS rate FROM h, f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
       NOT base_failed AND rate <= 0.5 AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source"""


@query
def op9_curriculum_mix(spark, sf):
    found = mixing.mix(documents(spark, sf))
    return found.select("doc_id", "size", "source_size", "target", "taken",
                        F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.lit(1)).alias("second_position"))


ORACLES["op9_curriculum_mix"] = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS size,
         md5('mix:' || doc_id) AS h FROM documents),
src AS (
  SELECT source, place, [5.0::DOUBLE, 2.0, 1.0][place % 3 + 1] AS weight, n AS source_size, CAST(2 * n AS DOUBLE) AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
        FROM sized GROUP BY source)),
turns AS (
  SELECT 0 AS turn, -1::BIGINT AS filled, 0.0::DOUBLE AS level
  UNION ALL
  SELECT turn + 1, count(*) FILTER (cap <= level * weight),
         ((SELECT sum(source_size) FROM src) * 1.5::DOUBLE - coalesce(sum(cap) FILTER (cap <= level * weight), 0))
         / sum(weight) FILTER (cap > level * weight)
  FROM turns, src GROUP BY turn, filled, level HAVING count(*) FILTER (cap <= level * weight) > filled),
targets AS (
  SELECT source, place, source_size, least(cap, weight * (SELECT arg_max(level, turn) FROM turns)) AS target FROM src),
placed AS (
  SELECT doc_id, size, place, source_size, target, floor(target / source_size) AS rounds,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(2, rounds + CAST(before + size / 2 < target - rounds * source_size AS INT)) END AS copies
  FROM placed),
shares AS (
  SELECT *, CASE WHEN copies > 0 THEN least(1, (before + size / 2) / target) END AS one,
         CASE WHEN copies > 1 THEN least(1, (source_size + before + size / 2) / target) END AS two FROM taken)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       round(DUE(one), 9) AS position, round(DUE(two), 9) AS second_position
FROM shares"""
for _c in ("one", "two"):
    ORACLES["op9_curriculum_mix"] = ORACLES["op9_curriculum_mix"].replace(f"DUE({_c})", f"""CASE
         WHEN place % 3 = 0 THEN 2 * {_c} / (1.5 + sqrt(2.25 - 2 * {_c}))
         WHEN place % 3 = 1 THEN {_c}
         WHEN {_c} < 0.3125 THEN 2 * {_c} / (0.25 + sqrt(0.0625 + 3 * {_c}))
         ELSE 0.5 + 2 * ({_c} - 0.3125) / (1 + sqrt(1 + 3 * ({_c} - 0.3125))) END""")


URL_RULES = (url_filter.UrlRule("allow", "org", "/"), url_filter.UrlRule("block", "example.org", "/es/"),
             url_filter.UrlRule("block", "example.org", "/en/1"), url_filter.UrlRule("allow", "com", "/fr/"),
             url_filter.UrlRule("block", "com", "/de/"))
# Parts of host names that put a host of the corpus on the list.
HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


@query
def op4_url_cascade(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return url_filter.judge_urls(pages, URL_RULES, url_filter.hosts_with_words(pages, HOST_WORDS))


ORACLES["op4_url_cascade"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict,
       CASE WHEN regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)"""


def joined_spans(spans, kinds=None):
    """kind:start:end of the spans, or of those of some kinds, joined by commas."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query
def op3_personal_data(spark, sf):
    spans, base = F.col("spans"), ("email", "ip", "card", "phone")
    found = pii.personal_data(documents(spark, sf))
    return found.select("doc_id", *[counted(spans, k) for k in base], counted(spans, "iban"),
                        F.sha2(joined_spans(spans, base), 256).alias("base_sha256"), joined_spans(spans).alias("spans"),
                        F.transform(spans, lambda s: s["score"]).alias("scores"))


@query
def op1_secrets(spark, sf):
    spans, base = F.col("spans"), secrets.PATTERN_KINDS
    found = secrets.scan_secrets(documents(spark, sf))
    return found.select("doc_id", *[counted(spans, k) for k in secrets.KINDS],
                        F.sha2(joined_spans(spans, base), 256).alias("base_sha256"), joined_spans(spans).alias("spans"))


@query
def op8_toxic_spans(spark, sf):
    docs = documents(spark, sf)
    found = toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    offsets = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(offsets, ",").alias("offending"))


@query
def op11_conversation_repair(spark, sf):
    damaged = repair.damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    return repair.repair_conversations(damaged, dropped=F.col("dropped")).withColumnRenamed("conversation", "conv_id")


def _repair_sql() -> str:
    """The same row by row: of each place in a dialogue (start, system, user, pair) the least (cost, audit) is kept."""
    add = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    never = "{'c': 1000000000, 'a': ''}"
    when = lambda condition, x: f"CASE WHEN {condition} THEN {x} ELSE {never} END"
    to_user = least("z", "s", "p2")
    inserted = f"""SELECT *, {least("p", add("u2", 3, "I"))} AS p2 FROM (
      SELECT *, {least("u", add("z", 3, "I"), add("s", 3, "I"), add("p", 3, "I"))} AS u2 FROM %s)"""
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
fated AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(k, lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
repeated AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM numbered),
seen AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][ \\t\\n\\x0B\\f\\r]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM repeated),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS z, {never} AS s, {never} AS u, {never} AS p FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {add("z", 4, "D")}, {least(add("s", 4, "D"), when("free AND initial = 's'", add("z", "more", "K")))},
         {least(add("u2", 4, "D"), when("free AND initial = 'u'", add(to_user, "more", "K")), when("free", add(to_user, "more + 3", "R")))},
         {least(add("p2", 4, "D"), when("free AND initial = 'a'", add("u2", "more", "K")), when("free", add("u2", "more + 3", "R")))}
  FROM ({inserted % """(
    SELECT n.conv_id, n.i, z, s, u, p, n.initial, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more
    FROM paths JOIN seen n ON n.conv_id IS NOT DISTINCT FROM paths.conv_id AND n.i = paths.i + 1)"""})),
best AS (
  SELECT conv_id, {least("z", "p2")} AS b FROM ({inserted % "(SELECT conv_id, arg_max(z, i) AS z, arg_max(s, i) AS s, arg_max(u, i) AS u, arg_max(p, i) AS p FROM paths GROUP BY conv_id)"})),
edits AS (
  SELECT conv_id, unnest(string_split(b.a, '')) AS edit, unnest(range(len(b.a))) AS nth FROM best WHERE b.a <> ''),
taken AS (
  SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER w AS i, sum(CAST(edit <> 'D' AS INT)) OVER w AS place FROM edits
  WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
made AS (
  SELECT e.conv_id, e.nth, e.edit, e.place, n.role, CASE WHEN e.edit = 'I' THEN '' ELSE n.text END AS text,
         max(CAST(e.edit = 'K' AND n.initial = 's' AS INT)) OVER (PARTITION BY e.conv_id) AS led
  FROM taken e LEFT JOIN seen n ON n.conv_id IS NOT DISTINCT FROM e.conv_id AND n.i = e.i WHERE e.edit <> 'D'),
hashed AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY nth)) AS h
  FROM made GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(b.b.c AS BIGINT) AS cost, b.b.a AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN counted c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashed h ON b.conv_id IS NOT DISTINCT FROM h.conv_id"""


ORACLES["op11_conversation_repair"] = _repair_sql()


@query
def op12_hard_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", moved)
    return negatives.mine_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INT) AS rank,
         n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT * FROM ranked WHERE rank <= 10"""
