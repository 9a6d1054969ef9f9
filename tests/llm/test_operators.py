"""The corpus operators against brute force on awkward rows and on the small given documents."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenhand.llm import bpe, exact_dedup, mixing, near_dedup, pii, quality, secrets, token_files, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
RANKS, JSON = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").persist()


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id, str(r)))


def texts(df):
    return [(r.doc_id, r.text or "") for r in by_id(df.select("doc_id", "text"))]


# --- secrets ------------------------------------------------------------------------------------------------

PLAIN = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
                         r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def plain_secrets(text):
    least = {"assign": 8, "access": 16, "hex": 32}
    return sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in p.finditer(text)
                  if len(m[2] if k == "assign" else m[0]) >= least[k])


def test_secret_patterns_equal_plain_matching(small, odd):
    for df in (small, odd):
        for row in secrets.scan_secrets(df).join(df.select("doc_id", "text"), "doc_id").collect():
            found = [(s.start, secrets.KINDS.index(s.kind), s.kind, s.end) for s in row.spans if s.kind in secrets.PATTERN_KINDS]
            assert found == plain_secrets(row.text or "")
    rnd = random.Random(5)
    parts = ["token", "SECRET", "api_key", "=", ":", " ", '"', "abcdefgh", "AKIA", "ABCDEFGHIJKL", "paſſword", "0123456789abcdef" * 2, "é"]
    for _ in range(2000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 12)))
        assert [s for s in secrets.find_secrets(text) if s[2] in secrets.PATTERN_KINDS] == plain_secrets(text)


def tlv(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + content


def test_structures_confirm_candidates():
    import base64
    import json

    rsa = tlv(0x30, tlv(2, b"\0") + tlv(2, b"\1" * 64) * 8)
    text = base64.b64encode(rsa).decode()
    kinds = lambda t: [s[2] for s in secrets.find_secrets(t) if s[2] in secrets.STRUCTURE_KINDS]
    assert kinds(f"key {text} end") == ["der"] == kinds(rsa.hex())
    wrapped = "\n".join(text[i:i + 64] for i in range(0, len(text), 64))
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}\n-----END") == ["der"]
    assert kinds(base64.b64encode(rsa[:-1]).decode()) == kinds("M" * 400) == []
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert kinds(f"Bearer {part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln") == ["jwt"]
    assert kinds(f"{part({'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln") == []
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))
    assert kinds("ssh-ed25519 " + base64.b64encode(ssh).decode()) == ["openssh"]
    assert kinds("ssh-ed25519 " + base64.b64encode(ssh[:-2]).decode()) == []


def test_neighbours_of_a_key_do_not_hide_it():
    import base64

    spans = lambda t: [(s[2], t[s[0]:s[3]]) for s in secrets.find_secrets(t) if s[2] in secrets.STRUCTURE_KINDS]
    string = lambda x: len(x).to_bytes(4, "big") + x
    ed = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"+ep")) + tlv(4, tlv(4, b"k" * 32)))
    assert len(ed) == 48
    keys = [("der", ed)] + [("der", tlv(0x30, tlv(2, b"\0") + tlv(2, b"\1" * (64 + n)) * 8)) for n in (0, 1, 2)]
    keys += [("openssh", string(b"ssh-ed25519") + string(b"k" * (32 + n))) for n in range(3)]
    keys += [("openssh", b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + b"\0\0\0\1" + string(b"p" * 51) + string(b"s" * (130 + n)))
             for n in range(3)]
    assert {len(key) % 3 for _, key in keys} == {0, 1, 2}
    for kind, key in keys:
        plain = base64.b64encode(key).decode()
        for text in {plain, plain.rstrip("=")}:
            for line in ("\n", "\r\n", "\\n", "\\r\\n"):
                for width in (64, 76, len(text)):
                    body = line.join(text[i:i + width] for i in range(0, len(text), width))
                    for before, after in (("", ""), ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"), ("it is", "and then"),
                                          ("", "a_word_of_more_than_sixteen and"), ("Many_letters_of_a_first_word", "x"),
                                          ("", "longer_words_than_sixteen" + line + "longer_words_than_sixteen" + line + "y")):
                        assert spans(before + line + body + line + after) == [(kind, body)], (kind, len(key), line, width, after)
                    assert spans(body + line + body + line + "z") == [(kind, body)] * 2
    assert spans("M" + base64.b64encode(ed).decode()) == spans(base64.b64encode(ed).decode() + "AAAA") == []


def test_many_lines_that_open_like_keys_are_read_once():
    import base64
    import time

    string = lambda x: len(x).to_bytes(4, "big") + x
    kinds = lambda t: [s[2] for s in secrets.find_secrets(t) if s[2] in secrets.STRUCTURE_KINDS]
    opened = base64.b64encode(string(b"ssh-rsa") + string(b"\1\0\1") + b"\0\0\0\xff" + b"k" * 20).decode()
    magic = base64.b64encode(b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + b"\0\0\0\1" + string(b"p" * 9) + b"\0\1").decode()
    for line in (opened, magic.rstrip("="), "AAAAB3NzaC1yc2E" + "A" * 40):
        start = time.process_time()
        assert kinds("\n".join([line] * 10_000)) == []
        assert time.process_time() - start < 8, line
    rsa = base64.b64encode(string(b"ssh-rsa") + string(b"\1\0\1") + string(b"n" * 129)).decode()
    assert kinds("\n".join([opened] * 50 + [rsa])) == ["openssh"]


def test_signed_tokens_behind_a_full_stop():
    import base64
    import json

    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"
    for text in (f"It was said.{token}", f"x.{token} and more", token):
        assert [text[s[0]:s[3]] for s in secrets.find_secrets(text) if s[2] == "jwt"] == [token]
    assert not [s for s in secrets.find_secrets("a" + token) if s[2] == "jwt"]


# --- personal data ------------------------------------------------------------------------------------------

DATA = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(w - 9 * (w > 9) for w in worth) % 10 == 0


def plain_data(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()

    return sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(DATA.items()) for m in p.finditer(text) if valid(k, m[0]))


def test_personal_data_equals_plain_matching(spark, small, odd):
    rnd = random.Random(3)
    made = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0000255.1.2.003", "41111111111111111111111", "a" * 60_000, "1." * 500, "+1" + "(" * 30_000]
    made += ["".join(rnd.choices(["1", "4111", "-", " ", ".", "255", "a", "@", "b.c", "+", "é😀"], k=rnd.randint(0, 40))) for _ in range(300)]
    more = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for df in (small, odd, more):
        for row in pii.personal_data(df).join(df.select("doc_id", "text"), "doc_id").collect():
            found = [(s.start, i, s.kind, s.end) for s in row.spans for i, k in enumerate(DATA) if k == s.kind]
            assert found == plain_data(row.text or "")
            assert all(row.text[s.start:s.end] == s.value and 0 <= s.score <= 1 for s in row.spans)


def test_mod97_and_context(spark):
    rows = [(1, "GB82WEST12345698765432"), (2, "GB83WEST12345698765432"), (3, "my visa card 4111 1111 1111 1111"),
            (4, "order 4111 1111 1111 1111")]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.kind for s in found[1]] == ["iban"] and found[2] == []
    assert found[3][0].score > 0.7 > found[4][0].score


def test_words_and_numbers_after_an_iban_are_no_part_of_it(spark):
    ibans = ["AT611904300234573201", "AT61 1904 3002 3457 3201", "ES9121000418450200051332", "SE4550000000058398257466", "NO9386011117947",
             "NO93 8601 1117 947", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "MT84MALT011000012345MTLCAST001S"]
    after = ["", " EUR 100", " BANK", " 100 euro", " BIC GIBA ATWW", ".", " ABCD EFGH 1234 5678"]
    rows = [(i, b + iban + a) for i, (iban, b, a) in enumerate((x, b, a) for x in ibans for b in ("", "IBAN ", "XY12 CODE 1234 ") for a in after)]
    rows += [(1000, " ".join(ibans)), (1001, "AT611904300234573202 EUR 100"), (1002, "AT611904300234573201EUR 100")]
    found = {r.doc_id: [s.value for s in r.spans if s.kind == "iban"]
             for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found.pop(1000) == ibans and found.pop(1001) == found.pop(1002) == []
    assert [found[i] for i in sorted(found)] == [[x] for x in ibans for _ in range(3 * len(after))]


# --- tokens -------------------------------------------------------------------------------------------------

def test_byte_pairs_equal_the_library_and_decode_back(small, odd):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (small, odd):
        coded = bpe.decode_documents(bpe.encode_documents(df, RANKS, PATTERN), RANKS, PATTERN)
        rows = by_id(coded)
        assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in rows if r.doc_id is not None) == sorted(
            (i, t) for i, t in texts(df) if i is not None)
        for row in rows:
            ids = library.encode_ordinary(bytes(row.decoded).decode())
            assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.n_tokens == len(ids)


def test_pieces_split_like_the_pattern():
    coder = bpe.Coder(bpe.serialise_model(bpe.read_ranks(RANKS)), PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})
    made = ["a  b", "a\n\nb", "a \n b", "\ta　b\x85c \x1c d", "I'm 's 'S don''t", "\n", "a\n", " a", "a ", "x\x00y", "١٢٣ ½ x²",
            "".join(map(chr, range(0x20, 0x2000))), " ".join(map(chr, range(0x21, 0xD800)))]
    for text, ids in zip(made, coder.encoder.encode(made)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_token_files(spark, small, odd, nothing, tmp_path):
    library = Tokenizer.from_file(JSON)
    for n, df in enumerate((small, odd)):
        path = f"{tmp_path}/{n}"
        token_files.write_tokens(df, path, JSON)
        rows = token_files.read_tokens(spark, path).withColumn("crc", token_files.checksum()).collect()
        start = 0
        for row in sorted(rows, key=lambda r: r.start):
            assert row.start == start and row.n_tokens == len(row.ids) and row.ids[-1] == 0
            assert row.crc == zlib.crc32(np.array(row.ids, "<u4").tobytes())
            start += row.n_tokens
        known = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
        assert known == sorted(known) and len(rows) == df.count()
        wanted = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in texts(df) if i is not None}
        assert all(r.ids == wanted[r.doc_id] for r in rows if r.doc_id is not None)
    one = token_files.read_tokens(spark, f"{tmp_path}/0", [7]).collect()
    assert [r.doc_id for r in one] == [7]
    token_files.write_tokens(nothing, f"{tmp_path}/none", JSON)


def test_stripes_and_row_groups_without_the_wanted_ids_are_skipped(spark, tmp_path):
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, JSON)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def scanned(*ids):
            found = spark.read.orc(path).filter(F.col("doc_id").isin(*ids))
            rows = len(found.collect())
            leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
            return rows, leaf.metrics().get("numOutputRows").get().value()

        assert scanned(*range(0, 40_000, 2)[:10_001])[1] >= 10_001
        rows, read = scanned(20_002)
        assert rows == 1 and read <= 1000
        # Odd ids lie between the smallest and the largest of a row group, so only its Bloom filter can tell.
        assert sum(scanned(i)[1] == 0 for i in range(10_001, 10_041, 2)) >= 17
        assert scanned(50_000) == (0, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_special_strings_and_other_tokenizers(spark):
    made = ["a <|endoftext|> b", "<|endoftext|>", "plain words here"]
    coder = token_files.FileTokenizer(open(JSON, encoding="utf-8").read())
    library = Tokenizer.from_file(JSON)
    assert [np.frombuffer(p, "<u4").tolist() for p in coder.encode(made)] == [library.encode(t, add_special_tokens=False).ids for t in made]
    words = public_tokenizers.path("word_bpe_49k.json")
    other, library = token_files.FileTokenizer(open(words, encoding="utf-8").read()), Tokenizer.from_file(words)
    assert other.encoder is None
    assert [np.frombuffer(p, "<u4").tolist() for p in other.encode(made)] == [library.encode(t, add_special_tokens=False).ids for t in made]


# --- urls ---------------------------------------------------------------------------------------------------

def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    for share in (0, 0.001, 0.3, 0.9, 1):
        listed = rng.random(20_000) < share
        assert (url_filter.in_cascade(url_filter.build_cascade(listed, h1, h2), h1, h2) == listed).all()


def test_urls_in_one_and_in_many_blocks(spark, monkeypatch):
    rules = (url_filter.UrlRule("block", "b.com"), url_filter.UrlRule("allow", "b.com", "/ok"), url_filter.UrlRule("block", "org", "/x/"))
    urls = [None, "", "no scheme", "http://", "http://B.com", "http://a.B.com/ok?x", "https://xb.com/", "ftp://q.org/x/y#z", "http://q.org/x",
            "http://bad.net/", "http://sub.bad.net?q", "http://a.b.com/o"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, keys string")
    listed = spark.createDataFrame([("BAD.net",), (None,)], "host string")
    wanted = [("", "", None, "allow")] * 4 + [
        ("b.com", "", "b.com", "block"), ("a.b.com", "/ok", "b.com/ok", "allow"), ("xb.com", "/", None, "allow"),
        ("q.org", "/x/y", "org/x/", "block"), ("q.org", "/x", None, "allow"), ("bad.net", "/", None, "block"),
        ("sub.bad.net", "", None, "block"), ("a.b.com", "/o", "b.com", "block")]
    for keys, size in ((500_000, 32 << 20), (5, 10)):
        monkeypatch.setattr(url_filter, "SHARD_KEYS", keys)
        monkeypatch.setattr(url_filter, "BLOCK_BYTES", size)
        rows = sorted(url_filter.judge_urls(pages, rules, listed).collect())
        assert [tuple(r)[1:] for r in rows] == wanted
    assert url_filter.judge_urls(pages.filter("false"), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.UrlRule("deny", "x")


# --- exact duplicates -----------------------------------------------------------------------------------------

def test_exact_duplicates(odd, nothing):
    rows = by_id(exact_dedup.exact_duplicates(odd))
    groups = {}
    for i, t in texts(odd):
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    for row in rows:
        known = [i for i in groups[row.digest] if i is not None]
        assert row.group_size == len(groups[row.digest]) and row.keep_id == (max(known) if known else None)
    assert sum(r.kept for r in rows) == len(groups)
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(groups)
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_digest_index_across_batches(spark, odd):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first, second = odd.filter("doc_id < 9"), odd
    one = exact_dedup.exact_duplicates(first, index)
    kept = {r.doc_id for r in one.collect() if r.kept}
    size = index.rows().count()
    two = exact_dedup.exact_duplicates(second, index).collect()
    assert size == len(kept)
    assert not any(r.kept for r in two if r.doc_id is not None and r.doc_id < 9)
    assert index.rows().count() == size + sum(r.kept for r in two)
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    assert again.rows().count() == index.rows().count()


def test_batches_through_a_reopened_index(spark, small, odd, nothing):
    fields = ("doc_id", "digest", "keep_id", "group_size")
    for docs in (small, odd):
        whole = exact_dedup.exact_duplicates(docs).collect()
        path = exact_dedup.scratch_path(spark, "batches")
        parts = exact_dedup.duplicates_by_batch(docs, 3, path).collect()
        assert Counter(tuple(r[f] for f in fields) for r in parts) == Counter(tuple(r[f] for f in fields) for r in whole)
        kept = Counter(r.digest for r in parts if r.kept)
        assert set(kept.values()) == {1} and set(kept) == {r.digest for r in whole}
        assert all(r.doc_id == r.keep_id for r in parts if r.kept)
        # The catalogue entry is gone, the files are not.
        assert exact_dedup.DigestIndex(spark, path).rows().count() == len(kept)
    assert exact_dedup.duplicates_by_batch(nothing).count() == 0


def test_indexes_of_one_name_in_two_folders(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    one, two = (exact_dedup.DigestIndex(spark, f"{tmp_path}/{n}/idx", buckets=2) for n in ("one", "two"))
    exact_dedup.exact_duplicates(docs.filter("doc_id < 2"), one).collect()
    assert one.rows().count() == 1 and two.rows().count() == 0
    assert {r.doc_id for r in exact_dedup.exact_duplicates(docs, two).collect() if r.kept} == {2, 3}


# --- quality --------------------------------------------------------------------------------------------------

def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)} if len(words) < 2500 else None
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)),
            len(covered) if covered is not None else None)


def test_quality_measures(small, odd, nothing):
    for df in (small.limit(60), odd):
        known = dict(texts(df))
        for row in quality.judge_quality(df).collect():
            wanted = plain_measures(known[row.doc_id])
            for name, value in zip(quality.MEASURES, wanted):
                assert value is None or row[name] == value, (row.doc_id, name)
            assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
    left = quality.drop_low_quality(odd)
    judged = quality.judge_quality(odd)
    assert left.columns == odd.columns and left.count() == judged.filter("kept").count()
    assert quality.judge_quality(nothing).count() == 0 and quality.drop_low_quality(nothing).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    rows = [("bad", 1)] * 95 + [("bad", 0)] * 5 + [(f"h{i % 20}", int(i % 50 == 0)) for i in range(2000)] + [("tiny", 1), (None, 0)]
    rates = {r.host: r.rate for r in quality.host_rates(spark.createDataFrame(rows, "host string, failed int")).collect()}
    assert rates["bad"] > 0.8 and rates["h1"] < 0.1 and rates["tiny"] < 0.9 and rates[None] is not None
    same = quality.host_rates(spark.createDataFrame([("a", 1), ("b", 0)], "host string, failed int")).collect()
    assert len({r.rate for r in same}) <= 2 and all(0 <= r.rate <= 1 for r in same)


# --- mixing ---------------------------------------------------------------------------------------------------

def test_mix_reaches_targets_and_reruns_agree(small):
    rows = by_id(mixing.mix(small))
    assert rows == by_id(mixing.mix(small.repartition(5)))
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", dict(texts(small))[r.doc_id])) and r.taken <= 2 * r.size
        assert len(r.positions) == (r.taken // r.size if r.size else 0) and all(0 <= p <= 1 for p in r.positions)
    for found in sources.values():
        assert abs(sum(r.taken for r in found) - found[0].target) <= max(r.size for r in found)
        assert found[0].target <= 2 * found[0].source_size and found[0].source_size == sum(r.size for r in found)
    assert sum(f[0].target for f in sources.values()) == pytest.approx(1.5 * sum(r.size for r in rows))


def test_schedules_are_inverted(spark):
    c = mixing.Curriculum()
    shares = spark.range(101).select((F.col("id") / 100).alias("x"))
    for place, knots in enumerate(c.schedules):
        found = shares.select("x", mixing._due(F.col("x"), F.lit(place), c).alias("t")).collect()
        grid = np.linspace(0, 1, 100_001)
        heights = np.interp(grid, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((heights[1:] + heights[:-1]) / 2)]) / len(grid)
        for r in found:
            assert r.t == pytest.approx(np.interp(r.x * area[-1], area, grid), abs=1e-4)


def test_mix_of_awkward_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.arrange(odd).columns == odd.columns
    assert mixing.mix(nothing).count() == 0 and mixing.arrange(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.Curriculum(share=3.0)


def test_rows_without_an_id_or_of_one_id_follow_their_own_decision(spark):
    rows = [(None, f"some words of row {i} " * (1 + i % 3), "ab"[i % 2], i) for i in range(30)]
    rows += [(7, f"words {i} of the same id", "a", i) for i in range(10)] + [(8, "alike in every column", "b", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark long")
    mixed = mixing.mix(docs).collect()
    taken, found = {}, {}
    for r in mixed:
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    arranged = mixing.arrange(docs)
    assert arranged.columns == docs.columns
    counts = {}
    for r in arranged.collect():
        counts[r] = counts.get(r, 0) + 1
        found[r.doc_id, r.source] = found.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert found == {k: n for k, n in taken.items() if n}
    assert all(n <= 2 * rows.count(tuple(r)) for r, n in counts.items())
    assert mixing.arrange(docs.repartition(5)).collect() == arranged.collect()


# --- near duplicates --------------------------------------------------------------------------------------------

def plain_components(pairs, size):
    sets = {}
    for i, t in pairs:
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1)))}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def variants(seed, copies, words=120):
    """Copies of one text with more and more words changed, so that some are linked only through others."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(copies):
        text = list(base)
        for _ in range(k % 9):
            text[rnd.randrange(words)] = f"v{rnd.randrange(40)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, size):
    made = [t for seed in range(3) for t in variants(seed, 60)] + ["", "a b", "A b", "a b c d", "a b c d e"]
    docs = spark.createDataFrame([(i * 7 % 1000, t) for i, t in enumerate(made)], "doc_id long, text string")
    wanted = plain_components([(i * 7 % 1000, t) for i, t in enumerate(made)], size)
    rows = near_dedup.near_duplicates(docs, near_dedup.NearDedup(shingle=size)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_an_id_with_several_texts_links_all_of_them(spark):
    words = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    near = lambda c: words(c) + " end"
    rows = [(5, words("a")), (5, words("b")), (11, near("a")), (12, near("b")), (9, words("c")), (20, words("c")), (20, words("d")),
            (30, near("d")), (40, words("e"))]
    # An id of many texts, each with a near copy, and one whose texts are linked through others only.
    rows += [(100, words(f"m{i}-")) for i in range(20)] + [(200 + i, near(f"m{i}-")) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, docs.repartition(7)):
        label = {(r.doc_id): r.component_id for r in near_dedup.near_duplicates(df).collect()}
        assert label == {5: 5, 11: 5, 12: 5, 9: 9, 20: 9, 30: 9, 40: 40, 100: 100, **{200 + i: 100 for i in range(20)}}


def test_near_duplicates_of_awkward_rows(odd, nothing):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (12, 13)} == {12}
    assert all(r.n_shingles == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert near_dedup.drop_near_duplicates(odd).columns == odd.columns
    assert near_dedup.near_duplicates(nothing).count() == 0


# --- toxicity -----------------------------------------------------------------------------------------------------

def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    e, chain = rng.normal(size=(3, 6)), (0.5, -0.4, 0.1, 0.9)
    p, pairs = toxicity.marginals(e, chain)
    seen = np.zeros(4)
    for row in range(3):
        paths = list(product((0, 1), repeat=6))
        weight = np.exp([sum(e[row, t] * y[t] for t in range(6)) + sum(chain[2 * a + b] for a, b in zip(y, y[1:])) for y in paths])
        weight /= weight.sum()
        assert p[row] == pytest.approx([sum(w for w, y in zip(weight, paths) if y[t]) for t in range(6)])
        for w, y in zip(weight, paths):
            for a, b in zip(y, y[1:]):
                seen[2 * a + b] += w
    assert pairs == pytest.approx(seen)


def test_held_out_accuracy_and_offsets(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.Training(steps=15))
    scored = toxicity.score_documents(docs, model)
    held = scored.filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hits = sum(r.predicted for r in held if r.toxic)
    assert hits >= 0.8 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.01 * len(held)
    told = scored.filter("size(spans) > 0").join(docs.select("doc_id", "text"), "doc_id").limit(50).collect()
    assert all(r.text[s.start:s.end].strip() == r.text[s.start:s.end] != "" for r in told for s in r.spans)


def test_toxicity_without_labels_and_on_awkward_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(i, int(i % 2)) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd, toxicity.fit(odd, some, toxicity.Training(steps=3))).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(nothing, model).count() == 0


def test_chains_run_through_whole_texts():
    rng = np.random.default_rng(4)
    chain = (0.5, -1.4, 0.1, 1.9)
    texts = [rng.normal(size=n) * 3 for n in (0, 1, 49, 50, 51, 100, 101, 7, 333, 2)] + [np.full(120, 900.0), np.full(60, -900.0)]
    found, pairs = toxicity.marginals(texts, chain)
    seen = np.zeros((2, 2))
    for e, p in zip(texts, found):
        says, step = np.stack([np.zeros(len(e)), e]), np.reshape(chain, (2, 2))
        a, b = says.copy(), np.zeros((2, len(e)))
        for t in range(1, len(e)):
            a[:, t] += np.logaddexp(*(a[:, t - 1, None] + step))
        for t in range(len(e) - 2, -1, -1):
            b[:, t] = np.logaddexp(*(step + says[:, t + 1] + b[:, t + 1]).T)
        assert p == pytest.approx(np.exp(a[1] + b[1] - np.logaddexp(*(a + b))))
        for t in range(1, len(e)):
            both = a[:, t - 1, None] + step + says[:, t] + b[:, t]
            seen += np.exp(both - np.logaddexp.reduce(both, axis=None))
    assert pairs == pytest.approx(seen.ravel())
    # Clean words in front move a passage, over every border, but do not change what is found in it.
    passage, clean = np.array([1.0, 2, 5, 4, -1, 3, 2]), np.full(200, -6.0)
    wanted = toxicity.marginals([np.concatenate([clean, passage, clean])], chain)[0][0][200:207]
    for n in range(100, 200):
        p = toxicity.marginals([np.concatenate([clean[:n], passage, clean])], chain)[0][0]
        assert p[n:n + 7] == pytest.approx(wanted, abs=1e-9)
