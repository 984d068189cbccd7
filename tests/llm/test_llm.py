"""The operators of the llm folder against brute force, on small tables made here and on
the smallest given ones. Every operator also gets nulls, empty and long texts, repeated
rows, an empty table and extra columns with clashing names."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import both
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebook.llm import bpe, components, decontam, language, lengths, neardup, quality, repeats, secrets, urls, warc, words
from casebook.llm.common import flat
from casebook.llm.oracles import ORACLES
from casebook.llm.queries import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, kept boolean, component_id string, a int, spans string"


def odd_texts() -> list[str | None]:
    r = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma", "дельта", "é", "of", "the", "x1", "#", "日本語", "it's"]
    texts = [None, "", " ", "\n\n", "one", "ONE", "two words", "Two\tWords", "a\x0bb\x0cc", "é é", "   x", "password=" + "a" * 6, "🤦‍♂️ 🤦"]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 200))) for _ in range(40)]
    texts += [texts[20], texts[20], texts[21] + " end", texts[22].upper() if texts[22] else ""]
    texts += ["word " * 5000, "y" * 30_000, "\n".join(["line of words here"] * 40)]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", True, "x", 1, "y") for i, t in enumerate(odd_texts())]
    rows += [rows[30], (None, "a text without an id " * 20, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    mine, theirs = both(spark, name, QUERIES[name], ORACLES[name], FOLDER)
    assert mine == theirs


# words


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingle_sets_have_the_right_sizes_and_overlaps(k):
    texts = odd_texts()
    found = words.Shingles(*flat(pa.array(texts)), k)
    true = [shingles(t, k) for t in texts]
    elements, bounds = found.elements()
    for sets in (found.numbers(), *([elements[a:b, i] for a, b in itertools.pairwise(bounds)] for i in (0, 1))):
        mine = [set(x.tolist()) for x in sets]
        assert [len(s) for s in mine] == [len(s) for s in true]
        for i, j in itertools.combinations(range(len(texts)), 2):
            assert len(mine[i] & mine[j]) == len(true[i] & true[j])


def twins(n: int) -> tuple[str, str]:
    """Two different texts of n bytes, a power of two, that a polynomial hash modulo 2**64 takes for equal."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_texts_of_equal_hashes_are_told_apart(spark):
    a, b = twins(2048)
    raw = np.frombuffer((a + b).encode(), np.uint8)
    starts = np.array([0, 2048, 0, 2048])
    h = words.span_hash(words.prefix_hash(raw), starts, starts + 2048)
    assert h[0] == h[1]  # the trap works
    assert words.numbered(raw, starts, starts + 2048)[0].tolist() == [0, 1, 0, 1]
    found = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a}\n{a}\n{b}"), (5, f"x y {a} x y {b} x y {a}")], "doc_id long, text string")
    lines = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(found).collect()}
    assert lines == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (0, 6)}
    assert {r.doc_id: r.component_id for r in neardup.groups(found.where("doc_id < 3"), k=2).collect()} == {1: 1, 2: 2}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


# 1


def tlv(tag: int, data: bytes) -> bytes:
    n = len(data)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + data


PKCS8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, bytes(range(32)))))
RSA = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, b"\1" + bytes(60)) for _ in range(8)))
SEC1 = tlv(0x30, tlv(2, b"\1") + tlv(4, bytes(32)) + tlv(0xA0, tlv(6, b"\x2a\x86")))
CERTIFICATE = tlv(0x30, tlv(0x30, tlv(2, b"\1")) + tlv(0x30, tlv(6, b"\x2a")) + tlv(3, bytes(64)))
OPENSSH = secrets.MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"s" * 136))


def wrapped(data: bytes) -> str:
    text = base64.b64encode(data).decode()
    return "\n".join(text[i : i + 64] for i in range(0, len(text), 64))


@pytest.mark.parametrize("data,kind", [(PKCS8, "der"), (RSA, "der"), (SEC1, "der"), (OPENSSH, "openssh")])
def test_keys_are_confirmed_by_their_structure(data, kind):
    key = wrapped(data)
    text = f"é before {key}\nmore words after"
    assert [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.spans(text)] == [(kind, key)]
    assert not secrets.spans(f"x {key[:-9]} y")  # cut short
    if kind == "der":
        assert (2, 4, 2 + 2 * len(data)) in secrets.spans(f"x {data.hex().upper()} y")
        assert all(kind_ == 2 for _, kind_, _ in secrets.spans(f"x {data.hex().upper()[:-2]} y"))  # digits alone are base hex


def test_neighbouring_keys_are_all_found():
    text = "\n".join([wrapped(RSA), wrapped(PKCS8), "Mwords" * 20, wrapped(OPENSSH), wrapped(SEC1)])
    assert [(k, text[a:b]) for a, k, b in secrets.spans(text)] == [(3, wrapped(RSA)), (3, wrapped(PKCS8)), (5, wrapped(OPENSSH)), (3, wrapped(SEC1))]


@pytest.mark.parametrize("data,kind", [(PKCS8, 3), (RSA, 3), (SEC1, 3), (OPENSSH, 5)])
@pytest.mark.parametrize("between", ["\\n", "\\r\\n", "\\\\n", "\\u000a", "\n    ", "\r\n\t", " \\\n  ", "\\n  "])
def test_escaped_and_indented_keys_are_found(data, kind, between):
    key = wrapped(data).replace("\n", between)
    for before in ("", "x ", '{"key": "-----BEGIN PRIVATE KEY-----'):
        text = f"{before}{between if before else ''}{key}{between}-----END PRIVATE KEY-----{between}"
        start = text.index(key)
        assert [x for x in secrets.spans(text) if x[1] > 2] == [(start, kind, start + len(key))]
        assert key[:40] not in secrets.redacted(text, secrets.spans(text))


def test_keys_of_any_length_and_with_escaped_slashes_are_found():
    long_ = b"\x30\x83" + (3 + 70_000 * 8 + 5 * 8).to_bytes(3, "big") + tlv(2, b"\0") + 8 * (b"\x02\x83" + (70_000).to_bytes(3, "big") + bytes([1]) * 70_000)
    slashes = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, b"\xff" * 32)))
    sizes = [len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")] + [(1).to_bytes(4, "big")] + [len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"s" * 100_000)]
    for key, kind in ((wrapped(long_), 3), (wrapped(slashes).replace("/", "\\/"), 3), (wrapped(secrets.MAGIC + b"".join(sizes)), 5)):
        assert [x for x in secrets.spans(f"a {key} b") if x[1] > 2] == [(2, kind, 2 + len(key))]


@pytest.mark.parametrize("n", [1, 16, 17, 400])
def test_key_files_hold_any_number_of_keys(n):
    sizes = [len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")] + [n.to_bytes(4, "big")] + [len(x).to_bytes(4, "big") + x for x in (*[b"p" * 51] * n, b"s" * 136)]
    key = wrapped(secrets.MAGIC + b"".join(sizes))
    assert [x for x in secrets.spans(f"a {key} b") if x[1] > 2] == [(2, 5, 2 + len(key))]


def test_a_frame_without_a_key_in_it_is_no_secret():
    r = random.Random(1)
    frame = lambda inner: tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, inner))
    for _ in range(200):
        assert not [x for x in secrets.spans(wrapped(frame(bytes(r.randrange(256) for _ in range(r.choice([20, 34, 100, 250])))))) if x[1] == 3]
    for inner in (RSA, SEC1, tlv(4, bytes(57)), tlv(2, bytes(range(1, 33)))):
        assert [x[1] for x in secrets.spans(wrapped(frame(inner)))] == [3]
    for inner in (RSA[:-1], RSA + b"\0", CERTIFICATE, tlv(4, bytes(8)), tlv(0x30, b"")):
        assert not [x for x in secrets.spans(wrapped(frame(inner))) if x[1] == 3]


@pytest.mark.parametrize("data", [PKCS8, RSA, SEC1])
def test_wrapped_hex_the_other_alphabet_and_quoted_lines_are_found(data):
    lines = [data.hex().upper()[i : i + 32] for i in range(0, 2 * len(data), 32)]
    for key in ("\n".join(lines), "\\n".join(lines), "\r\n  ".join(x.lower() for x in lines)):
        assert (2, 4, 2 + len(key)) in secrets.spans(f"a {key}\n b") and not [x for x in secrets.spans(f"a {key[:-2]}\n b") if x[1] == 4]
    url = base64.urlsafe_b64encode(data).decode()
    assert [x for x in secrets.spans(f'a "{url}" b') if x[1] > 2] == [(3, 3, 3 + len(url))]
    rows = wrapped(data).split("\n")
    for between in ("\n# ", "\n> ", '"\n  "', '\\n"\n    "', '\\n" +\n    "', "',\n'"):
        key = between.join(rows)
        assert [x for x in secrets.spans(f"a {key} b") if x[1] > 2] == [(2, 3, 2 + len(key))]


def test_tokens_after_an_escaped_line_break_are_found():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    assert [x for x in secrets.spans(f"a\\n{token}") if x[1] > 2] == [(3, 6, 3 + len(token))]


def test_many_beginnings_in_one_stretch_take_time_in_proportion():
    import time

    began = time.process_time()
    assert not secrets.spans("MIQAgAAAAgEAAgEAAAAA\n" * 100_000) and not secrets.spans("b3BlbnNzaC1rZXktdjEA\n" * 100_000)
    assert time.process_time() - began < 30


def test_certificates_and_wrong_tokens_are_no_secrets():
    assert not secrets.spans(wrapped(CERTIFICATE))
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    assert [(k, a, b) for a, k, b in secrets.spans(f"a {token} b")] == [(6, 2, 2 + len(token))]
    assert not secrets.spans(f"{part({'typ': 'JWT'})}.{part({'sub': 1})}.c2ln") and not secrets.spans("eyJhbGci.eyJzdWIi.xx")


def base_spans(text):
    """The base kinds as they are defined: unbounded matches, then dropped by length."""
    out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans(spark, odd, empty):
    r = random.Random(1)
    pieces = ["secret", "ſecret", "TOKEN", "apikey", "Api_Key", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "é"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))
        assert [x for x in secrets.spans(text) if x[1] < 3] == base_spans(text), text
    rows = {r_.doc_id: r_ for r_ in secrets.scan(documents(spark)).collect()}
    for d in documents(spark).collect():
        base = base_spans(d.text or "")
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(secrets.listed(base).encode()).hexdigest()
        assert rows[d.doc_id].n_hex == sum(k == 2 for _, k, _ in base)
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(empty).count() == 0


def test_redaction_keeps_columns_and_removes_secrets(spark, odd, empty):
    clean = secrets.redact(odd)
    assert clean.schema == odd.schema and clean.count() == odd.count() and secrets.redact(empty).count() == 0
    assert secrets.findings(clean).count() == 0 and secrets.findings(odd).count() > 0
    assert secrets.redacted("a token=abcdef b", secrets.spans("a token=abcdef b")) == "a [SECRET] b"


# 2 and 10


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_of(bpe.spec_of(TOKENIZER))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_encoding_equals_the_library(codec, library):
    r = random.Random(3)
    pieces = ["a", "b", "e", "the", "ing", " ", "\n", "'s", "'LL", "é", "é", "İ", "Σ", "ΑΣ", "中", "🤦", "!!!", "1", "23", "<|endoftext|>", "<|startoftext|>", "<", "|>", "</w>", "\x1c", "\x85", "​", "aaaa", "hahaha", "Ꝋ", "ا", "’", "€"]
    texts = [t or "" for t in odd_texts()] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    texts += ["".join(r.choice("aeothn") for _ in range(r.randint(1, 25))) for _ in range(5000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        mine = codec.encode(text)
        assert np.frombuffer(mine, "<u4").tolist() == ids, text
        assert codec.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_own_splitting_is_used_only_where_it_agrees(codec, library):
    for point in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
        for text in (f"a{chr(point)}b", f"{chr(point) * 2}1 {chr(point)}"):
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests_and_round_trip(spark, odd, empty, library):
    rows = bpe.digests(odd, TOKENIZER).collect()
    true = collections.Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        true[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows)) == true
    decoded = bpe.decode(bpe.encode(odd.where("doc_id = 6"), TOKENIZER), TOKENIZER).first()
    assert decoded.decoded == "two</w> words</w>" and bpe.digests(empty, TOKENIZER).count() == 0


def test_length_histogram(spark, odd, empty, library):
    sizes = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    sums = lengths.suffix_sums(lengths.histogram(odd, TOKENIZER)).cache()
    for r in sums.collect():
        n = r.n_tokens
        assert r.n_docs == sizes.count(n) and r.n_docs_at_least == sum(s >= n for s in sizes)
        assert r.n_tokens_at_least == sum(s for s in sizes if s >= n) and r.n_tokens_kept == sum(min(s, n) for s in sizes)
        assert sizes[r.rank_from - 1] == sizes[r.rank_to - 1] == n
    assert {r.limit: r.n_tokens for r in lengths.truncated_totals(sums, [0, 7, 10**6]).collect()} == {x: sum(min(s, x) for s in sizes) for x in (0, 7, 10**6)}
    assert {r.share: r.n_tokens for r in lengths.quantiles(sums, [0.0, 0.5, 1.0]).collect()} == {0.0: sizes[0], 0.5: sizes[-(-len(sizes) // 2) - 1], 1.0: sizes[-1]}
    assert lengths.suffix_sums(lengths.histogram(empty, TOKENIZER)).count() == 0


# 3


def test_language_accuracy_and_edges(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert language.predict(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}


def grams_by_force(text: str | None) -> list[str]:
    """Letter 2- and 3-grams of a lower-cased text, which a boundary may begin or end."""
    marked = "".join(c if c.isalpha() else "\0" for c in f"\0{(text or '').lower()}\0")
    found = [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [g for g in found if (g[0] != "\0" or g[-1] != "\0") and "\0" not in g[1:-1]]


def test_language_filters_agree_with_exact_sets(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts[r.lang].update(grams_by_force(r.text))
    sets = {}
    for lang, c in counts.items():
        total = {n: sum(v for g, v in c.items() if len(g) == n) for n in (2, 3)}
        sets[lang] = {g for g, v in c.items() if v >= 1e-5 * total[len(g)]}
    model = language.fit(docs.where(~language.held_out()))
    assert model.languages == sorted(sets)
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    agreed = []
    for r in rows:
        mine = grams_by_force(r.text)
        share = {lang: sum(g in s for g in mine) / len(mine) if mine else 0.0 for lang, s in sorted(sets.items())}
        best = max(share, key=share.get)
        # a filter only adds to a set, by a share that is known and taken off
        assert abs(found[r.doc_id].score - share[best]) < 0.03 or found[r.doc_id].lang_pred == "und"
        agreed.append(found[r.doc_id].lang_pred == (best if any(map(str.isalpha, r.text or "")) else "und"))
    assert np.mean(agreed) > 0.99


def test_bloom_filters_have_no_false_negatives_and_known_false_positives():
    r = np.random.default_rng(0)
    gram = r.integers(0, 2**63, 3000).astype(np.uint64)
    slices = np.zeros(1 << 13, np.uint64)
    for at in language.places(gram, len(slices)):
        slices[at.astype(np.int64)] |= np.uint64(1)

    def share(values):
        found = np.uint64(1)
        for at in language.places(values, len(slices)):
            found = found & slices[at.astype(np.int64)]
        return float(np.mean(found))

    assert share(gram) == 1 and abs(share(r.integers(0, 2**63, 100_000).astype(np.uint64)) - slices.mean() ** language.HASHES) < 0.02


# 4


def test_url_rules_and_edges(spark):
    given = ["https://A.Example.COM/en/x?y", "http://www.example.com/en/", "http://x.www.example.com/en/q#f", "ftp://n.net/es/1", "http://net/fr/", "http://com/", "http://com", "http://notcom/x", "http://a.org/ES", None, "", "no scheme", "://", "http://x.com?u=://y", "http://ü.net/es/"]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "v", 1) for i, u in enumerate(given)] + [(0, given[0], "v", 1)], "page_id int, url string, verdict string, label int")
    rows = urls.judge(pages, URL_RULES).collect()
    assert len(rows) == len(given) + 1
    told = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert told[0] == ("a.example.com", "/en/x", "example.com/en/") and told[1][2] == "www.example.com/en/" == told[2][2]
    assert told[None][2] == "net/es/" and told[4][2] == "net/fr/" and told[5][2] == "com/" and told[6] == ("com", "", None) and told[7][2] is None
    assert told[9] == told[10] == told[11] == ("", "", None) and told[13] == ("x.com", "", None) and told[14][2] == "net/es/"
    assert {r.verdict for r in rows} <= {"allow", "block"} and all(r.verdict == "block" for r in rows if r.rule in ("example.com/en/", "net/es/", "net/fr/"))
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0


def test_url_filter_is_native(spark):
    plan = QUERIES["op4_url_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_scores_do_not_depend_on_the_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = sorted(urls.judge(pages, URL_RULES).collect())
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", -1)
    assert sorted(urls.judge(pages, URL_RULES).collect()) == found
    texts = spark.createDataFrame([("abc", "allow", 1), ("xyz", "block", 1)], "s string, label string, n long")
    plan = urls.gram_scores(texts, urls.grams(texts).select("gram").distinct())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5


def test_revisits_do_not_depend_on_the_join(spark, monkeypatch):
    rows = [(i if i % 7 else None, "u", "often" if i % 3 else f"twice {i // 6}" if i % 2 else "") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda r: (r.page_id or -1, bytes(r.payload))
    for least in (0, 3):
        firsts = {h: min(p for p, _, x in rows if x == h and p is not None) for h in {h for p, _, h in rows if p is not None}}
        wanted = sorted((p or -1, h.encode(), firsts[h] if p and len(h) >= least and p > firsts[h] else None) for p, _, h in rows)
        for most in (100_000, 2):  # 2: one payload is frequent, the others are joined by a shuffle
            monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", most)
            found = warc.decisions(pages, least).collect()
            assert [(*key(r), r.refers_to) for r in sorted(found, key=lambda r: (*key(r), r.refers_to or -1))] == sorted(wanted, key=lambda w: (w[0], w[1], w[2] or -1))
            assert all(r.revisit == (r.refers_to is not None) for r in found)


def test_warc_edges_and_ranges(spark, tmp_path):
    same = "<p>same</p>"
    noise = base64.b85encode(np.random.default_rng(1).bytes(200_000)).decode()
    pages = [(1, "http://a/", same), (2, None, same), (3, "http://c\r\nX: y", None), (4, "d", ""), (5, "e", "é" * 1000), (None, "f", same), (6, "g", noise), (6, "g", noise)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    warc.write(df, folder)
    for size in (64, 5000, warc.RANGE):  # however the files are cut, each record is read once
        rows = warc.read(spark, folder, size=size).collect()
        assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(
            (p or 0, len((h or "").encode()), warc.digest_of((h or "").encode()), "revisit" if p in (2, 4) else "response", {2: 1, 4: 3}.get(p)) for p, _, h in pages
        )
        assert {r.payload.decode() for r in rows if r.record_type == "response"} == {h or "" for p, _, h in pages}
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    unpack, records = zlib.decompressobj(31), 0
    while data:  # a plain reader of concatenated members gets whole records
        text = unpack.decompress(data)
        records += text.startswith(b"WARC/1.1\r\n")
        data, unpack = unpack.unused_data, zlib.decompressobj(31)
    assert records == len(pages)
    warc.write(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_long_records_end_in_a_zero_byte():
    data = np.random.default_rng(2).bytes((1 << 24) + 5)
    packed = warc.member(data)
    assert packed[-1] == 0
    read = lambda at: packed[at : at + warc.BLOCK]
    assert warc.inflated(read, 0) is None  # no record
    body = warc.record(1, "u", data, "d", None, False, "t")
    packed = warc.member(body)
    assert list(warc.owned(lambda at: packed[at : at + warc.BLOCK], 0, len(packed))) == [body]


# 6


def test_masks_meet_every_pattern_of_substitutions():
    for n in (15, 16, 20):
        for subs in itertools.combinations(range(n), n // 5):
            assert any(all(i + p not in subs for p in m) for m in decontam.MASKS for i in range(n - m[-1])), subs


def test_short_items_are_found_whatever_words_are_substituted(spark):
    docs, items = [], []
    for n in range(1, 15):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for m in range(n // 5 + 2):  # the last one is too many
            for subs in itertools.combinations(range(n), min(m, n)):
                docs.append((n, m, " ".join(["before", *("other" if k in subs else w for k, w in enumerate(item)), "after"])))
    docs = [(i, *x) for i, x in enumerate(docs)]
    found = {(x.doc_id, x.item_id, x.off, x.n_matched) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, n int, m int, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, n, 1, n - m) for i, n, m, _ in docs if m <= n // 5}


def test_decontamination(spark, odd, empty):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    item = [r.choice(vocabulary) for _ in range(30)]
    changed = [w if i % 5 else "other" for i, w in enumerate(item)]
    half = item[:20]
    docs = [" ".join([*r.choices(vocabulary, k=50), *x, *r.choices(vocabulary, k=50)]) for x in (item, changed, half, item[:10], [w if i % 3 else "other" for i, w in enumerate(item)], [])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)] + [(None, ", ".join(item).upper(), 1), (8, None, 1), (9, "", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    found = decontam.contaminated(docs, items).collect()
    assert sorted((x.doc_id is None, x.doc_id, x.item_id, x.n_matched) for x in found) == [(False, 0, 1, 30), (False, 1, 1, 24), (False, 2, 1, 20), (True, None, 1, 30)]
    assert sorted(x.doc_id for x in decontam.clean(docs, items).collect()) == [3, 4, 5, 8, 9]
    assert decontam.clean(odd, items).count() == odd.count() and decontam.contaminated(odd, items.limit(0)).count() == 0 and decontam.contaminated(empty, items).count() == 0


def test_rows_with_null_or_repeated_ids_are_judged_one_by_one(spark):
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    item = text(30)
    rows = [(None, f"{text(20)} {item}", "bad"), (None, text(50), "clean 1"), (None, text(50), "clean 2"), (7, f"{item} {text(9)}", "bad"), (7, text(50), "clean 3"), (8, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    items = spark.createDataFrame([(None, item), (None, text(40))], "item_id long, text string")
    assert sorted(x.note for x in decontam.clean(docs, items).collect()) == ["clean 1", "clean 2", "clean 3", "null"]
    assert sorted((x.doc_id or 0, x.item_id, x.n_matched) for x in decontam.contaminated(docs, items).collect()) == [(0, None, 30), (7, None, 30)]


def test_decontamination_is_native(spark):
    plan = QUERIES["op6_decontamination"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7


def repeats_by_force(rows):
    count = collections.Counter(t[i : i + repeats.SIZE] for _, t in rows for i in range(len(t) - repeats.SIZE + 1))
    out = collections.Counter()
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - repeats.SIZE + 1):
            if count[t[i : i + repeats.SIZE]] > 1:
                gone[i : i + repeats.SIZE] = b"\1" * repeats.SIZE
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_repeats_equal_brute_force(spark, odd, empty, group):
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, long_ = text(399), text(900)
    texts = [text(300) + shared + text(200), text(100) + shared + text(10), text(50) + long_[:500] + text(90), long_[100:700] + text(60), text(20) + long_, "ab" * 600, "abcabc" * 100 + text(30) + "abcabc" * 100, text(450)]
    for edge in (360, 371, 380):  # passages that meet at one side only
        texts += [text(30) + long_[:edge] + text(80), text(30) + long_[:edge] + text(80)]
    # different strings of equal hashes, alone and around a passage
    for a in twins(512):
        texts += [a[:400], "x" * 20 + a + long_[:300] + a[:390], a[100:400] + long_[:272] + text(20)]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r_.doc_id, r_.text) for r_ in odd.collect() if len(r_.text or "") < 9000]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("core", F.lit(1)).repartition(3)
    found = collections.Counter(map(tuple, repeats.digests(df, group=group).collect()))
    assert found == repeats_by_force([(d, (t or "").encode()) for d, t in rows])
    assert repeats.digests(empty).count() == 0


@pytest.mark.parametrize("length", [390, 430])
def test_a_passage_of_very_many_texts(spark, length):
    """A frequent core is descended by shared contexts; 6,000 texts hold it, some with longer repeats around it."""
    r = random.Random(length)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, endings = text(length), [text(60) for _ in range(5)]
    rows = [(i, text(r.randint(0, 30)) + r.choice(["", r.choice(endings)]) + passage + r.choice(["", r.choice(endings)]) + text(r.randint(0, 30))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collections.Counter(map(tuple, repeats.digests(df, group=500).collect())) == repeats_by_force([(d, t.encode()) for d, t in rows])


def test_planted_passages_are_removed_from_400_bytes_on(spark):
    """Passages of over 50 words, planted in two or many documents: recall by length in bytes is 0 below 400 and 1 from there."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, lengths_of = [], {}
    for i, size in enumerate([330, 390, 398, 399, 400, 401, 402, 410, 430, 600, 2000] * 3):
        passage = (text(60) + " " + text(400))[:size]
        for _ in range(r.choice([2, 2, 5, 40])):
            lengths_of[len(rows)] = size
            rows.append((len(rows), f"{text(30)}<{len(rows)}>{passage}<{len(rows)}>{text(30)}"))
    clean = len(rows)
    rows += [(clean + i, text(200)) for i in range(200)]
    found = repeats.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter(map(tuple, found)) == repeats_by_force([(d, t.encode()) for d, t in rows])
    removed = {x.doc_id: x.n_removed for x in found}
    recall = {size: np.mean([removed[d] >= size for d, s in lengths_of.items() if s == size]) for size in lengths_of.values()}
    # a passage of 390 to 399 bytes counts where what stands around it repeats as well
    assert all(share == 1 for size, share in recall.items() if size >= 400) and recall[330] == 0
    assert all(removed[d] == 0 for d, _ in rows[clean:])


def test_a_descent_takes_along_only_what_is_open(spark, monkeypatch):
    """Contexts are no longer than the range that is looked for, and what is alike goes on once, so rounds have few rows."""
    folders, fresh = [], repeats.new_folder
    monkeypatch.setattr(repeats, "new_folder", lambda session, name: folders.append((name, fresh(session, name))) or folders[-1][1])
    repeats.digests(documents(spark), group=3)
    rounds = [spark.read.parquet(path) for name, path in folders if name == "groups"]
    assert len(rounds) > 3
    assert all(not x.where("length(before) > y - x OR length(after) > y - x").count() for x in rounds)
    first, *later = [x.count() for x in rounds]
    assert first and sum(later) < 20 * first


def test_few_contexts_pair_by_pair_equal_intervals():
    r = random.Random(4)
    for need in (0, 1, 9, 40):
        for _ in range(60):
            pool = [bytes(r.choice(b"ab") for _ in range(need)) for _ in range(2)]
            side = lambda: (r.choice(pool)[: r.randint(0, need)] + bytes(r.choice(b"ab") for _ in range(need)))[: r.randint(0, need)]  # noqa: B023, E731
            keys = list({(side(), side()) for _ in range(repeats.FEW)})
            if len(keys) > 1:
                assert [list(map(int, x)) for x in repeats.reaches([k[0] for k in keys], [k[1] for k in keys], need)] == list(map(list, repeats._pairwise(keys, need)))


def test_interval_reaches_equal_all_pairs():
    r = random.Random(2)
    for _ in range(60):
        pool = [bytes(r.choice(b"ab") for _ in range(repeats.REACH)) for _ in range(3)]
        strings = set()
        while len(strings) < 12:
            a, b = r.randint(0, 272), r.randint(0, 272)
            x, y = r.choice(pool)[:a] + bytes(r.choices(b"xyz", k=max(0, r.choice([0, 272 - a])))), r.choice(pool)[:b] + bytes(r.choices(b"xyz", k=max(0, r.choice([0, 272 - b]))))
            strings.add((x, y))
        lefts, rights = map(list, zip(*strings, strict=True))
        prefix = lambda p, q: next((i for i, (m, n) in enumerate(zip(p, q)) if m != n), min(len(p), len(q)))  # noqa: B905, E731
        left, right = repeats.reaches(lefts, rights)
        for i in range(len(lefts)):
            both_ = [(prefix(lefts[i], lefts[j]), prefix(rights[i], rights[j])) for j in range(len(lefts)) if j != i]
            ok = [x for x in both_ if sum(x) >= repeats.REACH]
            assert (left[i], right[i]) == ((max(x for x, _ in ok), max(y for _, y in ok)) if ok else (-1, -1))


# 8


def groups_by_force(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (d, a), (e, b) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = find(d), find(e)
            root[max(x, y)] = min(x, y)
    return collections.Counter((d, len(s), None if d is None else find(d), True if d is None else find(d) == d) for d, s in sets)


@pytest.mark.parametrize("k,block", [(2, 4096), (5, 4096), (2, 3)])
def test_near_duplicates_equal_brute_force(spark, odd, empty, monkeypatch, k, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(r_.doc_id, r_.text) for r_ in odd.collect()]
    base = [r.choices(vocabulary, k=120) for _ in range(4)]
    for i in range(60):  # chains of edits, so that links decide components
        w = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        base.append(w)
        rows.append((200 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit(1)).repartition(3)
    assert collections.Counter(map(tuple, neardup.groups(df, k).collect())) == groups_by_force(rows, k, 80)
    assert neardup.groups(empty, k).count() == 0
    kept = neardup.keep_one(odd, k)
    assert kept.columns == odd.columns and kept.count() < odd.count()


def test_many_alignments_of_a_document_share_one_split(spark):
    docs = spark.createDataFrame([(1, " ".join(["aa"] + ["bb", "cc"] * 300)), (2, "aa bb"), (3, "zz")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "bb cc"), (8, "cc bb")], "item_id long, text string")
    found = collections.Counter((x.doc_id, x.item_id) for x in decontam.contaminated(docs, items).collect())
    assert found == {(1, 7): 300, (1, 8): 299}
    rows = decontam.contaminated(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count("Generate explode") >= 1 and rows.count("split(lower(") <= 2  # the documents' words, and the items'


@pytest.mark.parametrize("n", [0, 1, 100_000, 3_300_000])
def test_the_filter_grows_with_the_seeds(spark, n):
    cells = decontam.cells_for(n)
    assert 2**decontam.LEAST_CELLS <= 2**cells <= 2**decontam.MOST_CELLS
    if n <= 100_000:
        seeds = spark.range(n).select(F.xxhash64("id").alias("seed"))
        table = spark.range(1).select(decontam.bit_filter(seeds, cells).alias("t")).first().t
        assert len(table) == 2**cells and sum((x & (2**64 - 1)).bit_count() for x in table) <= 64 * 2**cells / 2
        assert seeds.where(decontam.maybe(decontam.bit_filter(seeds, cells), "seed", cells)).count() == n
    assert 1 - np.exp(-2 * n / (64 * 2**cells)) < 0.5


def test_links_of_small_sets_do_not_rest_on_bands(spark):
    """Sets of 5 to 9 shingles that differ by one: all pairs, and the pairs that are too far apart are not linked."""
    r = random.Random(12)
    rows = []
    for i in range(6000):
        n = r.randint(4, 10)  # words, so one shingle less
        w = [f"x{r.randrange(10**9)}" for _ in range(n)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w, "end"])), (3 * i + 2, " ".join([*w[:-1], f"y{i}"]))]
    found = {x.doc_id: x.component_id for x in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=2).collect()}
    for i in range(6000):
        n = len(rows[3 * i][1].split()) - 1
        assert found[3 * i + 1] == (3 * i if 100 * n >= 80 * (n + 1) else 3 * i + 1)
        assert found[3 * i + 2] == (3 * i if 100 * (n - 1) >= 80 * (n + 1) else 3 * i + 2)
    assert neardup.small_sizes(80) == (5, 9) and neardup.small_sizes(50) == (2, 3) and neardup.small_sizes(100) == (1, 0)


@pytest.mark.parametrize("most", [20, 200])
def test_scores_of_frequent_grams_go_to_the_urls(spark, monkeypatch, most):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    plain = sorted(tuple(r) for r in urls.judge(pages, URL_RULES).collect())
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", most)
    assert sorted(tuple(r) for r in urls.judge(pages, URL_RULES).collect()) == plain


def test_near_duplicates_are_stored_in_few_files(spark):
    """An executor starts processes for every file that it creates, however many shuffle partitions there are."""
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    old, held = set(root.iterdir()), {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert neardup.keep_one(documents(spark)).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [len(list(x.glob("part-*"))) for x in root.iterdir() if x not in old]
    assert len(files) > 8 and max(files) <= 16


def test_kept_is_the_equality_of_the_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, f"{text} more"), (2, text), (None, f"{text} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((x.doc_id, x.component_id, x.kept) for x in neardup.groups(docs).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False)], key=str)
    assert len(neardup.keep_one(docs).collect()) == 1


def test_near_duplicates_judge_rows_with_null_or_repeated_ids_one_by_one(spark):
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(100))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, a), (None, f"{a} end"), (None, b), (5, b), (9, f"{b} end"), (3, c), (3, d), (4, f"{d} end"), (2, f"{c} end"), (6, e), (6, e), (6, f), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((x.doc_id, x.text) for x in neardup.keep_one(docs).collect()), key=str)
    near_a = next(t for d_, t in found if d_ is None and t and t.startswith(a))  # one of a's copies has the smaller key
    assert found == sorted([(None, near_a), (5, b), (2, f"{c} end"), (3, d), (6, e), (6, f), (None, ""), (None, ""), (None, None)], key=str)
    groups = collections.Counter((x.doc_id, x.component_id, x.kept) for x in neardup.groups(docs).collect())
    assert groups[5, 5, True] == groups[9, 5, False] == groups[None, 5, False] == groups[3, 2, False] == groups[3, 3, True] == groups[4, 3, False] == groups[2, 2, True] == 1
    assert groups[6, 6, True] == 3 and groups[None, None, True] + groups[None, None, False] == 6


@pytest.mark.parametrize("side", ["one block", "two blocks"])
def test_differences_decide_links_exactly(side):
    r = np.random.default_rng(6)
    centre = np.arange(200)
    for _ in range(20):
        sets = []
        for _ in range(25):
            gone = r.choice(centre, r.integers(5, 45), replace=False)
            sets.append(set(centre) - set(gone.tolist()) | set((1000 + r.integers(0, 40, r.integers(0, 30))).tolist()))
        weight = np.array([100 * len(set(centre) - s) + 80 * len(s - set(centre)) for s in sets])
        delta = [np.array(sorted(set(centre) ^ s)) for s in sets]
        sides = np.full(25, 3) if side == "one block" else np.where(np.arange(25) < 12, 1, 2)
        links = neardup.joining_links(list(range(25)), list(range(25)), weight, delta, sides, len(centre), 80)
        similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        assert all(similar(a, b) for a, b in links)
        far = [x for x in range(25) if weight[x] > 20 * len(centre) and sides[x] & 1]
        root = list(range(25))
        for a, b in links:
            root = [root[a] if c == root[b] else c for c in root]
        assert all(root[a] == root[b] for a in far for b in range(25) if sides[b] & 2 and a != b and similar(a, b))


def test_signatures_estimate_similarity_with_low_variance():
    r = np.random.default_rng(3)
    error = []
    for _ in range(40):
        both_, one, two = (r.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))
        best = neardup.signatures(np.concatenate((both_, one, both_, two)), np.array([0, 450, 900]))
        error.append(np.mean(best[0] == best[1]) - 0.8)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 1.1 * (0.8 * 0.2 / neardup.SLOTS) ** 0.5


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (5, 5), (None, 4)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {7: 3, 9: 3}


# 9


def test_quality_edges_and_ablations(spark, odd, empty):
    ledger = quality.ledger(odd).cache()
    rows = quality.apply_policy(ledger).collect()
    assert len(rows) == odd.count()
    for r, text in ((x, t) for x in rows for t in [next(y.text for y in odd.collect() if y.doc_id == x.doc_id)] if x.doc_id is not None):
        w = WORD.findall(text or "")
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        grams = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
        assert r.n_repeat_words == len({i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)})
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert (r.n_lines, r.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))
    for r in quality.ablations(ledger).collect():
        bit, mask = quality.mask([r.rule]), quality.mask(quality.POLICIES[1])
        bits = [x.fail_bits & mask for x in rows]
        assert (r.n_fail, r.n_only, r.n_kept_without) == (sum(b & bit > 0 for b in bits), bits.count(bit), sum(b & ~bit == 0 for b in bits))
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and kept.count() == sum(x.kept for x in rows) and quality.keep(empty).count() == 0
