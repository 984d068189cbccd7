"""Periodic runs against brute force: every lag, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_llm import FOLDER, documents, empty, odd  # noqa: F401

from casebook.llm import periods
from casebook.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def seeded(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is None or not n:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w if h % 10 else [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def row(doc_id, text):
    w = seeded(doc_id, text)
    found = brute(w)
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    return (doc_id, len(found), *first, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def strange(r):
    kind = r.randrange(5)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 120))]
    if kind == 1:
        return ["a"] * r.randint(0, 70)
    if kind == 2:
        return ["ab"[i.bit_count() & 1] for i in range(r.randint(1, 200))]
    out = []
    for _ in range(r.randint(1, 6)):
        unit = [r.choice("abcd") for _ in range(r.randint(1, 12))]
        out += (unit * r.randint(1, 9))[: r.randint(1, 90)] + [r.choice("abcdef") for _ in range(r.randint(0, 5))]
    return out


def test_runs_of_several_texts_at_once():
    r = random.Random(2)
    for _ in range(800):
        texts = [strange(r) for _ in range(r.randint(1, 3))]
        word = np.array([ord(x) + 1000 * d for d, w in enumerate(texts) for x in w], np.int64)
        true, at = [], 0
        for w in texts:
            true += [(s + at, e + at, q) for s, e, q in brute(w)]
            at += len(w)
        assert [tuple(x) for x in periods.runs_of(word, max(map(len, texts))).tolist()] == sorted(true)


def test_hashes_that_lie_change_nothing(monkeypatch):
    monkeypatch.setattr(periods, "h_same", lambda h, a, b, lag: np.ones(len(a), bool))
    r = random.Random(4)
    for _ in range(200):
        w = [*strange(r), *strange(r)]
        found = [tuple(x) for x in periods.runs_of(np.array([ord(x) for x in w], np.int64), len(w)).tolist()]
        assert set(found) <= set(brute(w))  # what the words do not confirm is never reported


@pytest.mark.parametrize("kind", ["same", "binary", "six", "long"])
def test_long_texts_take_few_steps(kind):
    n = 300_000
    word = {"same": np.zeros(n), "binary": np.random.default_rng(1).integers(0, 2, n), "six": np.tile([0] * 6 + [1], n // 7), "long": np.tile(np.arange(n // 5), 5)}[kind].astype(np.int64)
    found = periods.runs_of(word, len(word))
    assert {"same": [(0, n, 1)], "long": [(0, n, n // 5)]}.get(kind) in (None, [tuple(x) for x in found.tolist()])
    if kind == "six":
        assert len(found) == n // 7 + 1 and (found[:, 2] == 7).sum() == 1


def test_rows_equal_brute_force(spark, odd, empty):  # noqa: F811
    r = random.Random(9)
    extra = [(100 + i, " ".join(strange(r)), None, None, None, None, None) for i in range(60)]
    docs = odd.union(spark.createDataFrame(extra, odd.schema)).where("length(text) < 5000 OR text IS NULL OR startswith(text, 'word') OR startswith(text, 'y')")
    found = periods.digests(periods.runs(docs, text=periods.seeded(docs.doc_id, docs.text)))
    # a text of 5000 equal words is slow by brute force over all lags: known by hand
    rows = docs.select("doc_id", "text").collect()
    quick = [x for x in rows if not (x.text or "").startswith("word word")]
    assert sorted((tuple(x) for x in found.collect() if x.doc_id in {y.doc_id for y in quick}), key=str) == sorted((row(*x) for x in quick), key=str)
    (long,) = (x for x in periods.runs(docs.where("startswith(text, 'word word')")).collect())
    assert [tuple(x) for x in long.runs] == [(0, 5000, 1)] and long.collapsed == "word"
    assert periods.runs(empty).collect() == []


def test_query_equals_brute_force(spark):
    docs = documents(spark).where("length(text) < 6000")
    found = {x.doc_id: tuple(x) for x in QUERIES["op12_periods"](spark, FOLDER).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) > 100
    for x in rows:
        assert found[x.doc_id] == row(*x)
