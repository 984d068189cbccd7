"""The conversation trie against brute force over every prefix."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import pytest
from test_llm import FOLDER

from casebook.llm import trie
from casebook.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, k0 string, depth string, block int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows, borrow=True):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if borrow else 0
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, borrow=True):
    return sorted((tuple(r) for r in trie.trie(trie.paths(df, borrow=borrow)).select(*COLUMNS).collect()), key=str)


def rows_of(r, n, longest=12):
    rows = []
    texts = ["", "yes", "no", "é", "a longer text", None]
    for c in range(-7, n):
        for k in range(r.choice([1, 2, 3, longest])):
            rows.append((c, k if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(texts[: r.randint(1, 6)]), 1, "x", "y", 2))
    rows += [rows[3], rows[3], (None, 1, "user", "no conversation", 1, "x", "y", 2), (10**15, None, None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("borrow", [True, False])
def test_nodes_equal_brute_force(spark, borrow):
    rows = rows_of(random.Random(3), 60)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), borrow) == brute(rows, borrow)


def test_an_empty_table_has_no_nodes(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_long_paths_and_hot_nodes(spark, monkeypatch):
    """Small buckets, pieces and shares, so that every split is met."""
    for name, value in (("BUCKET", 2), ("PIECE", 3), ("HOT", 20)):
        monkeypatch.setattr(trie, name, value)
    r = random.Random(8)
    rows = [(c, k, "user", f"t{k}", 1, "x", "y", 2) for c in (1, 2, 5, 7) for k in range(100)]  # one path for all
    rows += [(20 + c, k, "user", "same" if k < 4 else str(r.random()), 1, "x", "y", 2) for c in range(80) for k in range(r.choice([3, 4, 5, 40]))]
    rows += [(200 + 5 * c, 0, "user", "one", 1, "x", "y", 2) for c in range(40)]  # many end in one node
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_nodes_and_parents_are_named_and_have_their_turns(spark):
    rows = rows_of(random.Random(5), 20)
    conversations = spark.createDataFrame(rows, SCHEMA)
    nodes = trie.with_turns(trie.trie(trie.paths(conversations)), conversations).collect()
    by_id = {n.node_id: n for n in nodes}
    assert len(by_id) == len(nodes)
    for n in nodes:
        if n.depth == 0:
            assert n.parent_id is None and n.role is None
        else:
            assert by_id[n.parent_id].depth == n.depth - 1 and by_id[n.parent_id].conv_id == n.parent_conv_id
            assert digest(n.role, n.text).hex() == n.turn


def test_query_equals_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(x) for x in QUERIES["op13_prefix_trie"](spark, FOLDER).collect()), key=str) == brute(rows)
