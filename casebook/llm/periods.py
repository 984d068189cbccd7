"""Runs of consecutive words that repeat with a period, found on sparse diagonals.

A run has smallest period q and at least max(6, 4 * q) words, and no neighbouring word
extends it. On the diagonal of lag q it is a stretch of matches of 3 * q words or more, so
it meets three neighbouring multiples of the power of two at or below q. Only at these
checkpoints a word's earlier occurrences, at the lags of that power, count up the match
lengths of their diagonals; a diagonal with three checkpoints in a row is followed to the
ends of its matches and emitted. That makes at most one occurrence a word and power of
two, whatever repeats: n log n steps for any text. Hashes propose matches and the words
decide. A stretch found at several lags keeps the smallest, which divides the others.

Edge cases: a null, empty or blank text has no words and no runs, and its collapsed text is
empty; texts of any length are searched whole; runs may overlap; repeated rows and ids give
a row each; a null id stays null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import chunks, flat
from casebook.llm.words import numbered, prefix_hash, span_hash, word_spans

LEAST, TIMES = 6, 4
#: Bytes of text searched at a time.
CHUNK_BYTES = 1 << 19
WORDS = r"[ \t-\r]+"  # what stands between words: U+0020, U+0009 to U+000D


def _ends(same, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The largest x up to `most` for which same(which, x) holds, by halving; it holds for 0."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) // 2
        good = same(open_, middle)
        low[open_[good]] = middle[good]
        high[open_[~good]] = middle[~good] - 1


def _stretches(word: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """Every longest stretch of matches of a diagonal, word by word: its first and end word, the lag included."""
    equal = np.concatenate(([False], word[lag:] == word[:-lag], [False]))
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    return [(int(a), int(b) + lag) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def runs_of(word: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period), sorted, of a sequence of numbered words in which no word of
    one text occurs in another. longest: words of the longest text."""
    n = len(word)
    order = np.argsort(word, kind="stable")
    rank = np.empty(n, np.int64)  # of a word's number, so that occurrences sort by number and place
    ranked = word[order]
    rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1]))) if n else 0
    occurrences = rank[order] * n + order
    h = None
    found = []
    power = 1
    while TIMES * power <= longest:
        at = np.arange(0, n, power)
        low = np.searchsorted(occurrences, rank[at] * n + np.maximum(at - 2 * power + 1, 0))
        high = np.maximum(np.searchsorted(occurrences, rank[at] * n + at - power, side="right"), low)
        high[at < power] = low[at < power]
        count = high - low
        i = np.repeat(np.arange(len(at)), count)
        earlier = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count - low, count)]
        lag = at[i] - earlier
        hits = np.sort((lag - power) * (len(at) + 2) + i)  # by diagonal, then checkpoint
        threes = hits[:-2][hits[2:] == hits[:-2] + 2] if len(hits) > 2 else hits[:0]
        if len(threes):
            lag, i = threes // (len(at) + 2) + power, threes % (len(at) + 2)
            h = prefix_hash_of(word) if h is None else h
            full = h_same(h, at[i], at[i] + 2 * power + 1, lag)
            lag, i, threes = lag[full], i[full], threes[full]
            head = np.ones(len(threes), bool)
            head[1:] = threes[1:] != threes[:-1] + 1
            tail = np.append(head[1:], True) if len(head) else head
            q, first, last = lag[head], at[i[head]], at[i[tail]] + 2 * power
            back = _ends(lambda w, x: h_same(h, first[w] - x, first[w], q[w]), first, np.minimum(first - q, power))  # noqa: B023
            on = _ends(lambda w, x: h_same(h, last[w] + 1, last[w] + 1 + x, q[w]), last, np.minimum(n - 1 - last, power))  # noqa: B023
            start, end = first - back - q, last + on + 1
            long = end - start >= np.maximum(LEAST, TIMES * q)
            found.append(np.stack((start[long], end[long], q[long]), axis=1))
        power *= 2
    return _confirmed(word, np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def prefix_hash_of(word: np.ndarray) -> np.ndarray:
    """Running hashes of numbered words."""
    return prefix_hash(np.ascontiguousarray(word.astype("<u4")).view(np.uint8))


def h_same(h: np.ndarray, a: np.ndarray, b: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Whether words a to b have the hash of those `lag` before."""
    return span_hash(h, 4 * a, 4 * b) == span_hash(h, 4 * (a - lag), 4 * (b - lag))


def _confirmed(word: np.ndarray, claims: np.ndarray) -> np.ndarray:
    """The claims that the words confirm, the smallest period of each stretch."""
    out: dict[tuple[int, int], int] = {}
    again: set[int] = set()
    order = np.lexsort((claims[:, 2], claims[:, 1], claims[:, 0]))
    claims = claims[order]
    new = np.ones(len(claims), bool)
    new[1:] = (claims[1:, :2] != claims[:-1, :2]).any(axis=1)
    smallest = claims[new][np.cumsum(new) - 1, 2]
    for start, end, q in claims[new | (claims[:, 2] % smallest != 0)].tolist():
        if not np.array_equal(word[start + q : end], word[start : end - q]):
            again.add(q)  # the hashes were wrong, so its multiples may be too
            again.update(claims[(claims[:, 0] == start) & (claims[:, 1] == end), 2].tolist())
            continue
        out[start, end] = min(q, out.get((start, end), q))
    for q in again:
        for start, end in _stretches(word, q):
            if end - start >= max(LEAST, TIMES * q):
                out[start, end] = min(q, out.get((start, end), q))
    return np.array(sorted((s, e, q) for (s, e), q in out.items()), np.int64).reshape(-1, 3)


def _rows(texts: pa.Array) -> tuple[list[list[dict]], list[bytes]]:
    """The runs of each text, and its kept words joined by one space."""
    raw, ends = flat(texts)
    a, b, doc = word_spans(raw, ends)
    n = len(ends) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    word = np.unique(numbered(raw, a, b)[0].astype(np.int64) * max(n, 1) + doc, return_inverse=True)[1]
    found = runs_of(word, int(counts.max(initial=0)))
    edges = np.zeros(len(word) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    runs: list[list[dict]] = [[] for _ in range(n)]
    for d, (start, end, q) in zip(doc[found[:, 0]].tolist(), found.tolist(), strict=True):
        runs[d].append({"start": start - int(first[d]), "length": end - start, "period": q})
    data = raw.tobytes()
    places = list(zip(a[kept].tolist(), b[kept].tolist(), strict=True))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(doc[kept], minlength=n)))).tolist()
    return runs, [b" ".join([data[i:j] for i, j in places[x:y]]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


RUN = "struct<start:long,length:long,period:long>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_BYTES):
            runs, texts = _rows(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed: the words
    that no run holds after its first period, joined by one space."""
    one = docs.select(F.col(doc_id).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    return one.mapInArrow(_searched, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, collapsed string")


def seeded(doc_id: Column, text: Column) -> Column:
    """The text, or for documents whose crc32 of the decimal id is a multiple of ten its words
    up to a word and from there the next words over and over. A null id leaves its text."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    over = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    turned = F.concat(F.slice(words, F.lit(1), a), over)
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^ \t-\r]")), F.array_join(turned, " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without a run) and
    digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
