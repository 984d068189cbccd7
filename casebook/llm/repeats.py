"""Repeated passages: every byte that a string of SIZE bytes covers which also starts elsewhere.

A string of SIZE bytes holds SIZE - CORE + 1 substrings of CORE bytes; the one with the
smallest hash (leftmost among equals) is its anchor. Equal strings have equal anchors at
equal offsets, so all occurrences of a repeat meet at an anchor with the same core. Only
cores that occur twice or more are looked at further, each occurrence with the bytes
around it that a string can reach.

For each core an enhanced suffix array is built of its occurrences' suffixes: sorted
suffixes and the common prefix lengths of neighbours. A stack scan gives the tree of
common-prefix intervals; within each interval the occurrences are tested for diverse left
extensions, in the order of their reversed left contexts, which gives every member the
longest left extension that it shares with another member. An interval of prefix length
r, whose members share a left extension of l, is a repeat if l + r reaches the size.
Interval members are all occurrences of a maximal repeat, not only neighbours.

Of a frequent core the top of that tree is descended in parallel instead: occurrences are
grouped by what they share around the core, partial aggregates give the extents that all
members of a group share (the common prefix of the least and the greatest context), and
a group splits where its contexts differ next. Only the bytes that are still open go along, and
members that are alike in these are settled and go on as one. A group is gathered in one task once it
has at most GROUP members; those that share a whole string need no further look at it.

Hashes only choose anchors and propose cores; equality is decided by bytes, or by 128-bit
cryptographic digests of them where the bytes are not at hand.

Edge cases: null and empty texts have no bytes and keep none; texts under SIZE bytes keep
all; repeated rows count as copies of each other; null and repeated ids give a row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import chunks, cut, flat, new_folder
from casebook.llm.words import prefix_hash, span_hash

SIZE, CORE = 400, 128
#: Bytes that a string reaches beyond its core, on both sides together.
REACH = SIZE - CORE
#: Occurrences that are gathered in one place.
GROUP = 20_000
#: Texts with a frequent core are looked up by broadcast up to so many, with MOST_ANCHORS of these cores in all.
BROADCAST_ROWS, MOST_ANCHORS = 50_000, 500_000


def minima(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of SIZE bytes, where its anchor begins; and the hash of every core."""
    n = len(raw) - CORE + 1
    at = np.arange(n)
    cores = span_hash(prefix_hash(raw), at, at + CORE)
    least, width = (cores & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), cores


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and place in its text of every anchor."""
    none = np.zeros(0, np.int64)
    if len(raw) < SIZE:
        return none.astype(np.uint64), none, none
    at, cores = minima(raw)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(at)]
    whole = ends[doc + 1] - np.arange(len(at)) >= SIZE
    at, doc = at[whole], doc[whole]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at, doc = at[new], doc[new]
    return cores[at], doc, at - ends[doc]


def common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a and b, at most `limit`."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, limit)


class Ordered:
    """Strings in sorted order, with common prefix lengths of neighbours and, by range minima, of any two."""

    def __init__(self, strings: list[bytes]):
        n = len(strings)
        self.order = np.array(sorted(range(n), key=strings.__getitem__), np.int64)
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        size = np.array([len(s) for s in strings])[self.order]
        table = np.frombuffer(b"".join(strings[i].ljust(REACH, b"\0") for i in self.order), np.uint8).reshape(n, REACH)
        self.lcp = np.zeros(n, np.int64)  # with the one before
        for a in range(1, n, 50_000):
            b = min(n, a + 50_000)
            self.lcp[a:b] = common(table[a - 1 : b - 1], table[a:b], np.minimum(size[a - 1 : b - 1], size[a:b]))
        self.minima: list[np.ndarray] | None = None

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of strings of ranks a < b."""
        if self.minima is None:
            self.minima = [self.lcp]
            width = 1
            while 2 * width <= len(self.lcp):
                last = self.minima[-1]
                self.minima.append(np.minimum(last[:-width], last[width:]))
                width *= 2
        out = np.empty(len(a), np.int64)
        level = np.frexp((b - a).astype(float))[1] - 1
        for k in np.unique(level):
            of = level == k
            row = self.minima[k]
            out[of] = np.minimum(row[a[of] + 1], row[b[of] - (1 << int(k)) + 1])
        return out


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(prefix length, first, end) of every common-prefix interval of two or more, children first."""
    stack = [(0, 0)]  # prefix length and first
    n = len(lcp)
    for i in range(1, n + 1):
        value, first = (int(lcp[i]) if i < n else -1), i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            if i - first > 1:
                yield length, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def reaches(lefts: list[bytes], rights: list[bytes], need: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeats around each occurrence of one core reach to the left and the
    right, `need` bytes together; -1 where there is none. lefts: reversed contexts before the core."""
    n = len(lefts)
    best = np.full((2, n), -1)
    right, left = Ordered(rights), Ordered(lefts)
    for length, a, b in intervals(right.lcp):
        members = right.order[a:b]
        members = members[np.argsort(left.rank[members])]
        ranks = left.rank[members]
        step = left.between(ranks[:-1], ranks[1:])
        shared = np.zeros(len(members), np.int64)  # the left extension shared with some other member
        shared[1:] = step
        shared[:-1] = np.maximum(shared[:-1], step)
        repeat = shared + length >= need
        hit = members[repeat]
        best[0, hit] = np.maximum(best[0, hit], shared[repeat])
        best[1, hit] = np.maximum(best[1, hit], length)
    return best[0], best[1]


ROW = ["r1", "r2"]


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Adds r1 and r2, which are equal for equal rows only."""
    one = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return one.withColumn("r1", F.xxhash64("doc_id", "text")).withColumn("r2", F.xxhash64(F.lit(1), "text", "doc_id"))


def found_anchors(rows: DataFrame) -> DataFrame:
    """r1, r2, core and pos of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                core, doc, pos = anchors(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(doc)) for c in ROW), pa.array(core.view(np.int64)), pa.array(pos.astype(np.int32))], names=[*ROW, "core", "pos"])

    return rows.select(*ROW, "text").mapInArrow(run, "r1 long, r2 long, core long, pos int")


def contexts(rows: DataFrame) -> DataFrame:
    """r1, r2, node (a digest of the core), pos, before (reversed), after and kind (a digest of all
    three), for each of `anchors`, the places of cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("node", pa.binary()), ("pos", pa.int32()), ("before", pa.binary()), ("after", pa.binary()), ("kind", pa.binary())])
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        blake = hashlib.blake2b
        for batch in batches:
            out = []
            for r1, r2, text, found in zip(*(batch.column(c).to_pylist() for c in (*ROW, "text", "anchors")), strict=True):
                data = text.encode()
                for a in found:
                    first = max(0, a - REACH)
                    kind = blake(data[first : a + CORE + REACH], digest_size=16, salt=(a - first).to_bytes(4, "big"))
                    out.append((r1, r2, blake(data[a : a + CORE], digest_size=16).digest(), a, data[first:a][::-1], data[a + CORE : a + CORE + REACH], kind.digest()))
                if len(out) > 5000:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

    # all columns go in, so that the shuffled texts serve the last step too
    return rows.mapInArrow(run, "r1 long, r2 long, node binary, pos int, before binary, after binary, kind binary")


#: Up to so many different contexts of a group are compared pair by pair.
FEW = 8


def _pairwise(keys: list[tuple[bytes, bytes]], need: int) -> tuple[list[int], list[int]]:
    """What `reaches` returns, of a few contexts."""
    lefts, rights = [-1] * len(keys), [-1] * len(keys)
    for i, (before, after) in enumerate(keys):
        for j in range(i):
            left, right = len(commonprefix((before, keys[j][0]))), len(commonprefix((after, keys[j][1])))
            if left + right >= need:
                for k in (i, j):
                    lefts[k], rights[k] = max(lefts[k], left), max(rights[k], right)
    return lefts, rights


def _resolve(rows: list[tuple]) -> list[tuple[int, int, int, int, int]]:
    """The first three columns, left and right of what repeats cover, of rows (three columns, node, before, after, need) sorted by node."""
    out, at = [], 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][3] == rows[at][3]:
            end += 1
        classes: dict[tuple[bytes, bytes], list[tuple]] = {}
        for row in rows[at:end]:
            classes.setdefault(row[4:6], []).append(row)
        keys, need = list(classes), rows[at][6]
        if len(keys) > 1:
            found = _pairwise(keys, need) if len(keys) <= FEW else reaches([k[0] for k in keys], [k[1] for k in keys], need)
            for key, left, right in zip(keys, *found, strict=True):
                if left >= 0:
                    out += [(*row[:3], int(left), int(right)) for row in classes[key]]
        for (before, after), same in classes.items():
            if len(same) > 1 and len(before) + len(after) >= need:
                out += [(*row[:3], len(before), len(after)) for row in same]
        at = end
    return out


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Three columns of numbers, left and right (how far repeats reach from the core), of the groups by
    node. rows: the columns, node, before, after and need, the bytes that a string takes from both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held):
            if spans := _resolve(held):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans, strict=True)], names=[*keys, "left", "right"])

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= 2 * GROUP:
                cut_at = len(held)
                while cut_at and held[cut_at - 1][3] == held[-1][3]:
                    cut_at -= 1
                yield from told(held[:cut_at])
                held = held[cut_at:]
        yield from told(held)

    together = rows.select(*keys, "node", "before", "after", "need").repartition("node").sortWithinPartitions("node")
    return together.mapInArrow(run, ", ".join(f"{c} long" for c in (*keys, "left", "right")))


def _shared(stats: DataFrame) -> DataFrame:
    """node, n, left and right: the extents that all members of a group share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = lambda p, q: next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))  # noqa: B905, E731
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("b0", "b1", "a0", "a1")}
            left, right = ([prefix(p, q) for p, q in zip(c[x], c[y], strict=True)] for x, y in (("b0", "b1"), ("a0", "a1")))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["node", "n", "left", "right"])

    return stats.mapInArrow(run, "node binary, n long, left int, right int")


def _stretch(left, right) -> tuple:
    return *ROW, (F.col("pos") - left).cast("long").alias("a"), (F.col("pos") + CORE + right).cast("long").alias("b")


def _with_few(rows: DataFrame, anchors_: DataFrame) -> DataFrame:
    """Joins on ROW; the anchors are broadcast if they are few."""
    n, places = anchors_.agg(F.count("*"), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()
    return rows.join(F.broadcast(anchors_) if n <= BROADCAST_ROWS and places <= MOST_ANCHORS else anchors_, ROW)


def settled_kinds(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences with equal contexts are copies of each other all the way, so each of them is
    settled and one is enough to compare the others with. Returns r1, r2, a, b of what is
    settled, and r1, r2, anchors of one occurrence of each kind; contexts are not stored."""
    spark = rows.sparkSession
    folder = new_folder(spark, "kinds")
    contexts(_with_few(rows, hot)).select(*ROW, "pos", F.length("before").alias("left"), F.length("after").alias("right"), "kind").write.parquet(folder)
    light = spark.read.parquet(folder)
    kinds = cut(light.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "pos")).alias("one")))
    spans = light.join(kinds.where("n > 1"), "kind").select(*_stretch(F.col("left"), F.col("right")))
    return spans, cut(kinds.groupBy("one.r1", "one.r2").agg(F.collect_set("one.pos").alias("anchors")))


def descended(rows: DataFrame, group: int) -> DataFrame:
    """r1, r2, a, b of the stretches that repeats cover, of occurrences of frequent cores.

    A group looks for strings that take x to y bytes from the left of the core and the rest
    from its right; its members share the x bytes and the REACH - y, and only the bytes that
    follow on both sides, y - x at most, go along. Members that are alike in these are settled, and
    one of them goes on. If all share `left` and `right`, strings within these are settled: all
    members have them if they fit. The others take more than `left` from the left or more than
    `right` from the right. A group that is split this way differs at the next byte; ranges
    are halved as well, so there are at most as many rounds as REACH has bits. All stretches of
    an occurrence hold its core, so the farthest reaches to both sides tell their union.
    """
    spark = rows.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(spark, name)
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    rows = stored(rows.select(*ROW, "node", "pos", "before", "after").withColumn("id", F.monotonically_increasing_id()), "occurrences")
    todo = rows.select("id", "node", F.lit(0).alias("x"), F.lit(REACH).alias("y"), "before", "after").where(f"length(before) + length(after) >= {REACH}")
    gather, found = [], []
    reach = lambda df, left, right: df.select("id", (F.col("x") + left).cast("long").alias("left"), (REACH - F.col("y") + right).cast("long").alias("right"))
    alike = ["node", "x", "y", "before", "after"]
    while True:
        todo = stored(todo, "groups")
        kinds = stored(todo.groupBy(*alike).agg(F.count("*").alias("n"), F.min("id").alias("id")), "kinds")
        same = todo.join(kinds.where("n > 1").select("node", "before", "after"), ["node", "before", "after"])
        found.append(reach(same, F.length("before"), F.length("after")))
        kinds = kinds.drop("n")
        least = [f(c).alias(f"{c[0]}{i}") for c in ("before", "after") for i, f in enumerate((F.min, F.max))]
        # a table of its own, so that the join can be split at frequent keys
        stats = cut(_shared(kinds.groupBy("node").agg(F.count("*").alias("n"), *least).where("n > 1")))
        told = stored(kinds.join(stats, "node"), "told")
        gather.append(told.where(F.col("n") <= group).select("id", "x", "y", "node", "before", "after", F.expr("y - x").alias("need")))
        if not stats.where(F.col("n") > group).limit(1).count():
            break
        large = told.where(F.col("n") > group)
        found.append(reach(large.where("left + right >= y - x"), F.col("left"), F.col("right")))
        # of x + left and REACH - y + right bytes that all share, strings with `settled` bytes at most from the left take more from the right
        left, settled = F.expr("x + left"), F.expr("least(x + left, y - 1 - right)")
        halves = lambda a, b: (F.struct(a.alias("a"), F.floor((a + b) / 2).cast("int").alias("b")), F.struct((F.floor((a + b) / 2) + 1).cast("int").alias("a"), b.alias("b")))
        ways = F.array(*halves(left + 1, F.col("y")), *halves(F.col("x"), settled))
        parts = large.withColumn("way", F.explode(ways)).select("id", "node", "x", "y", "before", "after", "way.a", "way.b")
        parts = parts.where("a <= b AND length(before) >= a - x AND length(after) >= y - b")
        held = F.concat(F.col("node"), F.encode(F.format_string("%d,%d,", "a", "b"), "utf-8"), F.expr("substring(before, 1, a - x)"), F.expr("substring(after, 1, y - b)"))
        open_ = [F.expr("substring(before, a - x + 1, b - a)").alias("before"), F.expr("substring(after, y - b + 1, b - a)").alias("after")]
        todo = parts.select("id", F.unhex(F.substring(F.sha2(held, 256), 1, 32)).alias("node"), F.col("a").alias("x"), F.col("b").alias("y"), *open_).where("length(before) + length(after) >= y - x")
    last = gathered(reduce(DataFrame.unionByName, gather), ["id", "x", "y"])
    found = reduce(DataFrame.unionByName, [*found, reach(last, F.col("left"), F.col("right"))])
    found = found.groupBy("id").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return rows.select("id", *ROW, "pos").join(found, "id").select(*_stretch(F.col("left"), F.col("right")))


def repeated(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """r1, r2, a, b of the stretches that repeats cover, which may overlap."""
    spark = rows.sparkSession
    folder = new_folder(spark, "anchors")
    found_anchors(rows).write.parquet(folder)
    found = spark.read.parquet(folder)
    # a table of its own, so that the join can be split at frequent cores
    times = cut(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    found = found.join(times, "core")
    found = cut(found.groupBy(*ROW, (F.col("n") > group).alias("hot")).agg(F.collect_set("pos").alias("anchors")))
    few = contexts(rows.join(found.where("NOT hot").drop("hot"), ROW)).withColumn("need", F.lit(REACH))
    few = gathered(few, [*ROW, "pos"]).select(*_stretch(F.col("left"), F.col("right")))
    hot = found.where("hot").drop("hot")
    if not hot.limit(1).count():
        return few
    settled, kinds = settled_kinds(rows, hot)
    left = descended(contexts(_with_few(rows, kinds)), group)
    return few.unionByName(settled).unionByName(left)


def spans_of(docs: DataFrame, doc_id: str, text: str, group: int) -> DataFrame:
    """doc_id, text and `spans` (null if nothing repeats) of every row."""
    rows = numbered(docs, doc_id, text)
    spans = repeated(rows, group).groupBy(*ROW).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return rows.join(spans, ROW, "left").select("doc_id", "text", "spans")


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found = spans_of(docs, doc_id, text, group)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, gone, left, at = whole.encode(), merged(spans), hashlib.sha256(), 0
                for a, b in gone:
                    left.update(data[at:a])
                    at = b
                left.update(data[at:])
                out.append((len(data), sum(b - a for a, b in gone), len(gone), left.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*out, strict=True))], names=names)

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
