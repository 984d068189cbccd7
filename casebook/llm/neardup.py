"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find.

In a SuperMinHash signature each element visits all slots in an order of its own, at
its j-th visit with a value in [j, j + 1), and a slot keeps the smallest value. The
ranks of an element are thus correlated, which lowers the variance, and visits stop
as soon as every slot of a document holds less than the level reached: after one
visit an element, for long documents.

Links: rows with equal sets are one class, a node, represented by the text of one row;
only nodes are compared. Bands of the signature make buckets, and buckets with the
same smallest member, their centre, make a group. Small sets, of which a link leaves out one
element, also meet by the fingerprint of the set without it, so none of their links is missed. Every member is compared with the
centre, and then with a second one, the member nearest to the first. In a group of near
copies that joins most members, at the cost of two comparisons each.

Members of a group that are then in different components are compared by their
differences from the second centre c. If x lacks r of its shingles and has a others, let
w = 100 r + t a for similarity t %. Two members whose differences share o elements have
that similarity exactly if (100 + t) o >= w1 + w2 - (100 - t) |c|. So what they share is
counted with an inverted index over the differences, block against block, in bounded
memory; only links that join components leave a task, never pairs. Every link that
decides a component is thus verified on the full sets, and no bucket is capped.

Edge cases: a document of fewer words than a shingle has its whole sequence as one
shingle; without words, or with a null text, its set is empty, it links with nothing
and is its own component. Every row is judged by its own text, whatever its id: a
component has the smallest id of its rows, null if they have none, and keeps a row of
that id, the one of the smallest key if there are several. Only rows equal in id and
text cannot be told apart; `groups` marks them alike and `keep_one` keeps one of them.
Texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import chunks, flat, packed, row_key
from casebook.llm.components import components
from casebook.llm.words import Shingles, mix

#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, all but 7 in a million
#: if bands are independent; of pairs that share 4 of 5 shingles 46 in a million were missed in simulation, which is
#: why small sets meet by fingerprints too.
BANDS, ROWS = 30, 5
#: Slots of a signature: a prime, so that a start and a step order all of them.
SLOTS = 151
#: The key of a row.
ROW = ["r1", "r2"]


def signatures(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of SLOTS values for each set elements[bounds[i]:bounds[i + 1]], without empty sets."""
    n = len(bounds) - 1
    best = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    start = (mix(elements ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SLOTS)).astype(np.int64)
    step = (mix(elements ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    for level in range(SLOTS):
        value = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(8)
        np.minimum.at(best, owner * SLOTS + (start + level * step) % SLOTS, value | np.uint64(level << 56))
        open_ = best.reshape(n, SLOTS).max(axis=1) >= np.uint64((level + 1) << 56)
        goes_on = open_[owner]
        if not goes_on.any():
            break
        elements, owner, start, step = elements[goes_on], owner[goes_on], start[goes_on], step[goes_on]
    return best.reshape(n, SLOTS)


def band_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.zeros((len(best), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(best), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix(key + best[:, band * ROWS + row])
        out[:, band] = key
    return out


def small_sizes(percent: int) -> tuple[int, int]:
    """Sizes of sets of which a link leaves out exactly one element: with fewer only equal sets are
    linked, and from 2 / (1 - similarity) on a pair may differ by two."""
    return (1, 0) if percent >= 100 else (-(-100 // (100 - percent)), -(-200 // (100 - percent)) - 1)


def sketches(docs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """doc_id, r1, r2, n_shingles, fp1 and fp2 (a 128-bit fingerprint of the set, a sum over its elements),
    bands (null for an empty set) and, for sets of small sizes, less: the fingerprints of the set without each element."""
    least, most = small_sizes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                both, bounds = Shingles(*flat(part.column("text")), k).elements()
                elements = both[:, 0].copy()
                sizes = np.diff(bounds)
                parts = [mix(both[:, i] ^ np.uint64(salt)) for i, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))]
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))[bounds] for x in parts]
                whole = [s[1:] - s[:-1] for s in sums]
                fp = [pa.array(x.view(np.int64)) for x in whole]
                small = (sizes >= least) & (sizes <= most)
                of = np.repeat(np.arange(len(sizes)), sizes)
                inside = small[of]
                without = [pa.array((x[of] - y)[inside].view(np.int64)) for x, y in zip(whole, parts, strict=True)]
                ends = pa.array(np.concatenate(([0], np.cumsum(small * sizes))).astype(np.int32))
                less = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(without, ["fp1", "fp2"]), mask=pa.array(~small))
                some = sizes > 0
                keys = np.zeros((len(sizes), BANDS), np.int64)
                if some.any():
                    keys[some] = band_keys(signatures(elements, np.concatenate((bounds[:1], bounds[1:][some])))).view(np.int64)
                offsets = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *ROW)), pa.array(sizes.astype(np.int64)), *fp, bands, less], names=["doc_id", *ROW, "n_shingles", "fp1", "fp2", "bands", "less"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, r1 long, r2 long, n_shingles long, fp1 long, fp2 long, bands array<bigint>, less array<struct<fp1:bigint,fp2:bigint>>")


#: Bytes of text whose shingles a Python step holds at a time.
CHUNK_BYTES = 1 << 19
#: Members of a group that are held together; a larger group is compared block against block.
BLOCK = 4096


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    return pairs.join(of("v"), "v").join(of("u"), "u")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, Shingles, int]]:
    """Batches of bounded text with the shingles of u_text and then of v_text."""
    for batch in batches:
        for piece in chunks(batch, "u_text", CHUNK_BYTES):
            for part in chunks(piece, "v_text", CHUNK_BYTES):
                yield part, Shingles(*flat(pa.concat_arrays([part.column("u_text"), part.column("v_text")])), k), len(part)


def overlaps(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Adds nu, nv and shared, the sizes of the sets of u and v and of their intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shingles, n in _sets(batches, k):
            sets = shingles.numbers()
            us, vs = sets[:n], sets[n:]
            shared = [np.intersect1d(u, v, assume_unique=True).size for u, v in zip(us, vs, strict=True)]
            numbers = [pa.array(x, pa.int64()) for x in (list(map(len, us)), list(map(len, vs)), shared)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in pairs_columns), *numbers], names=[*pairs_columns, "nu", "nv", "shared"])

    pairs_columns = pairs.columns
    rows = _with_texts(pairs, texts).select(*pairs_columns, "u_text", "v_text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return rows.mapInArrow(run, f"{kinds}, nu long, nv long, shared long")


def differences(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Adds nu, lacks, has and delta: how many shingles of u v lacks, how many others it has, and both as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shingles, n in _sets(batches, k):
            elements, bounds = shingles.elements()
            sets = [elements[a:b, 0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            us, vs = sets[:n], sets[n:]
            lacks = [np.setdiff1d(u, v, assume_unique=True) for u, v in zip(us, vs, strict=True)]
            has = [np.setdiff1d(v, u, assume_unique=True) for u, v in zip(us, vs, strict=True)]
            numbers = [pa.array(list(map(len, x)), pa.int64()) for x in (us, lacks, has)]
            delta = pa.array([np.concatenate(x).view(np.int64) for x in zip(lacks, has, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in pairs_columns), *numbers, delta], names=[*pairs_columns, "nu", "lacks", "has", "delta"])

    pairs_columns = pairs.columns
    rows = _with_texts(pairs, texts).select(*pairs_columns, "u_text", "v_text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return rows.mapInArrow(run, f"{kinds}, nu long, lacks long, has long, delta array<bigint>")


def joining_links(ids: list, component: list, weight: np.ndarray, delta: list[np.ndarray], side: np.ndarray, size: int, percent: int) -> list[tuple]:
    """Links between members of different components, enough to join them, of members
    whose differences from one set of `size` elements are given. side: 1 and 2 for the
    two blocks to compare, 3 for members of both."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in delta])))
    number = np.unique(np.concatenate(delta), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))[order]
    first = np.searchsorted(number[order], np.arange(len(bounds) and (number.max() + 2 if len(number) else 1)))
    root = {c: c for c in component}
    code = {c: i for i, c in enumerate(root)}
    codes = np.array([code[c] for c in component])

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out, free = [], (100 - percent) * size
    for x in np.flatnonzero((side & 1 > 0) & (weight > free)):
        mine = number[bounds[x] : bounds[x + 1]]
        spans = [owner[first[e] : first[e + 1]] for e in mine]
        shared = np.bincount(np.concatenate(spans), minlength=len(ids)) if spans else np.zeros(len(ids), np.int64)
        linked = np.flatnonzero(((100 + percent) * shared >= weight[x] + weight - free) & (codes != codes[x]) & (side & 2 > 0))
        for y in linked[np.unique(codes[linked], return_index=True)[1]]:
            a, b = find(component[x]), find(component[y])
            if a != b:
                root[a] = b
                out.append((ids[x], ids[y]))
    return out


def far_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join components within groups. rows: g, v, component, nu, w, delta."""
    kind = rows.schema["v"].dataType.simpleString()
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    rows = rows.join(sizes, "g").withColumn("block", F.expr("CAST(pmod(xxhash64(v), n_blocks) AS int)"))
    # a block meets every block, itself too; which of the two is first matters, since only
    # members that are far from the centre look for partners
    others = F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)
    one = F.struct(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(3).alias("side"))
    ways = F.flatten(F.transform(F.filter(others, lambda j: j != F.col("block")), lambda j: F.array(F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(1).alias("side")), F.struct(j.alias("i"), F.col("block").alias("j"), F.lit(2).alias("side")))))
    rows = rows.withColumn("way", F.explode(F.concat(F.array(one), ways))).select("g", "way.*", "v", "component", "nu", "w", "delta")

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        delta = [np.asarray(x, np.int64) for x in table.column("delta").to_pylist()]
        links = joining_links(table.column("v").to_pylist(), table.column("component").to_pylist(), column("w"), delta, column("side"), int(column("nu")[0]), percent)
        kinds = table.schema.field("v").type
        return pa.table({"u": pa.array([a for a, _ in links], kinds), "v": pa.array([b for _, b in links], kinds)})

    return rows.groupBy("g", "i", "j").applyInArrow(run, f"u {kind}, v {kind}")


def _judged(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, r1, r2, n_shingles, component_id and is_first (the text of the component that `keep_one` keeps), one row per row."""
    r1, r2 = row_key(doc_id, text)
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), r1.alias("r1"), r2.alias("r2"))
    sketched = packed(sketches(one, k, percent))
    same = ["fp1", "fp2", "n_shingles"]
    # the first of a class: a null id comes last
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)).alias("best")
    nodes = packed(sketched.where("n_shingles > 0").groupBy(*same).agg(best, F.first("bands").alias("bands"), F.first("less").alias("less")).withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select(F.col("node").alias("v"), F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("v").alias("u"), F.max("v").alias("last")).where("u <> last").select("key", "u")
    pairs = members.join(buckets, "key").where("u <> v").select("u", "v")
    # of small sets every pair that can be linked, by the fingerprint of the smaller one
    larger = nodes.select(F.col("node").alias("v"), (F.col("n_shingles") - 1).alias("n_shingles"), F.explode("less").alias("l")).select("v", "n_shingles", "l.*")
    pairs = packed(pairs.union(nodes.select(F.col("node").alias("u"), *same).join(larger, same).select("u", "v")).distinct())
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    needed = nodes.select("node", "best.r1", "best.r2").join(needed, "node", "left_semi")
    texts = packed(one.select(*ROW, "text").join(needed, ROW).select("node", "text").dropDuplicates(["node"]))
    linked = f"100 * shared >= {percent} * (nu + nv - shared)"
    # every member with its group's centre, then with the member nearest to that
    w = F.expr(f"100 * (nu - shared) + {percent} * (nv - shared)")
    first = packed(overlaps(pairs, texts, k).withColumn("w", w)).withColumnRenamed("u", "g")
    second = first.groupBy("g").agg(F.min(F.struct("w", "v")).alias("m"), F.count("*").alias("n")).where("n > 1").select("g", F.col("m.v").alias("u"), "n")
    rest = first.select("g", "v").join(second, "g").where("u <> v")
    after = packed(overlaps(rest, texts, k))
    near = first.where(linked).select(F.col("g").alias("u"), "v").unionByName(after.where(linked).select("u", "v"))
    # members of larger groups that are not in one component by now
    joined = components(near)
    placed = after.where("n > 2").select("g", "u", "v").join(joined.withColumnRenamed("id", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    mixed = placed.groupBy("g").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("g")
    apart = differences(placed.join(mixed, "g").select("g", "u", "v", "component"), texts, k).withColumn("w", F.expr(f"100 * lacks + {percent} * has"))
    far = far_links(apart.select("g", "v", "component", "nu", "w", "delta"), percent)
    final = components(joined.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(far))
    # a class's component, and the first row of all its classes
    placed = nodes.select(*same, "node", "best").join(final.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = placed.groupBy("component").agg(F.min("best").alias("first"))
    placed = placed.join(firsts, "component").select(*same, "first")
    rows = sketched.select("doc_id", *ROW, *same).join(placed, same, "left")
    is_first = (F.col("r1") == F.col("first.r1")) & (F.col("r2") == F.col("first.r2"))
    return rows.select("doc_id", *ROW, "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.coalesce(is_first, F.lit(True)).alias("is_first"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept (doc_id is component_id; null ids are equal), one row per row."""
    return _judged(docs, k, percent, doc_id, text).drop(*ROW, "is_first").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, of its smallest id, with all its columns."""
    judged = _judged(docs, k, percent, doc_id, text).where("n_shingles > 0")
    told = packed(judged.groupBy(*ROW).agg(F.max("is_first").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1").drop("n"))
    r1, r2 = row_key(doc_id, text)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), r1.alias("r1"), r2.alias("r2"))
    # of rows equal in id and text, one
    equal = keyed.join(told.where("kept"), ROW, "left_semi").dropDuplicates(ROW)
    return keyed.join(told, ROW, "left_anti").unionByName(equal).select("row.*")
