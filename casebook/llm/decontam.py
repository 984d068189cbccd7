"""Benchmark decontamination with spaced seeds. Built-in functions only.

Words are the longest runs of letters and digits, lower-cased. A seed is the hash of
the words at a fixed mask's places; the mask ignores the places between. Seeds of
benchmark items and of documents are joined, and each hit aligns a document with an
item. An alignment is confirmed on the words themselves: the document is contaminated
if at least SHARE of an item's words, or of the words in some WINDOW of it, are at
their places. The two masks meet every item of 13 words or more at that share, whatever
words were substituted; shorter items have a mask of three, two or one words in a row,
which is met as well (tests/llm checks all patterns). These are used only if the
benchmark has such items.

A bit filter of fixed size, built from the benchmark's seeds, drops most places of a
document before the join; what passes it is joined exactly, so a larger benchmark
costs more join rows and loses none.

Edge cases: null and empty texts have no words and no hits; every row is judged by its own text, also if
its id is null or repeated (rows equal in id and text are one); texts of any length are
examined whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import cut, row_key

#: Places of a mask's words. Fixed values.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
#: The least and most words of the items that a mask is for, and the mask. At most a fifth of
#: the words is substituted: 6 to 12 words keep three in a row, 2 to 5 words two.
LONG = tuple((13, 1 << 30, mask) for mask in MASKS)
SHORT = ((6, 12, (0, 1, 2)), (2, 5, (0, 1)), (1, 1, (0,)))
SPAN = 1 + max(mask[-1] for mask in MASKS)
SHARE, WINDOW = 80, 20
#: Powers of two of the filter's 64-bit words, at least and at most: 64 kB to 8 MB.
LEAST_CELLS, MOST_CELLS = 13, 20
#: Alignments are broadcast up to so many rows, of five numbers each; beyond, the texts are shuffled.
BROADCAST_ROWS = 100_000
#: Keys of a document's and of an item's row.
ROW, ITEM = ["r1", "r2"], ["i1", "i2"]


def words(text):
    """The words of a text column, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text):
    return F.transform(words(text), lambda w: F.xxhash64(w))


def masks_for(items: DataFrame) -> tuple:
    """LONG, and those of SHORT that an item of the benchmark needs."""
    n = F.size(words(F.col("text")))
    has = items.agg(*(F.max(n.between(least, most)) for least, most, _ in SHORT)).first()
    return LONG + tuple(short for short, some in zip(SHORT, has, strict=True) if some)


def seeds(rows: DataFrame, keep: list[str], masks: tuple, of_items: bool = False) -> DataFrame:
    """A row for each place of `h` (an array of word hashes): its position and `s`, the
    seed of every mask there (null where the mask does not fit, or is not for the item)."""
    shifted = [F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0))).alias(f"w{k}") for k in range(SPAN)]
    places = rows.select(*keep, F.size("h").alias("n"), F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    fits = lambda least, most, m: F.col(f"w.w{m[-1]}").isNotNull() & (F.col("n").between(least, most) if of_items else F.lit(True))
    return places.select(*keep, "pos", *(F.when(fits(least, most, m), F.xxhash64(F.lit(i), *(F.col(f"w.w{k}") for k in m))).alias(f"s{i}") for i, (least, most, m) in enumerate(masks)))


def long_form(places: DataFrame, keep: list[str], masks: tuple) -> DataFrame:
    """A row for each seed."""
    each = F.explode(F.array(*(F.col(f"s{i}") for i in range(len(masks)))))
    return places.select(*keep, "pos", each.alias("seed")).where("seed IS NOT NULL")


def cells_for(n_seeds: int) -> int:
    """The power of two of 64-bit words with which two bits a seed fill less than half of the filter,
    up to MOST_CELLS (20 million seeds); beyond, more places pass and are joined for nothing."""
    return min(MOST_CELLS, max(LEAST_CELLS, (n_seeds * 4 // 64).bit_length()))


def places_of(cells: int) -> tuple:
    """Word and bit of each of a seed's two places in the filter."""
    mask = (1 << cells) - 1
    return tuple((f"CAST(shiftright({{0}}, {at}) & {mask} AS int)", f"CAST(shiftright({{0}}, {at + MOST_CELLS}) & 63 AS int)") for at in (0, MOST_CELLS + 6))


def bit_filter(targets: DataFrame, cells: int):
    """A scalar: the array of 64-bit words in which the places of all seeds are set."""
    set_ = targets.select(F.explode(F.array(*(F.struct(F.expr(c.format("seed")).alias("cell"), F.expr(b.format("seed")).alias("bit")) for c, b in places_of(cells)))).alias("p"))
    words_ = set_.groupBy("p.cell").agg(F.expr("bit_or(shiftleft(1L, p.bit))").alias("bits"))
    every = targets.sparkSession.range(1 << cells).select(F.col("id").cast("int").alias("cell")).join(words_, "cell", "left")
    return every.agg(F.expr("transform(array_sort(collect_list(struct(cell, coalesce(bits, 0L) AS bits))), x -> x.bits)").alias("table")).scalar()


def maybe(table, seed: str, cells: int):
    """Whether a seed may be in the filter."""
    one = [F.get(table, F.expr(c.format(seed))).bitwiseAND(F.expr(f"shiftleft(1L, {b.format(seed)})")) != 0 for c, b in places_of(cells)]
    return one[0] & one[1]


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """r1, r2, i1, i2, off, n: where the first of an item's n words would lie in a document that shares a seed with it."""
    masks = masks_for(items)
    hashed = items.select(*ITEM, word_hashes(F.col("text")).alias("h")).withColumn("n", F.size("h"))
    targets = cut(long_form(seeds(hashed, [*ITEM, F.col("n").alias("n_words")], masks, True), [*ITEM, "n_words"], masks))
    cells = cells_for(targets.count())
    table = bit_filter(targets, cells)
    places = seeds(docs.select(*ROW, word_hashes(F.col("text")).alias("h")), ROW, masks)
    passing = F.lit(False)
    for i in range(len(masks)):
        passing = passing | F.coalesce(maybe(table, f"s{i}", cells), F.lit(False))
    found = long_form(places.where(passing), ROW, masks).where(maybe(table, "seed", cells))
    hits = found.join(targets.withColumnRenamed("pos", "item_pos"), "seed")
    return hits.select(*ROW, *ITEM, (F.col("pos") - F.col("item_pos")).alias("off"), F.col("n_words").alias("n")).distinct()


def _confirmed(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """r1, r2, doc_id, item_id, off, n_item_words, n_matched: the confirmed alignments of each row."""
    r1, r2 = row_key(doc_id, text)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), r1.alias("r1"), r2.alias("r2"))
    i1, i2 = row_key(item_id, item_text)
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text"), i1.alias("i1"), i2.alias("i2"))
    found = cut(alignments(docs, items.withColumnRenamed("item_text", "text")))
    # a document's alignments in one row, so that its words are split once
    n_found = found.count()
    found = found.groupBy(*ROW).agg(F.collect_list(F.struct(*ITEM, "off", "n")).alias("pairs"))
    if n_found <= BROADCAST_ROWS:
        found = F.broadcast(found)
    texts = docs.join(found, ROW).select(*ROW, "doc_id", words(F.col("text")).alias("w"), "pairs")
    # the document's words at an item's places; those before the document's first word are missing.
    # The words are bound to a lambda's variable, so that all alignments share them
    part = "slice(v, greatest(p.off, 0) + 1, greatest(p.n + least(p.off, 0), 0))"
    parts = F.expr(f"transform(array(w), v -> transform(pairs, p -> struct(p.i1, p.i2, p.off, {part} AS there)))[0]")
    rows = texts.select(*ROW, "doc_id", F.explode(parts).alias("p")).select(*ROW, "doc_id", "p.*")
    rows = rows.join(items.select(*ITEM, "item_id", words(F.col("item_text")).alias("x")), ITEM)
    beside = F.expr("concat(array_repeat(CAST(null AS string), greatest(-off, 0)), there)")
    same = F.zip_with("x", beside, lambda v, y: F.when(v == y, 1).otherwise(0))
    rows = rows.select(*ROW, "doc_id", "item_id", "off", F.size("x").alias("n_item_words"), F.slice(same, 1, F.size("x")).alias("same"))
    # bound to a lambda's variable, so that the windows share one comparison
    total = "aggregate(s, 0, (a, e) -> a + e)"
    best = f"exists(sequence(1, greatest(size(s) - {WINDOW} + 1, 1)), a -> 100 * aggregate(slice(s, a, {WINDOW}), 0, (b, e) -> b + e) >= {SHARE} * {WINDOW})"
    told = F.expr(f"transform(array(same), s -> struct({total} AS n_matched, 100 * {total} >= {SHARE} * size(s) OR size(s) > {WINDOW} AND {best} AS confirmed))[0]")
    rows = rows.withColumn("told", told).where("told.confirmed")
    return rows.select(*ROW, "doc_id", "item_id", "off", "n_item_words", F.col("told.n_matched").alias("n_matched"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, off, n_item_words, n_matched: every confirmed alignment."""
    return _confirmed(docs, items, doc_id, text, item_id, item_text).drop(*ROW).distinct()


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    bad = _confirmed(docs, items, doc_id, "text", "item_id", "text").select(*ROW).distinct()
    r1, r2 = row_key(doc_id, "text")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), r1.alias("r1"), r2.alias("r2"))
    return keyed.join(bad, ROW, "left_anti").select("row.*")
