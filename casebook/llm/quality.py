"""Quality rules as a bitmask ledger.

Each document is measured once; every rule sets one bit of `fail_bits` where the
document fails it. A policy is a versioned mask of the rules that count, so a new
policy, or the effect of leaving a rule out, needs the ledger and not the texts.

Edge cases: a null or empty text has no words, so it fails `too_few_words`;
repeated rows and ids give a row each; a null id stays null; an empty table gives
an empty ledger. Texts of any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import chunks, flat
from casebook.llm.words import numbered, windows, word_spans

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower"]
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CONTINUES = (np.arange(256) & 0xC0) == 0x80

#: Rule, and the SQL condition under which a document fails it. Bit i is rule i.
RULES = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "n_upper > n_lower"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BASE_RULES = ("too_few_words", "repeated_words")
#: Versioned policies: the rules of which none may fail.
POLICIES = {1: tuple(name for name, _ in RULES), 0: BASE_RULES}


def mask(rules) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(name) for name in rules)


def _duplicated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(keys), bool)
    out[order] = same
    return out


def measure(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of every text."""
    raw, ends = flat(texts)
    n = len(ends) - 1
    count = lambda of: np.bincount(of, minlength=n)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[ends])
    a, b, doc = word_spans(raw, ends)
    points = np.concatenate(([0], np.cumsum(~CONTINUES[raw])))
    word_chars = np.bincount(doc, weights=points[b] - points[a], minlength=n).astype(np.int64)

    grams, at = windows(numbered(raw, a, b)[0], doc, 3)
    twice = at[_duplicated(grams * n + doc[at])]
    covered = np.zeros(len(a), bool)
    for j in range(3):
        covered[twice + j] = True

    breaks = np.flatnonzero(raw == 0x0A)
    line_a = np.unique(np.concatenate((ends[:-1], breaks + 1)))  # a line starts here, or only ends there
    line_a = line_a[line_a < len(raw)]
    owner = np.searchsorted(ends, line_a, side="right") - 1
    line_b = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, line_a)], ends[owner + 1])
    words_before = np.searchsorted(a, line_b) - np.searchsorted(a, line_a)
    line_a, line_b, owner = (x[words_before > 0] for x in (line_a, line_b, owner))
    distinct = np.unique(numbered(raw, line_a, line_b)[0] * n + owner, return_index=True)[1]
    n_lines = count(owner)
    return [
        count(doc), word_chars, total(SYMBOLS[raw]), n_lines, n_lines - count(owner[distinct]), count(doc[covered]),
        total((raw >= 65) & (raw <= 90)), total((raw >= 97) & (raw <= 122)),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            values = measure(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(v.astype(np.int64)) for v in values)], names=["row", *MEASURES])


def _judged(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`row` (a struct of the columns to keep), MEASURES and `fail_bits` of every row."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    measured = rows.mapInArrow(_measured, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(bits).cast("long"))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, MEASURES and `fail_bits`, one row per document."""
    return _judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text").select("row.doc_id", *MEASURES, "fail_bits")


def keep(docs: DataFrame, version: int = 1, text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with all their columns."""
    return apply_policy(_judged(docs, docs.columns, text), version).where("kept").select("row.*")


def apply_policy(ledger_rows: DataFrame, version: int = 1) -> DataFrame:
    """Adds `base_failed` and `kept`."""
    fails = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules))) != 0
    return ledger_rows.withColumn("base_failed", fails(BASE_RULES)).withColumn("kept", ~fails(set(POLICIES[version]) | set(BASE_RULES)))


def ablations(ledger_rows: DataFrame, version: int = 1) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail no other rule, and
    that would be kept without it. At most 2**rules groups leave the aggregation; an empty
    ledger has no row."""
    rules = POLICIES[version]
    groups = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).cast("long").alias("bit")) for name in rules))
    rows = groups.withColumn("r", F.explode(each)).select("bits", "n", "r.*")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseOR(F.col("bit")) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
