"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter holds all languages: slice i is a mask with a bit for each language, and
the masks at an n-gram's slices, ANDed, are the languages whose filter has it. A
text's n-grams are counted for each language by bit; the count is corrected for the
filter's false positives, whose share is known from how full each language's bits
are, and the largest corrected count decides.

The n-grams of a language are those that make up at least `min_share` of all its
n-grams, counted over all its training texts, so a filter holds at most
1 / min_share n-grams of each order and language, whatever the size of the corpus.
That bounds what is collected and broadcast.

Edge cases: a null text or one without a letter is `und` with score 0; ties go to
the language that is first by name; texts of any length are used whole; rows with a
null id are training rows, since no remainder is 0; without any training row every
text is `und`; repeated rows and ids give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import chunks
from casebook.llm.words import mix

ORDERS = (2, 3)
HASHES = 3
#: Slices of a filter: 8 for each n-gram of the largest language, within these bounds.
LEAST_SLICES, MOST_SLICES = 1 << 12, 1 << 22
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: the order, the n-grams' hashes and the numbers of their texts.
    Texts are lower-cased; what is no letter is a boundary, which an n-gram may only
    begin or end with."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le"), "<u4")
    is_letter = letters()[points]
    code = np.where(is_letter, points, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    for n in ORDERS:
        if len(code) < n + 1:
            continue
        last = len(code) - n + 1
        value, valid = np.full(last, n, np.uint64), is_letter[:last] | is_letter[n - 1 : n - 1 + last]
        for j in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + code[j : j + last]
            if 0 < j < n - 1:
                valid &= is_letter[j : j + last]
        at = np.flatnonzero(valid)
        yield n, mix(value[at]), owner[np.minimum(at, len(owner) - 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n_order, gram, n: sums over as many texts as memory holds."""
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def joined(parts):
        key = np.concatenate([k for k, _ in parts])
        number = np.concatenate([n for _, n in parts])
        key, where = np.unique(key, return_inverse=True)
        return key, np.bincount(where, weights=number).astype(np.int64)

    def out():
        for (lang, n), parts in held.items():
            key, number = joined(parts)
            for a in range(0, len(key), 100_000):
                k, v = key[a : a + 100_000], number[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(v)], names=["lang", "n_order", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in chunks(batch, "text"):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for n, value, owner in grams(part.column("text").to_pylist()):
                of = number[owner]
                for i, lang in enumerate(names):
                    key, count = np.unique(value[of == i], return_counts=True)
                    parts = held.setdefault((lang, n), [])
                    parts.append((key, count))
                    size += len(key)
        if size > 2_000_000:
            for k in held:
                held[k] = [joined(held[k])]
            size = sum(len(v[0][0]) for v in held.values())
            if size > 1_000_000:
                yield from out()
                size = 0
    yield from out()


@dataclass
class Model:
    languages: list[str]
    slices: np.ndarray  # one row of 64-bit words for each slice, a bit for each language
    false_positive: np.ndarray  # of each language


def places(gram: np.ndarray, slices: int) -> list[np.ndarray]:
    """The slices of n-grams: HASHES places by double hashing."""
    a, b = gram, mix(gram + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(20)) & np.uint64(slices - 1) for i in range(HASHES)]


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", min_share: float = 1e-5) -> Model:
    """A filter learned from all labelled texts (rows with a null label are left out)."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")
    counts = rows.mapInArrow(_counted, "lang string, n_order int, gram long, n long").groupBy("lang", "n_order", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang", "n_order").agg(F.sum("n").alias("total"))
    kept = counts.join(total, ["lang", "n_order"]).where(F.col("n") >= min_share * F.col("total")).select("lang", "gram")
    # at most len(ORDERS) / min_share rows a language
    table = kept.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    which = np.array([languages.index(x) for x in table.column("lang").to_pylist()], np.int64)
    gram = table.column("gram").to_numpy().view(np.uint64) if len(table) else np.zeros(0, np.uint64)
    most = int(np.bincount(which).max()) if len(which) else 0
    n = min(MOST_SLICES, max(LEAST_SLICES, 1 << (8 * most).bit_length()))
    slices = np.zeros((n, -(-max(1, len(languages)) // 64)), np.uint64)
    for i in range(len(languages)):
        bit = np.uint64(1) << np.uint64(i % 64)
        for at in places(gram[which == i], n):
            slices[at.astype(np.int64), i // 64] |= bit
    fill = np.array([np.mean((slices[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
    return Model(languages, slices, fill**HASHES)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """For every text and language, the corrected share of its n-grams that the language has."""
    n_langs = len(model.languages)
    hits, total = np.zeros((len(texts), n_langs)), np.zeros(len(texts))
    for _, gram, owner in grams(texts):
        total += np.bincount(owner, minlength=len(texts))
        for word in range(model.slices.shape[1]):
            column, found = model.slices[:, word], np.uint64(0xFFFFFFFFFFFFFFFF)
            for at in places(gram, len(model.slices)):
                found = found & column[at.astype(np.int64)]
            for i in range(64 * word, min(n_langs, 64 * word + 64)):
                bits = (found >> np.uint64(i - 64 * word)) & np.uint64(1)
                hits[:, i] += np.bincount(owner, weights=bits, minlength=len(texts))
    fp = model.false_positive
    return np.clip((hits - total[:, None] * fp) / np.maximum(total[:, None] * (1 - fp), 1e-9), 0, 1)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                share = scores(model, texts)
                some = np.array([any(map(str.isalpha, t or "")) for t in texts], bool) & bool(model.languages)
                best = np.where(some, share.argmax(1) if model.languages else 0, len(model.languages))
                score = np.where(some, share.max(1) if model.languages else 0, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))
