"""Words and shingles of many texts at once, in numpy arrays.

A word is a longest run of characters other than space and U+0009 to U+000D. Within the
texts at hand words, lines and shingles are numbered, equal numbers for equal bytes only:
hashes propose what is equal and the bytes decide. Across batches words are known by a
cryptographic digest of 128 bits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
GOLDEN = np.uint64(BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(21, int(n).bit_length()))
    return up[:n], down[:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running sums h; span_hash(h, a, b) is then the hash of raw[a:b]. Modulo 2**64, so
    different texts can be made to have equal hashes: it proposes and never decides."""
    up, _ = powers(len(raw) + 1)
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[:-1], out=h[1:])
    return h


def span_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[b] - h[a]) * down[a] + (b - a).astype(np.uint64))


#: The bytes that count of eight loaded at once, by how many of them belong to the span.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def same_bytes(raw: np.ndarray, a: np.ndarray, c: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from each a on are those from each c on, eight at a time."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    out = np.ones(len(a), bool)
    todo, done = np.flatnonzero(size > 0), 0
    while len(todo):
        rest = size[todo] - done
        differ = (eight[a[todo] + done] ^ eight[c[todo] + done]) & LOW[np.minimum(rest, 8)] != 0
        out[todo[differ]] = False
        todo = todo[~differ & (rest > 8)]
        done += 8
    return out


def numbered(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal for equal bytes only, and where each number is first met."""
    _, first, number = np.unique(span_hash(prefix_hash(raw), a, b), return_index=True, return_inverse=True)
    model = first[number]
    other = np.flatnonzero(model != np.arange(len(a)))
    size = b[other] - a[other]
    wrong = other[(size != b[model[other]] - a[model[other]]) | ~same_bytes(raw, a[other], a[model[other]], np.minimum(size, b[model[other]] - a[model[other]]))]
    known: dict[bytes, int] = {}  # spans that share a hash with others
    more = []
    for i in wrong.tolist():
        key = raw[a[i] : b[i]].tobytes()
        if key not in known:
            known[key] = len(first) + len(more)
            more.append(i)
        number[i] = known[key]
    return number, np.concatenate((first, np.array(more, first.dtype)))


def digests(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two columns: a digest of 128 bits of each span."""
    data = raw.tobytes()
    blake = hashlib.blake2b
    whole = b"".join([blake(data[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    return np.frombuffer(whole, "<u8").reshape(-1, 2)


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and text number of every word; no word crosses texts."""
    inside = ~SEPARATORS[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(ends, a, side="right") - 1


def windows(number: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each k neighbours within a text, equal for equal neighbours only, and
    the index of the first of them."""
    n = len(number) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = number[at].astype(np.int64)
    if len(at):
        most = int(number.max()) + 1
        for j in range(1, k):
            out = np.unique(out * most + number[at + j], return_inverse=True)[1]
    return out, at


class Shingles:
    """The distinct k-word shingles of every text, A-Z lower-cased. A text of fewer words has
    its whole sequence as one shingle; a text without words has none."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, k: int):
        self.raw, self.k, self.n_docs = LOWER[raw], k, len(ends) - 1
        self.a, self.b, self.doc = word_spans(raw, ends)
        self.word, self.first = numbered(self.raw, self.a, self.b)
        counts = np.bincount(self.doc, minlength=self.n_docs)
        self.short = np.flatnonzero((counts > 0) & (counts < k))
        self.n_words = counts[self.short]
        self.begin = np.concatenate(([0], np.cumsum(counts)))[self.short]

    def numbers(self) -> list[np.ndarray]:
        """The set of each text, as numbers that are equal for equal shingles only."""
        grams, at = windows(self.word, self.doc, self.k)
        most = int(grams.max()) + 1 if len(grams) else 0
        known: dict[tuple, int] = {}
        extra = [most + known.setdefault(tuple(self.word[i : i + n].tolist()), len(known)) for i, n in zip(self.begin.tolist(), self.n_words.tolist(), strict=True)]
        grams, owner = np.concatenate((grams, np.array(extra, np.int64))), np.concatenate((self.doc[at], self.short))
        most += len(known) + 1
        found = np.unique(owner * most + grams)
        bounds = np.searchsorted(found, np.arange(self.n_docs + 1) * most)
        return [found[a:b] % most for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def elements(self) -> tuple[np.ndarray, np.ndarray]:
        """The sets as two columns of hashes, from the digests of their words, so the same in
        every batch; sorted by the first column within each text. And n + 1 bounds."""
        told = digests(self.raw, self.a[self.first], self.b[self.first])[self.word] if len(self.first) else np.zeros((0, 2), np.uint64)
        n = max(0, len(told) - self.k + 1)
        at = np.flatnonzero(self.doc[:n] == self.doc[self.k - 1 :])
        grams, owner = np.zeros((len(at), 2), np.uint64), self.doc[at]
        for j in range(self.k):
            grams = mix(grams + told[at + j] + np.uint64(j + 1))
        if len(self.short):
            extra = np.zeros((len(self.short), 2), np.uint64)
            for j in range(self.k - 1):
                has = np.flatnonzero(self.n_words > j)
                extra[has] = mix(extra[has] + told[self.begin[has] + j] + np.uint64(j + 1))
            grams, owner = np.concatenate((grams, mix(extra + np.uint64(self.k)))), np.concatenate((owner, self.short))
            order = np.argsort(owner, kind="stable")
            grams, owner = grams[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(self.n_docs + 1))
        order = np.concatenate([a + np.argsort(grams[a:b, 0]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] or [np.zeros(0, np.int64)])
        grams = grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:, 0] != grams[:-1, 0]) | (owner[1:] != owner[:-1])
        return grams[new], np.concatenate(([0], np.cumsum(new)))[bounds]
