"""BPE encoding and decoding with a compiled tokenization automaton.

The automaton starts as one state that loops on every base symbol. Each merge
(u, v) -> w, taken in order, is composed into it as a gadget: the state after u is
replaced by a copy without its v arc, and every state that has a u arc gets a w arc
to where v led. What remains accepts exactly the correct tokenizations, and each
word has one path. Copies share their arcs: the state after a token is given by
the chain of tokens it ends with, so the table of cut arcs, with the step at which
each was cut, is the whole automaton (one entry a merge).

To read symbols and not tokens, its arcs are spelled out and the subsets of open arcs
made states: a deterministic automaton with one table entry for each state and symbol.
A state tells the last arc of the only path to it, so a word is encoded by one table
lookup a symbol and a walk back along the path. Entries are made when they are first
met, since few of the possible states occur. Decoding emits arc labels.

Edge cases: a null text is encoded as an empty one; an empty text has no tokens and
decodes to an empty text; words and texts of any length are encoded whole; special
tokens in a text get their own ids; repeated rows and ids give a row each.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Characters on which all Unicode versions agree: the words of such texts are split here, others by the tokenizer file's own rules.
AGREED = re.compile("[^\x00-ɏ‐-‧€]")
NEVER = 1 << 60
#: Words whose ids are kept in memory, twice this at most.
MEMORY = 100_000
#: States that are kept; beyond, the table is begun anew.
STATES = 100_000
#: The arc before the first one.
START = (1 << 20) - 1


def _byte_symbols() -> list[str]:
    """The visible stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Automaton:
    """Compiled from `vocab` (token to id) and `merges` (pairs of tokens, in order)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>"):
        self.suffix = suffix
        self.label = {i: t for t, i in vocab.items()}
        self.arcs = dict(vocab)  # label to arc
        self.cut: dict[tuple[int, int], int] = {}  # (u, v): the step at which the state after u lost its v arc
        self.parts: dict[int, tuple[int, int, int]] = {}  # w: u, v, the step at which it got its arcs
        for step, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if w in self.parts or w in (u, v):
                raise ValueError(f"merge {step} makes a token that exists")
            if self.has_arc(u, v):  # else no path meets this pair
                self.cut[u, v] = step
                self.parts[w] = (u, v, step)
            else:
                self.arcs.pop(self.label[w], None)
        if max(self.label, default=0) >= START:
            raise ValueError("the vocabulary is too large")
        self._spell()

    def _lost(self, after: int, arc: int) -> int:
        """When the state after a token lost an arc: a copy keeps what its origin had lost before."""
        until = lost = NEVER
        while True:
            step = self.cut.get((after, arc))
            if step is not None and step < until:
                lost = min(lost, step)
            if after not in self.parts:
                return lost
            u, after, step = self.parts[after]
            # where u is v, the state behind w is the one from before the cut of this very step
            until = min(until, step)

    def has_arc(self, after: int, arc: int) -> bool:
        """Whether the state after a token has an arc: its own parts had theirs when it was made."""
        made = NEVER
        while True:
            lost = self._lost(after, arc)
            if lost <= made and lost != NEVER:
                return False
            if arc not in self.parts:
                return True
            arc, _, made = self.parts[arc]

    def _spell(self) -> None:
        """The arcs as a tree of symbols. The last symbol of a word has the suffix."""
        self.next: list[dict[str, int]] = [{}]
        self.whole: list[int | None] = [None]  # the arc that a node spells
        self.size = [0]
        for label, arc in self.arcs.items():
            body = label.removesuffix(self.suffix)
            symbols = list(label if not body or body == label else body[:-1]) + ([] if not body or body == label else [body[-1] + self.suffix])
            node = 0
            for symbol in symbols:
                after = self.next[node].get(symbol)
                if after is None:
                    after = self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    self.whole.append(None)
                    self.size.append(self.size[node] + 1)
                node = after
            self.whole[node] = arc
        self._begin()

    def _begin(self) -> None:
        self.states: dict[tuple, dict] = {}
        #: A state is its row of the table, by symbol; under 0 the last arc and its size, under 1
        #: the open arcs, the longest first: the node reached, and the arc before.
        self.first = {0: (None, 0), 1: (START,)}

    def _entry(self, state: dict, symbol: str) -> dict:
        """Makes the table entry of a state and a symbol."""
        last, size, open_ = None, 0, []
        for way in state[1]:
            before = way & START
            node = self.next[way >> 20].get(symbol)
            if node is None:
                continue
            arc = self.whole[node]
            if last is None and arc is not None and (before == START or self.has_arc(before, arc)):
                last, size = arc, self.size[node]
            if self.next[node]:
                open_.append(node << 20 | before)
        if last is None:
            raise ValueError("a symbol of the word has no arc")
        open_.append(last)  # at the tree's root
        key = (last, size, *open_)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = {0: (last, size), 1: tuple(open_)}
        state[symbol] = found
        return found

    def encode(self, symbols: str) -> list[int]:
        """The arcs of a word's only path. symbols: a character for each base symbol."""
        if not symbols:
            return []
        if len(self.states) > STATES:
            self._begin()
        state, path = self.first, []
        for symbol in symbols[:-1]:
            state = state.get(symbol) or self._entry(state, symbol)
            path.append(state)
        symbol = symbols[-1] + self.suffix
        path.append(state.get(symbol) or self._entry(state, symbol))
        out, at = [], len(path)
        while at:
            last, size = path[at - 1][0]
            out.append(last)
            at -= size
        return out[::-1]


def _words_of_agreed() -> re.Pattern:
    """Codec.SPLIT for texts of agreed characters, whose classes are written out."""
    plain = sorted({c for i in (*range(0x250), *range(0x2010, 0x2028), 0x20AC) for c in chr(i) + chr(i).lower()})
    some = lambda kind: "".join(re.escape(c) for c in plain if kind(c))
    letters, digits = some(lambda c: unicodedata.category(c)[0] == "L"), some(lambda c: unicodedata.category(c)[0] == "N")
    spaces = some(lambda c: regex.match(r"\s", c))
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{letters}{digits}{spaces}]+")


class Codec:
    """Encodes and decodes whole texts as the tokenizer file says: `spec` is its JSON text."""

    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # a fixed value of the tokenizer file

    def __init__(self, spec: str):
        told = json.loads(spec)
        model = told["model"]
        kinds = [x["type"] for x in told["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != self.SPLIT or told["decoder"]:
            raise ValueError("only lower-casing BPE with word ends is supported")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        self.automaton = Automaton(model["vocab"], merges, suffix)
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.label = self.automaton.label | {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = _words_of_agreed()
        self.symbols = _byte_symbols()
        self.four = {i: i.to_bytes(4, "little") for i in self.automaton.label}
        self.file = Tokenizer.from_str(spec)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, in the file's byte symbols where these differ."""
        if AGREED.search(text):
            return [w for w, _ in self.file.pre_tokenizer.pre_tokenize_str(self.file.normalizer.normalize_str(text))]
        return self.words.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())

    def _new(self, word: str) -> bytes:
        symbols = word if word.isascii() and word.isalnum() else "".join([self.symbols[b] for b in word.encode()])
        found = b"".join([self.four[i] for i in self.automaton.encode(symbols)])
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.specials.split(text) if "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if AGREED.search(part):  # words in the file's symbols, not kept
                out += [b"".join([self.four[i] for i in self.automaton.encode(word)]) for word in self.split(part)]
                continue
            young, old = self.young, self.old
            for word in self.split(part):
                found = young.get(word) or old.get(word)
                if found is None:
                    found = self._new(word)
                    young, old = self.young, self.old
                out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec_of(spec: str) -> Codec:
    """The codec of a tokenizer file, compiled once in a worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(docs: DataFrame, spec: str, doc_id: str, text: str, fields: str, row) -> DataFrame:
    """One row per document: doc_id and what row(codec, ids) returns. The tokenizer
    file, whose size is fixed, goes out as a broadcast variable."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {one.schema['doc_id'].dataType.simpleString()}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value)
        for batch in batches:
            rows = [row(codec, codec.encode(t or "")) for t in batch.column("text").to_pylist()]
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return one.mapInArrow(run, schema)


def _digests(codec: Codec, ids: bytes):
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    return _mapped(docs, spec_of(path), doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _ids(codec: Codec, ids: bytes):
    return len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids of every whole text."""
    return _mapped(docs, spec_of(path), doc_id, text, "n_tokens long, ids array<int>", _ids)


def lengths(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens."""
    return _mapped(docs, spec_of(path), doc_id, text, "n_tokens long", lambda codec, ids: (len(ids) // 4,))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text that a column of ids stands for; null for null ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(spec_of(path))

    @F.pandas_udf("string")
    def labels(column):
        codec = codec_of(sent.value)
        return column.map(lambda x: None if x is None else codec.decode(np.asarray(x, "<u4").tobytes()))

    return encoded.withColumn("decoded", labels(F.col(ids)))
