"""SentencePiece encoding and decoding of merge-type (BPE) models.

A text gets a leading space and its spaces become U+2581. Its characters are the first
symbols. An agenda holds every adjacent pair of symbols whose joined text is a piece, the
best score first and of equal scores the leftmost. The best pair is joined, the
pairs of its two symbols with their neighbours leave, and those of the new symbol enter. When the agenda is empty each symbol is a piece, or its bytes are byte pieces.

A text falls into stretches, each with an agenda of its own, where no pair can ever be
joined: before a U+2581 that follows another character, if no piece has one there, and
between characters of different groups, where a group is what the pieces put side by side.
Stretches met before are remembered. A model with a piece that goes on with U+2581 is
encoded with one agenda for the whole text.

`checked` lets the sentencepiece library encode and decode the stretches that an Arrow
batch brings for the first time, joined by a character that no piece joins; or, by choice
or where that fails, every whole text.

Edge cases: a null text is encoded as an empty one, which has no ids and decodes to an empty
text; texts and words of any length are encoded whole; pieces such as `<s>` or `<0x41>`
written in a text are ordinary characters; repeated rows and ids give a row each; a null id
stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import chunks

SPACE = "▁"
#: Stretches whose ids are kept in memory, twice this at most, and the characters of one; longer ones have a heap as agenda.
MEMORY, LONGEST = 300_000, 64
#: Bytes of text encoded at a time.
BATCH_BYTES = 1 << 19
#: Fixed values of the model file's format: kinds of pieces, and the kind of the model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of every field of a protocol buffer message: an int, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """The pieces and settings of a model file."""

    def __init__(self, data: bytes):
        self.piece: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in fields(data):
            if number == 1:
                told = dict(fields(value))
                self.piece.append(told[1].decode())
                self.score.append(struct.unpack("<f", told.get(2, bytes(4)))[0])
                self.kind.append(told.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != MERGES or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only merge-type models with byte pieces and leading spaces are supported")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that leave texts as they are, but for a leading space, are supported")
        if USER_DEFINED in self.kind or UNUSED in self.kind:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ").decode()


class Codec:
    def __init__(self, data: bytes):
        model = Model(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.id = {p: i for i, (p, kind) in enumerate(zip(model.piece, model.kind, strict=True)) if kind == NORMAL}
        #: Place of each piece in the order of scores, the best first; pieces of equal score share one.
        places = {s: n for n, s in enumerate(sorted({model.score[i] for i in self.id.values()}, reverse=True))}
        self.place = {p: places[model.score[i]] for p, i in self.id.items()}
        self.never = len(places)
        self.four = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        byte_id = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(model.piece, model.kind, strict=True)) if kind == BYTE}
        self.byte_of = {i: b for b, i in byte_id.items()}
        self.four_of_byte = {b: i.to_bytes(4, "little") for b, i in byte_id.items()}
        self.special = {i: model.unknown if kind == UNKNOWN else "" for i, kind in enumerate(model.kind) if kind in (UNKNOWN, CONTROL)}
        self.surface = [p.replace(SPACE, " ") for p in model.piece]
        #: The bytes of each id, for ids that come from a text; None where decoding asks for more.
        self.plain = [None if i in self.special else bytes([self.byte_of[i]]) if i in self.byte_of else s.encode() for i, s in enumerate(self.surface)]
        self.alone = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        groups = self._groups()
        self.stretches = re.compile("|".join(f"{SPACE}*[{re.escape(''.join(sorted(g)))}]+" for g in groups) + f"|{SPACE}*[^{SPACE}]|{SPACE}+", re.DOTALL)
        joins = {c for p in self.id if len(p) > 1 for c in p}
        self.between = next((c for c in "\n\r\t\x00" if c not in joins), None) if self.alone else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fresh: list[str] = []

    def _groups(self) -> list[set[str]]:
        """Characters that pieces put side by side, directly or through others, the largest group first."""
        of: dict[str, set[str]] = {}
        for p in self.id:
            for a, b in zip(p, p[1:]):  # noqa: B905
                if SPACE in (a, b):
                    continue
                x, y = sorted((of.setdefault(a, {a}), of.setdefault(b, {b})), key=len)
                if x is not y:
                    y |= x
                    of.update(dict.fromkeys(x, y))
        return sorted({id(g): g for g in of.values()}.values(), key=lambda g: (-len(g), min(g)))

    def joined(self, symbols: str) -> list[str]:
        """The symbols left when the agenda is empty."""
        return self._short(symbols) if len(symbols) <= LONGEST else self._long(symbols)

    def _short(self, symbols: str) -> list[str]:
        """The agenda is a list, an entry for each pair in its place, and its least entry is looked up."""
        place, never = self.place.get, self.never
        text = list(symbols)
        agenda = [place(t, never) for t in map(add, symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)  # the leftmost
            new = text[i] = text[i] + text.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = place(new + text[i + 1], never)
            if i:
                agenda[i - 1] = place(text[i - 1] + new, never)
        return text

    def _long(self, symbols: str) -> list[str]:
        """The agenda is a heap. An entry is place * n + index of the left symbol; entries of joined symbols go stale."""
        place = self.place.get
        text = list(symbols)
        n = len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [p * n + i for i, p in enumerate(map(place, map(add, symbols, symbols[1:]))) if p is not None]
        heapq.heapify(agenda)
        while agenda:
            p, i = divmod(heapq.heappop(agenda), n)
            j = after[i]
            if j < 0:
                continue  # the left symbol is gone, or the last
            new = text[i] + text[j]
            if place(new) != p:
                continue  # one of the two has been joined since
            text[i], text[j] = new, ""
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                found = place(new + text[k])
                if found is not None:
                    heapq.heappush(agenda, found * n + i)
            h = before[i]
            if h >= 0:
                found = place(text[h] + new)
                if found is not None:
                    heapq.heappush(agenda, found * n + h)
        return [t for t in text if t]

    def ids_of(self, symbols: str) -> bytes:
        out = self.joined(symbols)
        try:
            return b"".join([self.four[t] for t in out])
        except KeyError:  # a character that is no piece
            return b"".join([self.four.get(t) or b"".join([self.four_of_byte[b] for b in t.encode()]) for t in out])

    def _new(self, stretch: str) -> bytes:
        found = self.ids_of(stretch)
        self.fresh.append(stretch)
        if len(stretch) <= LONGEST:
            if len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[stretch] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        symbols = SPACE + text.replace(" ", SPACE)
        if not self.alone:
            self.fresh.append(symbols)
            return self.ids_of(symbols)
        stretches = self.stretches.findall(symbols)
        found = list(map(self.young.get, stretches))
        if None in found:
            found = [f or self.young.get(s) or self.old.get(s) or self._new(s) for f, s in zip(found, stretches, strict=True)]
        return b"".join(found)

    def confirmed(self) -> bool:
        """Whether the library gives the same ids and texts for the stretches met since the last call."""
        fresh, self.fresh = self.fresh, []
        if not fresh:
            return True
        if self.between is None:
            return False
        ids = self.ids_of(self.between)
        mine = np.frombuffer(b"".join([self.ids_of(SPACE), *(ids + (self.young.get(s) or self.old.get(s) or self.ids_of(s)) for s in fresh)]), "<u4").tolist()
        library = self.library.encode("".join([self.between + s for s in fresh]), add_bos=False, add_eos=False)
        return mine == library and self.decode(mine) == self.library.decode(library)

    def decode(self, ids: list[int]) -> str:
        """The text: the first space is the leading one and goes, control pieces are empty,
        a byte that belongs to no character becomes U+FFFD."""
        try:
            whole = b"".join([self.plain[i] for i in ids]).decode()
            if not ids or ids[0] in self.byte_of:
                return whole
            return whole.removeprefix(" ")
        except (TypeError, UnicodeDecodeError):
            return self._decode_any(ids)

    def _decode_any(self, ids: list[int]) -> str:
        out, pending = [], bytearray()

        def flush() -> None:
            data = bytes(pending)
            pending.clear()
            while data:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(data[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                data = data[size:]

        begun = False  # whether the leading space, or what stands in its place, is past
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            flush()
            if i in self.special:
                out.append(self.special[i])
            else:
                out.append(self.surface[i] if begun or any(out) else self.surface[i].removeprefix(" "))
                begun = True
        flush()
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """The codec of a model file, made once in a worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def model_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, names: list[str], types: list[pa.DataType], fields_: str, rows) -> DataFrame:
    """One row per document: doc_id and what rows(codec, texts) returns for it. The model
    file, whose size is fixed, goes out as a broadcast variable."""
    sent = docs.sparkSession.sparkContext.broadcast(model_of(path))
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value)
        for batch in batches:
            for part in chunks(batch, "text", BATCH_BYTES):
                found = zip(*rows(codec, [t or "" for t in part.column("text").to_pylist()]), strict=True)
                columns = [pa.array(x, t) for x, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names])

    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, {fields_}")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids of every whole text."""

    def rows(codec: Codec, texts: list[str]) -> list[tuple]:
        return [(len(ids), ids) for ids in (np.frombuffer(codec.encode(t), "<u4").astype(np.int32) for t in texts)]

    return _mapped(docs, path, doc_id, text, ["n_tokens", "ids"], [pa.int64(), pa.list_(pa.int32())], "n_tokens long, ids array<int>", rows)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of a column of ids; null for null ids. An id that the model lacks is an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(model_of(path))

    @F.pandas_udf("string")
    def texts(column):
        codec = codec_of(sent.value)
        return column.map(lambda x: None if x is None else codec.decode([int(i) for i in x]))

    return encoded.withColumn("decoded", texts(F.col(ids)))


def checked(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256, and
    `agrees`: whether the sentencepiece library gives the same ids and decodes them to the same
    text, by its stretches or (`whole`, or where a batch's new stretches do not agree) as a whole."""

    def rows(codec: Codec, texts: list[str]) -> list[tuple]:
        found = [np.frombuffer(codec.encode(t), "<u4").tolist() for t in texts]
        decoded = [codec.decode(ids) for ids in found]
        agrees = [True] * len(texts)
        sound = codec.confirmed()
        if whole or not sound:
            codec.young, codec.old = {}, {}  # what did not agree is not remembered
            library = codec.library.encode(texts, num_threads=1, add_bos=False, add_eos=False)
            agrees = [a == b and t == codec.library.decode(b) for a, t, b in zip(found, decoded, library, strict=True)]
        return [(len(a), _sha(",".join(map(str, a))), _sha(t), x) for a, t, x in zip(found, decoded, agrees, strict=True)]

    names, types = ["n_tokens", "ids_sha256", "decoded_sha256", "agrees"], [pa.int64(), pa.string(), pa.string(), pa.bool_()]
    return _mapped(docs, path, doc_id, text, names, types, "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean", rows)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
