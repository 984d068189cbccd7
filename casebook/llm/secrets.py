"""Secret scan: base patterns, and candidates confirmed by their structure.

Base kinds are found by pattern. Further kinds are reported only after a candidate
is decoded and parsed: keys whose nested DER lengths fit (base64 or hex), key files
with the OpenSSH magic and fitting field lengths, and signed tokens whose header
and claims decode to JSON with an algorithm. A plain PKCS#8 frame must hold a key that is
well-formed itself. Keys may be in base64 of either alphabet or in hex, and wrapped, with
line breaks as they are or escaped (JSON, one-line settings), indented, quoted line by line
or behind comment marks; they may have any length.

Positions count code points, the end is exclusive. Edge cases: a null text is an
empty one and has no spans; texts of any length are scanned whole; repeated rows
and ids give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: All kinds, in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "der", "hexder", "openssh", "jwt")
BASE_KINDS = KINDS[:3]
# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # runs of 20 or more; a shorter run holds no longer one
HEX = re.compile("[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# Candidates. A DER sequence begins with the byte 0x30, so its base64 with MA to MP.
# Only beginnings are matched; how far a key goes is read from its lengths. One may also
# begin after an escaped line break or tab, whose letter would else seem a part of it.
DER = re.compile(r"M[A-P](?:(?<![A-Za-z0-9+/]..)|(?<=\\[nrt]..)|(?<=\\u000[aAdD]..))(?=[A-Za-z0-9+/_-])")
HEXDER = re.compile(r"(?<![0-9A-Fa-f])30(?=[0-9A-Fa-f]{14})")
OPENSSH = re.compile(r"b3BlbnNzaC1rZXktdjEA(?:(?<![A-Za-z0-9+/].{20})|(?<=\\[nrt].{20})|(?<=\\u000[aAdD].{20}))")
JWT = re.compile(r"eyJ(?:(?<![A-Za-z0-9_-]...)|(?<=\\[nrt]...)|(?<=\\u000[aAdD]...))[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: A piece of base64 (of either alphabet) or of hex, and what may stand between two: line
#: breaks, as they are or escaped (also more than once), with blanks, the ends of quoted
#: lines and comment marks around them; or the escape of a slash.
PIECE, HEXPIECE = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
BETWEEN = re.compile(r"""(?:[ \t]*["'`]?[ \t]*[+,.&]?[ \t]*(?:\\*[\r\n]|\\+[rn]|\\+u000[aAdD])[ \t]*(?:[#>*;%|][ \t]*)*["'`]?)+|\\+(?=/)""")
PLAIN = str.maketrans("-_", "+/")
MAGIC = b"openssh-key-v1\0"
INTEGER, OCTETS, OID, SEQUENCE = 2, 4, 6, 0x30


def header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, first content byte and end of the DER element at a place; None if its length is malformed."""
    if at + 2 > len(data):
        return None
    tag, first = data[at], data[at + 1]
    if first < 0x80:
        return tag, at + 2, at + 2 + first
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 2 + n > len(data) or data[at + 2] == 0:
        return None
    size = int.from_bytes(data[at + 2 : at + 2 + n], "big")
    return (tag, at + 2 + n, at + 2 + n + size) if size >= 0x80 else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly, else None."""
    out = []
    while at < end:
        found = header(data, at)
        if found is None or found[2] > end:
            return None
        out.append(found)
        at = found[2]
    return out


def is_key(data: bytes) -> bool:
    """Whether the bytes are one private key: PKCS#8 (plain or encrypted), PKCS#1, DSA or SEC 1."""
    top = header(data, 0)
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = elements(data, top[1], top[2])
    if not parts:
        return False
    tags = [tag for tag, _, _ in parts]

    def named(part) -> bool:
        inner = elements(data, part[1], part[2])
        return bool(inner) and inner[0][0] == OID

    if tags[:1] == [INTEGER]:
        version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big")
        if tags[1:3] == [SEQUENCE, OCTETS]:
            return version <= 1 and named(parts[1]) and is_inner(data, *parts[2][1:])
        return is_plain(data, parts, tags)
    return tags == [SEQUENCE, OCTETS] and named(parts[0])


def is_plain(data: bytes, parts: list, tags: list[int]) -> bool:
    """Whether the elements of a sequence are those of a PKCS#1, DSA or SEC 1 key."""
    version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if tags[:1] == [INTEGER] else 2
    if set(tags) == {INTEGER}:
        return version <= 1 and len(tags) in (6, 9)
    return version == 1 and tags[1:2] == [OCTETS] and all(tag in (0xA0, 0xA1) for tag in tags[2:]) and parts[1][2] - parts[1][1] >= 20


def is_inner(data: bytes, at: int, end: int) -> bool:
    """Whether the octets of a PKCS#8 frame are one element that is a key: a number (DSA, DH), a
    string of 28 bytes or more (Edwards and Montgomery curves), or a key of its own form."""
    top = header(data, at)
    if top is None or top[2] != end:
        return False
    tag, first, _ = top
    if tag == SEQUENCE:
        parts = elements(data, first, end)
        return bool(parts) and is_plain(data, parts, [t for t, _, _ in parts])
    return (tag == INTEGER and end > first) or (tag == OCTETS and end - first >= 28)


def b64(text: str) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


class Stretch:
    """Pieces of base64 or hex from a place of a text on, as one."""

    def __init__(self, text: str, start: int, piece: re.Pattern = PIECE, bits: int = 6) -> None:
        pieces, self.text, self.places, self.offsets, total = [], text, [], [], 0
        self.bits, at = bits, start
        while found := piece.match(text, at):
            self.places.append(found.start())
            self.offsets.append(total)
            pieces.append(found[0])
            total += len(found[0])
            self.end = at = found.end()
            if between := BETWEEN.match(text, at):
                at = between.end()
        self.chars = "".join(pieces).translate(PLAIN)

    def offset(self, place: int) -> int:
        """Which character of the stretch lies at a place of the text."""
        i = bisect.bisect_right(self.places, place) - 1
        return self.offsets[i] + place - self.places[i]

    def end_of(self, first: int, size: int) -> int:
        """Where the encoding of `size` bytes ends in the text, with its padding."""
        last = first + -(-size * 8 // self.bits) - 1
        i = bisect.bisect_right(self.offsets, last) - 1
        at, padding = self.places[i] + last - self.offsets[i] + 1, -size % 3 if self.bits == 6 else 0
        while padding and self.text[at : at + 1] == "=":
            at, padding = at + 1, padding - 1
        return at


class Encoded:
    """The bytes that a stretch encodes from a character on; only those that are read are decoded."""

    def __init__(self, chars: str, first: int, size: int | None = None) -> None:
        self.chars, self.first = chars, first
        self.size = (len(chars) - first) * 6 // 8 if size is None else size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at : at + 1][0]
        a, b, _ = at.indices(self.size)
        data = b64(self.chars[self.first + a // 3 * 4 : self.first - (-b // 3) * 4])
        return data[a - a // 3 * 3 : b - a // 3 * 3]


class Hexed(Encoded):
    """The same of hex."""

    def __init__(self, chars: str, first: int, size: int | None = None) -> None:
        self.chars, self.first = chars, first
        self.size = (len(chars) - first) // 2 if size is None else size

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at : at + 1][0]
        a, b, _ = at.indices(self.size)
        return bytes.fromhex(self.chars[self.first + 2 * a : self.first + 2 * b])


def der(stretch: Stretch, first: int) -> int:
    """Where the key ends whose encoding begins at a character, or 0 if there is none."""
    kind = Encoded if stretch.bits == 6 else Hexed
    data = kind(stretch.chars, first)
    top = header(data, 0)
    if not top or top[0] != SEQUENCE or top[2] > len(data) or not is_key(kind(stretch.chars, first, top[2])):
        return 0
    end = stretch.end_of(first, top[2])
    return end if stretch.bits == 6 or not HEXPIECE.match(stretch.text, end) else 0  # a run of hex is a key as a whole


def openssh(stretch: Stretch, first: int) -> int:
    """Where an OpenSSH key file ends that begins at a character, or 0: magic, then counted fields."""
    data, size = Encoded(stretch.chars, first), len(MAGIC)

    def number() -> int:
        """The next four bytes, -1 if they are missing."""
        nonlocal size
        size += 4
        return int.from_bytes(data[size - 4 : size], "big") if size <= len(data) else -1

    def fields(n: int, least: int = 0) -> bool:
        nonlocal size
        for _ in range(n):
            length = number()
            if length < least or size + length > len(data):
                return False
            size += length
        return True

    # cipher, key derivation and its options; then each public key, and the private part
    if data[: len(MAGIC)] != MAGIC or not fields(3) or (keys := number()) < 1 or not fields(keys + 1, 1):
        return 0
    return stretch.end_of(first, size)


def keys(text: str, beginnings: re.Pattern, end_of, piece: re.Pattern = PIECE, bits: int = 6) -> Iterator[tuple[int, int]]:
    """Start and end of every key; beginnings inside the key before are passed over."""
    end, stretch = 0, None
    for m in beginnings.finditer(text):
        at = m.start()
        if at < end:
            continue
        if stretch is None or at >= stretch.end:
            stretch = Stretch(text, at, piece, bits)
        if found := end_of(stretch, stretch.offset(at)):
            end = found
            yield at, end


def is_token(candidate: str) -> bool:
    """Whether header and claims are base64url JSON objects and the header names an algorithm."""
    head, body, signature = candidate.split(".")
    try:
        told, claims = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(told, dict) and isinstance(claims, dict) and isinstance(told.get("alg"), str) and (bool(signature) or told["alg"].lower() == "none")


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of every secret of a text, sorted."""
    out = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(start, 3, end) for start, end in keys(text, DER, der)]
    out += [(start, 4, end) for start, end in keys(text, HEXDER, der, HEXPIECE, 4)]
    if "b3BlbnNzaC1rZXktdjEA" in text:
        out += [(start, 5, end) for start, end in keys(text, OPENSSH, openssh)]
    if "eyJ" in text:
        out += [(m.start(), 6, m.end()) for m in JWT.finditer(text) if is_token(m[0])]
    return sorted(out)


def listed(found) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def redacted(text: str, found) -> str:
    """The text with each stretch of spans replaced by [SECRET]."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            found = spans(text or "")
            base = [x for x in found if x[1] < len(BASE_KINDS)]
            rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found), len(found)))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])


def _one(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return one, one.schema["doc_id"].dataType.simpleString()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans as text."""
    one, kind = _one(docs, doc_id, text)
    return one.mapInArrow(_scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, start, end: a row for each span."""
    rows = scan(docs, doc_id, text).where("n_spans > 0").select("doc_id", F.explode(F.split("spans", ",")).alias("s"))
    part = F.split("s", ":")
    return rows.select("doc_id", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with secrets replaced in the text; null stays null."""
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t is None else redacted(t, spans(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
