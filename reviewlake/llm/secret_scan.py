"""Secrets in texts: pattern matches, and encoded keys confirmed by their structure.

Three base kinds are plain patterns (``assign``, ``access``, ``hex``). The structural kinds
are candidates that a pattern only proposes: base64 or hex signs are decoded, and they are
reported if the bytes parse as what they claim to be. A key may be broken into lines in any
of the usual layouts (indents, quotes, escaped line breaks, one line, between PEM dashes);
its own length fields say how many signs belong to it, and it has to end where a line does.

``der``      DER whose nested lengths fill each other exactly: a SEQUENCE that opens with a
             version number or an algorithm identifier, as private and public keys do
``openssh``  the OpenSSH private key container and its length-prefixed strings
``sshpub``   an SSH public key: length-prefixed type name and fields that use all bytes
``jwt``      three dot-separated parts whose first is a JSON header with an ``alg``

Spans are code-point positions of the whole match, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns, their least lengths and the order of the kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE_CHARS = 8
ACCESS_CHARS = 16
HEX_CHARS = 32
BASE_KINDS = ["assign", "access", "hex"]
STRUCTURAL_KINDS = ["der", "openssh", "sshpub", "jwt"]
KINDS = BASE_KINDS + STRUCTURAL_KINDS

# Fixed values of the key formats.
OPENSSH_MAGIC = b"openssh-key-v1\0"
SSH_KEY_TYPES = [b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521"]
#: Fewest base64 or hex signs that are a key; the smallest key encodings are longer.
CANDIDATE_CHARS = 40
#: Elements of a DER key, nested ones included; real keys have a few dozen.
MAX_ELEMENTS = 128
#: Fields of an SSH public key, its type name included.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2}

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
#: Longest runs, so the length can be asked for in the pattern.
_HEX = re.compile(rf"[0-9a-f]{{{HEX_CHARS},}}")
#: The first signs of DER, SSH public keys and OpenSSH keys, in base64 and in hex.
_OPENING = re.compile(
    r"M(?:[A-H]|I[E-T])[A-Za-z0-9+/_-]|AAAA[BCE]|b3Bl|30(?:8[1-4]|[0-7][0-9A-Fa-f])|000000(?:07|0[Bb]|13)|6[Ff]70"
)
#: What stands before the first sign of a key; the signs of an escape are not part of a run.
_BORDER = re.compile(r"(?:\A|[^A-Za-z0-9+/_-]|-----|\\[nrt]|\\u[0-9A-Fa-f]{4}|%[0-9A-Fa-f]{2})\Z")
#: Signs up to a border, one sign that is written as an escape, or what may part two lines.
_PART = re.compile(
    r"""(?P<run>[A-Za-z0-9+/_]+(?:-(?!----)[A-Za-z0-9+/_]*)*|-(?!----)[A-Za-z0-9+/_]*(?:-(?!----)[A-Za-z0-9+/_]*)*)"""
    r"""|(?:\\+u00|%)(?P<sign>2[BbDdFf]|5[Ff])"""
    r"""|(?P<gap>(?:["'][ \t]*\+\s*["']|\\+(?:[nrt]|u00(?:0[9AaDd]|20|22|27))|%(?:0[9AaDd]|20|22|27)|<br\s*/?>|&\#(?:1[03]|[Xx][AaDd]);"""
    r"""|[\s"'`,;>#|*\\])+)"""
)
_PADDING = re.compile(r"(?:=|\\+u003[Dd]|%3[Dd]){0,2}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
_JWT = re.compile(r"[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_JWT_RUN = re.compile(rf"(?<![A-Za-z0-9_-]){_JWT.pattern}")
_ESCAPE = re.compile(r"\\[nrt]|\\u[0-9A-Fa-f]{4}|%[0-9A-Fa-f]{2}")
_NAMES = ("password", "passwd", "secret", "token", "api")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the base kinds: leftmost, not overlapping within a kind."""
    spans: list[Span] = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        spans += [
            (m.start(), m.end(), "assign")
            for m in _ASSIGN.finditer(text)
            if len(m.group(2)) >= ASSIGN_VALUE_CHARS
        ]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m.group()) >= ACCESS_CHARS]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


class _Region:
    """The signs of a stretch of text in order, without what parts its lines.

    A stretch is normalised once, whatever number of keys seem to begin in it.
    """

    def __init__(self, text: str, start: int) -> None:
        self.start = self.end = start
        self.offsets, self.places, self.ends = [], [], []
        parts, have = [], 0
        while m := _PART.match(text, self.end):
            self.end = m.end()
            if m["gap"] is None:
                run = m["run"] or chr(int(m["sign"], 16))
                self.offsets.append(have)
                self.places.append(m.start())
                self.ends.append(m.end())
                parts.append(run)
                have += len(run)
        self.signs = "".join(parts)
        self.plain = self.signs.replace("-", "+").replace("_", "/")
        self._hex: tuple[list[int], list[int]] | None = None

    def index(self, place: int) -> int | None:
        """The number of the sign at a place of the text, or None if none begins there."""
        k = bisect_right(self.places, place) - 1
        if k < 0 or place >= self.ends[k] or (place > self.places[k] and self._escaped(k)):
            return None
        return self.offsets[k] + place - self.places[k]

    def _escaped(self, k: int) -> bool:
        size = (self.offsets[k + 1] if k + 1 < len(self.offsets) else len(self.signs)) - self.offsets[k]
        return self.ends[k] - self.places[k] != size

    def end_of(self, last: int) -> tuple[int, bool]:
        """Where sign ``last`` ends in the text, and whether no sign follows it without a gap."""
        k = bisect_right(self.offsets, last) - 1
        end = self.ends[k] if self._escaped(k) else self.places[k] + last - self.offsets[k] + 1
        if end < self.ends[k]:
            return end, False
        return end, k + 1 == len(self.places) or self.places[k + 1] > end

    def hex_end(self, first: int) -> int:
        """Up to where the signs from ``first`` on are hex digits."""
        if self._hex is None:
            runs = list(_HEX_ANY.finditer(self.signs))
            self._hex = [m.start() for m in runs], [m.end() for m in runs]
        k = bisect_right(self._hex[0], first) - 1
        return max(first, self._hex[1][k]) if k >= 0 else first


class _Encoded:
    """The bytes that the signs of a region stand for from one of them on, decoded where they are read."""

    def __init__(self, region: _Region, first: int, is_hex: bool) -> None:
        self.region, self.first, self.is_hex = region, first, is_hex
        signs = (region.hex_end(first) if is_hex else len(region.signs)) - first
        self.size = signs // 2 if is_hex else signs * 3 // 4

    def read(self, at: int, count: int) -> bytes:
        """Up to ``count`` bytes, fewer at the end."""
        count = min(count, self.size - at)
        if count <= 0:
            return b""
        if self.is_hex:
            return bytes.fromhex(self.region.signs[self.first + 2 * at : self.first + 2 * (at + count)])
        lo, hi = at // 3, (at + count + 2) // 3
        quads = self.region.plain[self.first + 4 * lo : self.first + 4 * hi]
        return base64.b64decode(quads + "=" * (-len(quads) % 4))[at - 3 * lo : at - 3 * lo + count]

    def signs(self, count: int) -> int:
        """Signs that ``count`` bytes take."""
        return 2 * count if self.is_hex else -(-count * 4 // 3)


Element = tuple[int, int, int]


def _der_element(data: _Encoded, at: int, end: int) -> Element | None:
    """(tag, content start, content end) of the element at ``at`` if it fits before ``end``."""
    head = data.read(at, 6)
    if len(head) < 2 or at + 2 > end:
        return None
    tag, size, begin = head[0], head[1], at + 2
    if size >= 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or begin + count > end or len(head) < 2 + count or head[2] == 0:
            return None
        size, begin = int.from_bytes(head[2 : 2 + count], "big"), begin + count
        if size < 0x80:
            return None
    return (tag, begin, begin + size) if begin + size <= end else None


def _der_children(data: _Encoded, start: int, end: int, most: int) -> list[Element] | None:
    """The elements that fill a stretch exactly, or None; also None if they are more than ``most``."""
    out, at = [], start
    while at < end:
        element = _der_element(data, at, end) if len(out) < most else None
        if element is None:
            return None
        out.append(element)
        at = element[2]
    return out


def der_key_size(data: _Encoded) -> int | None:
    """Bytes of the DER SEQUENCE at the start if it is a private, an encrypted or a public key.

    Every constructed element has to be filled exactly by its children, level by level, which is
    read from the lengths alone. A key has at most ``MAX_ELEMENTS`` elements.
    """
    top = _der_element(data, 0, data.size)
    if top is None or top[0] != 0x30:
        return None
    fields = _der_children(data, top[1], top[2], MAX_ELEMENTS)
    if not fields or len(fields) < 2 or not _is_key(data, fields):
        return None
    level, left = list(fields), MAX_ELEMENTS - len(fields)
    while level:
        tag, start, end = level.pop()
        if tag & 0x20:
            children = _der_children(data, start, end, left)
            if children is None:
                return None
            left -= len(children)
            level += children
    return top[2]


def _is_key(data: _Encoded, fields: list[Element]) -> bool:
    tags = [tag for tag, _, _ in fields]
    _, start, end = fields[0]
    if tags[0] == 0x02 and end - start == 1 and data.read(start, 1)[0] <= 3:
        integers = len(tags) >= 4 and all(t == 0x02 for t in tags[1:4])
        wrapped = len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04
        curve = tags[1] == 0x04
        return integers or wrapped or curve
    if tags[0] == 0x30 and len(tags) == 2 and tags[1] in (0x03, 0x04):
        first = _der_element(data, start, end)
        return first is not None and first[0] == 0x06
    return tags == [0x02, 0x02] and end - start >= 64


def _after_strings(data: _Encoded, at: int, count: int, least: int = 0) -> int | None:
    """Where ``count`` length-prefixed strings of at least ``least`` bytes end, or None."""
    for _ in range(count):
        size = data.read(at, 4)
        if len(size) < 4 or int.from_bytes(size, "big") < least:
            return None
        at += 4 + int.from_bytes(size, "big")
        if at > data.size:
            return None
    return at


def openssh_key_size(data: _Encoded) -> int | None:
    if data.read(0, len(OPENSSH_MAGIC)) != OPENSSH_MAGIC:
        return None
    at = _after_strings(data, len(OPENSSH_MAGIC), 3)
    if at is None:
        return None
    keys = int.from_bytes(data.read(at, 4), "big")
    return _after_strings(data, at + 4, keys + 1) if 1 <= keys <= 16 else None


def ssh_public_key_size(data: _Encoded) -> int | None:
    size = int.from_bytes(data.read(0, 4), "big")
    name = data.read(4, size) if size <= 32 else b""
    if name not in SSH_KEY_TYPES:
        return None
    return _after_strings(data, 4 + size, SSH_FIELDS.get(name, 3) - 1, least=1)


#: For each kind what its first bytes are, and how many bytes it takes if its structure holds.
_CHECKS: dict[str, tuple[Callable[[bytes], bool], Callable[[_Encoded], int | None]]] = {
    "der": (lambda head: head[0] == 0x30, der_key_size),
    "openssh": (lambda head: OPENSSH_MAGIC.startswith(head[: len(OPENSSH_MAGIC)]), openssh_key_size),
    "sshpub": (lambda head: head[:3] == b"\0\0\0", ssh_public_key_size),
}


def _key_spans(text: str) -> list[Span]:
    """Keys in a text, in time that grows with its length.

    The work at each sign where a key may begin is bounded: the structure is read from length
    fields, and the stretch around it is normalised once.
    """
    spans: list[Span] = []
    region: _Region | None = None
    m = _OPENING.search(text)
    while m:
        at, after = m.start(), m.start() + 1
        if _BORDER.search(text[max(0, at - 6) : at]):
            if region is None or not region.start <= at < region.end or region.index(at) is None:
                region = _Region(text, at)
            data = _Encoded(region, region.index(at), m.group()[0] in "306")
            head = data.read(0, 8)
            for kind, (begins, size_of) in _CHECKS.items():
                size = size_of(data) if len(head) == 8 and begins(head) else None
                if size is None or data.signs(size) < CANDIDATE_CHARS:
                    continue
                end, whole = region.end_of(data.first + data.signs(size) - 1)
                if whole:
                    after = end if data.is_hex else _PADDING.match(text, end).end()
                    spans.append((at, after, kind))
                    break
        m = _OPENING.search(text, after)
    return spans


def _is_signed_token(token: str) -> bool:
    try:
        header = token.split(".", 1)[0]
        found = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def _token_spans(text: str) -> list[Span]:
    """Signed tokens, tested from every part of a dotted run on, and after an escape before it."""
    spans: list[Span] = []
    m = _JWT_RUN.search(text)
    while m:
        after = text.index(".", m.start()) + 1
        escape = _ESCAPE.match(text, m.start() - 1) if m.start() else None
        for start in (m.start(), escape.end()) if escape else (m.start(),):
            token = _JWT.match(text, start)
            if token and _is_signed_token(token.group()):
                spans.append((start, token.end(), "jwt"))
                after = token.end()
                break
        m = _JWT_RUN.search(text, after)
    return spans


def structural_spans(text: str) -> list[Span]:
    """Encoded keys and signed tokens whose decoded structure holds."""
    spans = _key_spans(text)
    if "ey" in text:  # how every encoded JSON object with a quoted name begins
        spans += _token_spans(text)
    return spans


def in_order(spans: list[Span]) -> list[Span]:
    """By start, then by the order of ``KINDS``."""
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in in_order(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every found stretch replaced by ``[SECRET]``; overlaps become one."""
    out, at = [], 0
    for start, end, _ in in_order(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row's whole text.

    The counts and the digest are of the base kinds; ``spans`` lists ``kind:start:end`` of
    all kinds. NULL texts are empty, repeated rows give a row each, other columns are
    ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = {k: [] for k in BASE_KINDS}, [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                for kind in BASE_KINDS:
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                lists.append(written(base + structural_spans(text)))
            columns = [pa.array(counts[k], pa.int64()) for k in BASE_KINDS]
            columns += [pa.array(digests, pa.string()), pa.array(lists, pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.record_batch([batch.column(0), *columns], names=names)

    return _texts(docs).mapInArrow(run, SCAN_SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found secret replaced by ``[SECRET]`` in ``text``.

    ``n_chars``, if there is such a column, is counted anew for changed texts. All rows and
    all other columns stay; a NULL text stays NULL.
    """
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cleaned = [None if t is None else redacted(t, base_spans(t) + structural_spans(t)) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(cleaned, batch.schema.field(at).type)
            if count is not None:
                numbers = batch.column(count).to_pylist()
                pairs = zip(texts, cleaned, numbers, strict=True)
                changed = [n if before == after else len(after) for before, after, n in pairs]
                columns[count] = pa.array(changed, batch.schema.field(count).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
