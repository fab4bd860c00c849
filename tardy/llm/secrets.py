"""Secret scan with structural confirmation.

Three base patterns (assignments, access key ids, hex runs) are found as they
stand.  Candidates that only look like key material are decoded and parsed
before they are reported:

* ``jwt``: a signed token; the header must decode to a JSON object that
  names an algorithm, the payload to JSON,
* ``pem``: an armoured block; the body must decode to DER with nested
  lengths that add up, or to an OpenSSH key with its length-prefixed fields,
* ``der``: a base64, URL-safe or hex run, over line breaks too, that decodes to
  such a structure by itself, from the start of a run or after a sign in it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows, text_slices

#: kinds in the order that breaks ties of the start
KINDS = ("assign", "access", "hex", "jwt", "pem", "der")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: three dotted runs from any start of a run (a token may follow a dot)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*))")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)-----")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
#: a DER sequence starts with 0x30: in base64 with M and one of A to P
_B64_START = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P][A-Za-z0-9+/_-]{6}|b3BlbnNzaC1rZXktdjEA)")
_BREAK = r"[ \t]*\r?\n[ \t]*(?!-----)"
#: runs that may go on in the next line, in one of the two alphabets
_B64_RUNS = [re.compile(f"{c}+(?:{_BREAK}{c}+)*") for c in ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]")]
_HEX_START = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{2}|6[fF]70656[eE]737368)")
_LINE = re.compile(r"\S+")
_HEX_RUN = re.compile(f"[0-9A-Fa-f]+(?:{_BREAK}[0-9A-Fa-f]+)*")
#: shortest candidates, in characters
_MIN_B64, _MIN_HEX = 40, 24
_OPENSSH = b"openssh-key-v1\0"


def _b64(text: str, url: bool = False) -> bytes | None:
    text = "".join(text.split())
    try:
        raw = text.rstrip("=")
        raw += "=" * (-len(raw) % 4)
        return base64.urlsafe_b64decode(raw) if url else base64.b64decode(raw, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_nodes(raw: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> int:
    """Elements of a run of DER values whose lengths, nested ones too, end
    exactly at ``end`` (by default that of ``raw``); 0 if they do not."""
    end, n = len(raw) if end is None else end, 0
    while at < end:
        if at + 2 > end or depth > 12:
            return 0
        tag, size, at = raw[at], raw[at + 1], at + 2
        if not tag:  # no element has this tag
            return 0
        if size >= 128:
            wide = size - 128
            if not 1 <= wide <= 4 or at + wide > end:
                return 0
            size = int.from_bytes(raw[at:at + wide])
            at += wide
            if size < 128:
                return 0
        if at + size > end:
            return 0
        if tag & 0x20:  # constructed
            inner = der_nodes(raw, at, at + size, depth + 1)
            if size and not inner:
                return 0
            n += inner
        n, at = n + 1, at + size
    return n


def is_key(raw: bytes | None, at: int = 0, end: int | None = None) -> bool:
    """Key material in raw[at:end]: a DER sequence of several elements, or an
    OpenSSH blob whose first length-prefixed fields fit."""
    if not raw:
        return False
    end = len(raw) if end is None else end
    if raw.startswith(_OPENSSH, at, end):
        at += len(_OPENSSH)
        for _ in range(3):
            if at + 4 > end:
                return False
            at += 4 + int.from_bytes(raw[at:at + 4])
        return at + 4 <= end
    return at < end and raw[at] == 0x30 and der_nodes(raw, at, end) >= 3


def key_size(raw: bytes, at: int = 0, end: int | None = None) -> int | None:
    """Bytes of the key that starts at raw[at], by its own lengths (the first
    bytes of a DER sequence tell, an OpenSSH blob is walked); None if they do
    not tell."""
    end = len(raw) if end is None else end
    first = at
    if raw.startswith(_OPENSSH, at, end):
        at, keys = at + len(_OPENSSH), 0
        for field in range(4):
            if at + 4 > end:
                return None
            size = int.from_bytes(raw[at:at + 4])
            if field == 3:
                at, keys = at + 4, size
            else:
                at += 4 + size
        for _ in range(keys + 1):
            if at + 4 > end:
                return None
            at += 4 + int.from_bytes(raw[at:at + 4])
        return at - first
    if end - at < 6 or raw[at] != 0x30:
        return None
    if raw[at + 1] < 128:
        return 2 + raw[at + 1]
    wide = raw[at + 1] - 128
    return 2 + wide + int.from_bytes(raw[at + 2:at + 2 + wide]) if 1 <= wide <= 4 else None


class _Run:
    """A run of key characters over its lines, decoded once for each place
    that a group of characters may start at."""

    def __init__(self, text: str, start: int, pattern: re.Pattern, per: int):
        self.end, self.per = pattern.match(text, start).end(), per
        lines = list(_LINE.finditer(text, start, self.end))
        self.lines = [m.span() for m in lines]
        self.places = list(accumulate((b - a for a, b in self.lines[:-1]), initial=0))
        self.body = "".join(m[0] for m in lines)
        self.decoded: dict[int, bytes] = {}

    def place(self, at: int) -> tuple[int, int]:
        """(characters of the run before a place of the text, end of its line)."""
        k = bisect_right(self.lines, at, key=lambda line: line[0]) - 1
        return self.places[k] + at - self.lines[k][0], self.lines[k][1]

    def text_end(self, n: int) -> int:
        """The place of the text after the first n characters of the run."""
        k = bisect_left(self.places, n) - 1
        return self.lines[k][0] + n - self.places[k]

    def bytes(self, i: int) -> tuple[bytes, int]:
        """(decoded run, place in it) for a key that starts at character i."""
        r = i % self.per
        if r not in self.decoded:
            chars = self.body[r:]
            if self.per == 2:
                self.decoded[r] = bytes.fromhex(chars[:len(chars) // 2 * 2])
            else:
                chars += "A" * (-len(chars) % 4)
                self.decoded[r] = base64.b64decode(chars.replace("-", "+").replace("_", "/"))
        return self.decoded[r], (i // 4 * 3 if self.per == 4 else i // 2)

    def size(self, chars: int) -> int:
        """Whole bytes in so many characters."""
        return chars * 3 // 4 if self.per == 4 else chars // 2

    def key_end(self, text: str, start: int, least: int) -> int | None:
        """End of the key that starts there, if one does: as many characters
        as its own lengths say, over line breaks too, or its whole line."""
        i, line_end = self.place(start)
        raw, at = self.bytes(i)
        end = at + self.size(len(self.body) - i)
        ssh = raw.startswith(_OPENSSH[:7], at, end)
        if at >= end or not (raw[at] == 0x30 or ssh):
            return None
        size = key_size(raw, at, end if ssh else min(end, at + 18))
        if size is not None:
            need = -(-size * 4 // 3) if self.per == 4 else size * 2
            if least <= need <= len(self.body) - i and is_key(raw, at, at + size):
                stop = self.text_end(i + need)
                if not text[stop:stop + 1].isalnum():
                    return stop
        chars = line_end - start
        if chars < least or (self.per == 4 and chars % 4 == 1):
            return None
        stop = at + self.size(chars)
        whole = line_end == self.end or raw.startswith(_OPENSSH, at, stop) or key_size(raw, at, stop)
        return line_end if whole and is_key(raw, at, stop) else None


def key_runs(text: str) -> list[tuple[int, int]]:
    """Spans of base64, URL-safe and hex runs that are keys by themselves.
    Each run is found and decoded once; its starts are tried on the bytes."""
    found = set()
    for starts, patterns, per, least in ((_B64_START, _B64_RUNS, 4, _MIN_B64), (_HEX_START, [_HEX_RUN], 2, _MIN_HEX)):
        done, runs = 0, [None] * len(patterns)
        for m in starts.finditer(text):
            if m.start() < done:
                continue
            ends = []
            for k, pattern in enumerate(patterns):
                if runs[k] is None or m.start() >= runs[k].end:
                    runs[k] = _Run(text, m.start(), pattern, per)
                ends.append(runs[k].key_end(text, m.start(), least))
            end = max((e for e in ends if e), default=None)
            if end:
                done = end
                if per == 4:
                    while end - done < 2 and text[end:end + 1] == "=":
                        end += 1
                found.add((m.start(), end))
    return sorted(found)


def _armoured_key(body: str) -> bool:
    """Whether an armoured block's body is a key, after header lines with
    continuation lines (indented) and a blank line, if it has any."""
    lines = body.split("\n")
    first = after = 0
    for k, line in enumerate(lines):
        if _HEADER.match(line):
            first = after = k + 1
        elif first and after == k and line[:1] in (" ", "\t") and not line.isspace():
            after = k + 1
        elif not line.isspace() and line:
            break
    # indented lines after a header go on with it, or are an indented body
    return any(is_key(_b64("\n".join(lines[k:]))) for k in {first, after})


def armoured_keys(text: str) -> list[tuple[int, int]]:
    """Spans of armoured blocks that hold a key."""
    found, begin = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        else:
            if begin and begin[2] == m[2] and _armoured_key(text[begin.end():m.start()]):
                found.append((begin.start(), m.end()))
            begin = None
    return found


def is_signed_token(text: str) -> bool:
    head, body = (_b64(p, url=True) for p in text.split(".")[:2])
    if not (head or b"").lstrip().startswith(b"{"):
        return False
    try:
        header, payload = json.loads(head or b""), json.loads(body or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header and isinstance(payload, dict)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    found = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)
                  if m.end() - m.start() >= 20]
    for m in _HEX.finditer(text):
        found.append(("hex", m.start(), m.end()))
    found += [("jwt", m.start(1), m.end(1)) for m in _JWT.finditer(text) if is_signed_token(m[1])]
    if "-----BEGIN " in text:
        found += [("pem", a, b) for a, b in armoured_keys(text)]
    found += [("der", a, b) for a, b in key_runs(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its
    first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null text is empty (no spans, the hash of the empty string); repeated
    rows stay, a null id is passed on, other columns are ignored, an empty
    table gives no rows.  A very long text is scanned whole: runs are found
    and decoded once, armour is read line by line, nothing backtracks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                found = [find_secrets(t) for t in texts.to_pylist()]
                base = [[s for s in f if s[0] in BASE] for f in found]
                cols = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE}
                yield rows(cols | {
                    "doc_id": part.column(id_col),
                    "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                    "spans": [joined(f) for f in found]}, schema)

    return docs.select(id_col, text_col).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every secret replaced by its kind in brackets
    and the length of a changed text counted anew; null texts stay null."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                old, new, spans = part.column(text_col).to_pylist(), [], []
                for t in texts.to_pylist():
                    spans.append(find_secrets(t))
                    new.append(redact(t, spans[-1]))
                cols = {n: part.column(n) for n in names}
                cols[text_col] = pa.array([None if o is None else t for o, t in zip(old, new)],
                                          part.column(text_col).type)
                if length_col in cols:
                    cols[length_col] = pa.array(
                        [len(t) if s else n for t, s, n in
                         zip(new, spans, part.column(length_col).to_pylist())],
                        part.column(length_col).type)
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
