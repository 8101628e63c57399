"""Multipart credential linking.

Strong finds (an assignment, an access identifier, a long hex run) are reported by
themselves. Weak parts - identifiers, short or bare secrets, endpoints - are common in
harmless text, so a weak identifier or secret is reported only if a complementary part lies
in its scope: an interval around it, within its paragraph. That is an interval semi-join
of part against scope, done by one sorted sweep per kind and text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.llm.frames import LONG, STRING, arrow_map, chosen
from carryover.llm.text import Texts, strings

ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = np.zeros(256, bool)
HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
IDENT = re.compile("\\b(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account(?:_?id)?)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9][A-Za-z0-9._@+-]{2,})", re.I | re.A)
WEAK = re.compile("\\b(pass|pwd|passphrase|key|private_?key|access_?key_?secret|credentials?|auth|bearer|signature)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})", re.I | re.A)
#: What no plain word has: a digit, or a capital behind another character of the same word.
SHAPED = re.compile("[0-9]|[A-Za-z][A-Z]", re.A)
PASSWORDS = ("pass", "pwd", "passphrase")
BARE = re.compile("(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", re.A)
ENDPOINT = re.compile("\\b[a-z][a-z0-9+.-]{1,15}://[^\\s\"'<>]+|\\b(?:endpoint|host(?:name)?|server)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9][A-Za-z0-9.:-]{2,}", re.I | re.A)
#: Kinds in the order in which finds at one place are listed.
KINDS = ("assign", "access", "hex", "ident", "secret")
REACH = 300
Span = tuple[int, int, int]


def strong(text: str, hexes: list[tuple[int, int]]) -> list[Span]:
    """(start, kind, end) of the base finds, ``hexes`` being those of long hex runs."""
    found = [(a, 2, b) for a, b in hexes]
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def linked(text: str, base: list[Span]) -> list[Span]:
    """Weak parts with a complement in their scope and apart from every base find.

    A plain word behind ``key:`` or ``auth:`` is no secret; behind a word for passwords it is one
    only next to a name, as an address is common in prose."""
    if "=" not in text and ":" not in text and not any(k == 1 for _, k, _ in base):
        return []
    values = [((m.start(2), 4, m.end(2)), bool(SHAPED.search(m[2])), m[1].lower() in PASSWORDS) for m in WEAK.finditer(text)]
    weak = [v for v, shaped, _ in values if shaped]
    words = [v for v, shaped, named in values if named and not shaped]
    ident = [(m.start(1), 3, m.end(1)) for m in IDENT.finditer(text)]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if ident or ends or any(k == 1 for _, k, _ in base):
        weak += [(m.start(), 4, m.end()) for m in BARE.finditer(text)]
    weak, ident = _apart(weak, base), _apart(ident, base)
    words = _apart(words, base + weak + ident)
    secrets = weak + words + [s for s in base if s[1] != 1]
    names = ident + [s for s in base if s[1] == 1]
    return _near(weak, names + ends, text) + _near(words, names, text) + _near(ident, secrets, text)


def _sweep(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts in order, and the largest end up to each."""
    spans = sorted(spans)
    return [s for s, _, _ in spans], np.maximum.accumulate([e for _, _, e in spans]).tolist() if spans else []


def _meets(starts: list[int], reach: list[int], lo: int, hi: int) -> bool:
    """Does some interval overlap [lo, hi)?"""
    i = bisect_left(starts, hi)
    return i > 0 and reach[i - 1] > lo


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    sweep, out, end = _sweep(base), [], -1
    for s in sorted(set(spans)):
        if s[0] >= end and not _meets(*sweep, s[0], s[2]):
            out.append(s)
            end = s[2]
    return out


def _near(spans: list[Span], others: list[Span], text: str) -> list[Span]:
    sweep, out = _sweep(others), []
    for s in spans:
        lo, hi = max(0, s[0] - REACH), min(len(text), s[2] + REACH)
        lo = max(lo, text.rfind("\n\n", lo, s[0]) + 1)
        stop = text.find("\n\n", s[2], hi)
        if _meets(*sweep, lo, hi if stop < 0 else stop):
            out.append(s)
    return out


def _hex_runs(t: Texts) -> list[list[tuple[int, int]]]:
    """Code-point bounds of the long hex runs of each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(t.n)]
    start, end, doc = t.words(HEX)
    long = end - start >= 32
    if long.any():
        chars = t.code_points()
        first = chars[t.off]
        for a, b, d in zip(start[long], end[long], doc[long], strict=True):
            out[d].append((int(chars[a] - first[d]), int(chars[b] - first[d])))
    return out


def find(column: pa.Array) -> list[tuple[str, list[Span], list[Span]]]:
    """Text, base finds and all finds of each row."""
    out = []
    for text, hexes in zip(strings(column), _hex_runs(Texts(column)), strict=True):
        base = strong(text, hexes)
        out.append((text, base, sorted(base + linked(text, base))))
    return out


def listing(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts and digest of the base finds, and ``spans``, all finds.

    Bounds are code points, end exclusive. Null and empty texts have no finds. A null id stays
    null, repeated rows give repeated results, an empty table gives an empty one, and columns
    other than the two named are not looked at. Finds at one place are listed in the order
    of ``KINDS``.
    """
    def read(b: pa.RecordBatch) -> dict:
        found = find(b.column("text"))
        count = lambda k: [sum(s[1] == k for s in base) for _, base, _ in found]
        return {"n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                "base_sha256": [hashlib.sha256(listing(base).encode()).hexdigest() for _, base, _ in found],
                "spans": [listing(spans) for _, _, spans in found]}

    out = {"n_assign": LONG, "n_access": LONG, "n_hex": LONG, "base_sha256": STRING, "spans": STRING}
    return arrow_map(chosen(docs, _id=id_col, text=text_col), read, out, ["_id"]).withColumnRenamed("_id", id_col)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each find, or run of overlapping finds, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every find replaced by ``mark``; all rows and columns stay, a null text
    too. ``size_col``, if named, gets the new length in code points."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    size = names[docs.columns.index(size_col)] if size_col else None

    def read(b: pa.RecordBatch) -> dict:
        given = b.column(text)
        new = [redact(t, spans, mark) if spans else t for t, _, spans in find(given)]
        return {"_text": pa.array(new, pa.string(), mask=given.is_null().to_numpy(zero_copy_only=False))}

    made = arrow_map(plain, read, {"_text": STRING}, names, text)
    cols = {text: F.col("_text")} | ({size: F.length("_text").cast(plain.schema[size].dataType)} if size else {})
    return made.select(*[cols.get(c, F.col(c)).alias(c) for c in names]).toDF(*docs.columns)
