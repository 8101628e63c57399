"""Repair of the role structure of conversations at the least cost.

Conversations are dealt out by key and sorted by turn; a task streams the sorted Arrow batches
and carries the state of a dynamic programme from batch to batch: for each end that a repaired
sequence of roles can have (nothing, system, user, assistant) the least cost, and the order of
the cheapest edit strings among the ends. What a row adds is five bits an end of backpointers.
They lie with the row on a tape that a giant conversation spills to an unlinked local file, so
a task holds a few megabytes of a conversation whatever its length.

A conversation is one stream by its nature: the digest of its repaired text is sequential.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from carryover.llm.frames import LONG, STRING

#: Fixed costs and texts: white space, ends of a sentence, roles that an edit can give.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
GIVEN = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}

#: Ends of a repaired prefix, and the end that each role initial leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Edits of one row, an insertion before it included, in ASCII order. An insertion before a
#: deletion is none of them: behind it, it costs the same and reads as the lesser string.
EDITS = ("D", "IK", "IR", "K", "R")
FAR = 1 << 40

SPILL = 4 << 20
RUN = 1 << 16
FLUSH = 4 << 20


def _moves(initial: str, doomed: bool, cut: bool) -> list[tuple[int, int, int, int]]:
    """(end before, edit, end after, cost) of all edits of a row."""
    out = [(p, 0, p, DELETE) for p in range(4)]
    for p in range(4) if not doomed else ():
        for q, paid, keep, rerole in ((p, 0, 3, 4), (USER if p != USER else ASSISTANT, INSERT, 1, 2)):
            if (q, initial) in NEXT:
                out.append((p, keep, NEXT[q, initial], paid + TRUNCATED * cut))
            out.append((p, rerole, USER if q != USER else ASSISTANT, paid + REROLE + TRUNCATED * cut))
    return out


@cache
def _step(costs: tuple[int, ...], order: tuple[int, ...], initial: str, doomed: bool, cut: bool) -> tuple:
    """Least cost and rank of each end after a row, and the backpointers (5 bits an end).

    Cheapest strings of two ends differ before either stops, as each holds one edit a row and
    ends with it; so the rank of the end before and the edit decide between two of equal cost.
    """
    best = [(FAR, 9, 9, p) for p in range(4)]
    for p, edit, q, cost in _moves(initial, doomed, cut):
        if costs[p] < FAR:
            best[q] = min(best[q], (costs[p] + cost, order[p], edit, p))
    rank = sorted(range(4), key=lambda q: best[q][1:3])
    base = min(b[0] for b in best)
    return (tuple(b[0] - base if b[0] < FAR else FAR for b in best), tuple(rank.index(q) for q in range(4)), base,
            sum((p | edit % 8 << 2) << 5 * q for q, (_, _, edit, p) in enumerate(best)))


class Tape:
    """Rows of a conversation with their backpointers, in memory up to ``SPILL`` bytes."""

    def __init__(self):
        self.back, self.rows, self.size, self.parts, self.file = array("I"), [], 0, [], None

    def add(self, back: int, role: str, text: str) -> None:
        self.back.append(back)
        self.rows.append((role, text))
        self.size += len(role) + len(text) + 100
        if self.size > SPILL:
            self.file = self.file or tempfile.TemporaryFile()
            at, b, r = self.file.seek(0, 2), self.back.tobytes(), pickle.dumps(self.rows)
            self.file.write(b)
            self.file.write(r)
            self.parts.append((at, len(b), len(r)))
            self.back, self.rows, self.size = array("I"), [], 0

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def edits(self, end: int) -> bytearray:
        """The edit of each row on the cheapest way to ``end``: a byte a row, as the audit has."""
        out = bytearray()
        for back in [self.back, *((self._read(at, n)) for at, n, _ in reversed(self.parts))]:
            for b in reversed(back if isinstance(back, array) else array("I", back)):
                b >>= 5 * end
                out.append(b >> 2 & 7)
                end = b & 3
        out.reverse()
        return out

    def all_rows(self) -> Iterator[tuple[str, str]]:
        for at, b, r in self.parts:
            yield from pickle.loads(self._read(at + b, r))
        yield from self.rows


class Seen:
    """Set of 128-bit digests: the newest in memory, older ones sorted in mapped files."""

    def __init__(self):
        self.new, self.runs = set(), []

    def add(self, key: bytes) -> bool:
        """Whether the key was there."""
        if key in self.new or any(self._in(run, key) for run in self.runs):
            return True
        self.new.add(key)
        if len(self.new) >= RUN:
            run = np.sort(np.array(list(self.new), "S16"))
            self.new = set()
            while self.runs and len(self.runs[-1]) <= len(run):
                run = np.sort(np.concatenate([self.runs.pop(), run]), kind="stable")
            f = tempfile.TemporaryFile()
            run.tofile(f)
            self.runs.append(np.memmap(f, "S16", "r"))
        return False

    @staticmethod
    def _in(run: np.ndarray, key: bytes) -> bool:
        at = np.searchsorted(run, np.array(key, "S16"))
        return at < len(run) and run[at] == np.array(key, "S16")


class Conversation:
    """One conversation in the making: faults so far and the state of the programme."""

    def __init__(self, key):
        self.key, self.tape, self.seen = key, Tape(), Seen()
        self.costs, self.order, self.paid = (0, FAR, FAR, FAR), (0, 1, 2, 3), 0
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        body = text.rstrip(SPACE)
        again = self.seen.add(hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest())
        blank, duplicate = not body, bool(body) and again
        truncated = not blank and not duplicate and body[-1] not in ENDS
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        self.costs, self.order, paid, back = _step(self.costs, self.order, initial if initial in ("s", "u", "a") else "", blank or duplicate, truncated)
        self.paid += paid
        self.tape.add(back, role, text)

    def plan(self) -> tuple[int, bytearray, bool]:
        """Least cost, the edit of each row, and whether an assistant's turn is added last."""
        ends = [(self.costs[NOTHING], self.order[NOTHING], NOTHING, False), (self.costs[ASSISTANT], self.order[ASSISTANT], ASSISTANT, False),
                (self.costs[USER] + INSERT, self.order[USER], USER, True)]
        cost, _, end, more = min(ends)
        return self.paid + cost, self.tape.edits(end), more

    def turns_of(self, edits: bytearray, more: bool) -> Iterator[tuple[str, str, str]]:
        """The repaired conversation: (edit, role, text)."""
        end = NOTHING
        for edit, (role, text) in zip(edits, self.tape.all_rows(), strict=True):
            for e in EDITS[edit]:
                if e == "D":
                    continue
                if e == "K":
                    end = NEXT[end, role[:1]]
                else:
                    end = USER if end != USER else ASSISTANT
                    role_given = GIVEN[end]
                yield (e, role, text) if e == "K" else (e, role_given, text if e == "R" else "")
        if more:
            yield "I", GIVEN[ASSISTANT], ""

    def report(self) -> tuple:
        cost, edits, more = self.plan()
        digest, first = hashlib.sha256(), True
        for _, role, text in self.turns_of(edits, more):
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        audit = "".join(EDITS[e] for e in edits) + "I" * more
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()

    def repaired(self) -> Iterator[tuple]:
        _, edits, more = self.plan()
        for at, (edit, role, text) in enumerate(self.turns_of(edits, more)):
            yield self.key, at, edit, role, text


def _streamed(rows: DataFrame, cols: tuple[str, str, str, str], absent: Column | None, out: T.StructType,
              emit: Callable[[Conversation], Iterator[tuple]]) -> DataFrame:
    conv, turn, role, text = (rows[c] for c in cols)
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    own = rows.select(conv.alias("conv"), F.when(~gone, turn.cast("long")).alias("turn"),
                      F.when(~gone, F.coalesce(role, F.lit(" "))).alias("role"), F.when(~gone, F.coalesce(text, F.lit(" "))).alias("text"), gone.alias("gone"))
    dealt = own.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in out.fields]

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*found, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, size = None, [], 0

        def ended(c: Conversation | None) -> Iterator[pa.RecordBatch]:
            nonlocal found, size
            for r in emit(c) if c else ():
                found.append(r)
                size += 100 + len(r[-1]) + len(r[-2])
                if size > FLUSH:
                    yield packed(found)
                    found, size = [], 0

        for b in batches:
            for key, at, who, what, away in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or now.key != key:
                    yield from ended(now)
                    now = Conversation(key)
                if not away:
                    now.add(at, who, what)
        yield from ended(now)
        if found:
            yield packed(found)

    return dealt.mapInArrow(run, out)


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  absent: Column | None = None) -> DataFrame:
    """One row per conversation: faults, least cost of a repair, its edits, digest of the result.

    Rows are read by turn, those without one first; rows of one turn by role and text, so that
    equal rows are neighbours. Null role and text read as one space; an empty role is none that
    can be kept. Rows where ``absent`` is
    true only make their conversation known: one without any other row has zeros, no edits and
    the digest of nothing. Rows with a null conversation are one conversation. Repeated rows are
    duplicates. Other columns are not looked at; without rows there is no conversation.
    """
    out = T.StructType([T.StructField(conv_col, rows.schema[conv_col].dataType), *(T.StructField(c, LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        T.StructField("audit", STRING), T.StructField("repaired_sha256", STRING)])
    return _streamed(rows, (conv_col, turn_col, role_col, text_col), absent, out, lambda c: iter([c.report()]))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         absent: Column | None = None) -> DataFrame:
    """The repaired conversations of ``repair_report``, a row per turn: the conversation,
    ``position`` from 0, ``edit`` (K kept, R other role, I inserted), role and text."""
    out = T.StructType([T.StructField(conv_col, rows.schema[conv_col].dataType), T.StructField("position", LONG),
                        *(T.StructField(c, STRING) for c in ("edit", "role", "text"))])
    return _streamed(rows, (conv_col, turn_col, role_col, text_col), absent, out, Conversation.repaired)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults planted by a checksum of ``conv_id:turn`` (nulls: one space),
    and the condition that marks dropped rows."""
    part = [F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    role, text = F.coalesce(rows["role"], F.lit(" ")), F.coalesce(rows["text"], F.lit(" "))
    out = rows.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
                      F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                      F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out, F.col("kind") == 0
