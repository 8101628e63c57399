"""Inputs and plain re-tellings that several tests share."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(0x41, 0x5B)}
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dusk."
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
#: doc_id, text: nulls, empties, repeated rows, ties, a very long text.
EDGE = [(1, PROSE), (1, PROSE), (2, None), (None, PROSE), (3, ""), (4, " \n\t "), (5, LONG), (6, "Ünïcödé straße 東京 \U0001F600 end."), (7, "one"), (8, "one two"), (None, None)]
#: Names that operators use for columns of their own.
CLASHING = "string kept, string code, string n_words, string _row, string block, string cls, string labels, string score"


def edge(spark, rows=EDGE):
    """The rows with further columns whose names clash with the operators' own."""
    extra = [c.split()[1] for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))


def words(text):
    return SPACE.findall(text or "")


def lower(text):
    return (text or "").translate(LOW)
