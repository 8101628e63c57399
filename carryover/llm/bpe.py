"""Byte-level BPE over chunks of texts.

A position where a space follows a character that is no white space starts a new pre-token
whatever stands before, as no pre-token holds a space behind another character. Chunks are cut
at the first such position at or behind their nominal start; an overlap that has none is
extended. Each piece between two cuts is pre-tokenised and encoded by itself, and the ids
of the pieces laid end to end are those of the text. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.llm.frames import ARROW, BINARY, LONG, STRING, arrow_map, chosen
from carryover.llm.text import strings

CHUNK = 1 << 15
SPREAD = 1 << 22


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file, one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, chunk: int = CHUNK) -> list[int]:
    """Bounds of the pieces of a text, each about ``chunk`` characters long."""
    out, at = [0], chunk
    while at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if text[at - 1].isspace():
            at += 1
            continue
        out.append(at)
        at += chunk
    return [*out, len(text)]


def encode_text(text: str, path: str, pattern: str, chunk: int = CHUNK) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    enc, at = encoding(path, pattern), cuts(text, chunk)
    return np.concatenate([np.array(enc.encode_ordinary(text[a:b]), "<u4") for a, b in zip(at, at[1:], strict=False)])


def decode_ids(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(ids.tolist())


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               chunk: int = CHUNK, spread_over: int = SPREAD) -> DataFrame:
    """One row per input row: the id, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    Texts of over ``spread_over`` characters are cut into chunk rows that all tasks share and
    put together again per text; shorter ones are encoded where they are read. The result does
    not depend on either size. Null and empty texts have no ids; a null id stays null, repeated
    rows give repeated results, other columns are not looked at. Special tokens are plain text.
    """
    own = chosen(docs, _id=id_col, text=text_col)

    def encode(b: pa.RecordBatch) -> dict:
        ids = [encode_text(t, path, pattern, chunk) for t in strings(b.column("text"))]
        return {"n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}

    size = F.coalesce(F.length("text"), F.lit(0))
    out = {"n_tokens": LONG, "ids": BINARY}
    short = arrow_map(own.filter(size <= spread_over), encode, out, ["_id"])
    return short.unionByName(_encode_long(own.filter(size > spread_over), encode, chunk)).withColumnRenamed("_id", id_col)


def _encode_long(own: DataFrame, encode, chunk: int) -> DataFrame:
    def split(b: pa.RecordBatch) -> dict:
        rows, place, part = [], [], []
        for i, t in enumerate(strings(b.column("text"))):
            at = cuts(t, chunk)
            rows += [i] * (len(at) - 1)
            place += range(len(at) - 1)
            part += [t[a:e] for a, e in zip(at, at[1:], strict=False)]
        return {"_rows": rows, "_place": place, "part": part}

    # a row's number only has to tell rows apart within one run of the split below
    parts = arrow_map(own.withColumn("_row", F.monotonically_increasing_id()), split, {"_place": LONG, "part": STRING}, ["_id", "_row"])
    spread = parts.withColumnRenamed("part", "text").repartition(F.col("_row"), F.col("_place"))
    done = arrow_map(spread, encode, {"n_tokens": LONG, "ids": BINARY}, ["_id", "_row", "_place"])

    def join(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups)).sort_by("_place")
        ids = b"".join(t.column("ids").to_pylist())
        yield pa.RecordBatch.from_arrays([t.column("_id").combine_chunks().slice(0, 1), pa.array([len(ids) // 4], ARROW[LONG]), pa.array([ids], ARROW[BINARY])], names=["_id", "n_tokens", "ids"])

    # one group is the pieces of one text, never more than the text itself
    return done.groupBy("_row").applyInArrow(join, own.select("_id").schema.add("n_tokens", LONG).add("ids", BINARY))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and return digests of both per row (see ``bpe_encode``)."""
    def digest(b: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(x, "<u4") for x in b.column("ids").to_pylist()]
        return {"n_tokens": [len(x) for x in ids], "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(decode_ids(x, path, pattern)).hexdigest() for x in ids]}

    ids = chosen(bpe_encode(docs, path, pattern, id_col, text_col), _id=id_col, ids="ids")
    return arrow_map(ids, digest, {"n_tokens": LONG, "ids_sha256": STRING, "decoded_sha256": STRING}, ["_id"], "ids").withColumnRenamed("_id", id_col)
