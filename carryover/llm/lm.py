"""N-gram language model scoring over sharded Elias-Fano tries.

Texts are dealt into blocks, in compressed parcels. A block asks each shard for the n-grams it holds, in one sorted,
Elias-Fano coded list with its own training counts; a shard sums what all blocks sent,
builds its trie, and answers each block with one code per n-gram asked. The block then scores
its texts. No n-gram crosses the network more than once per block, none is kept by the driver,
and a shard is a range of hashed (context fragment, word) keys, so that the successors of a very
frequent context are spread over shards.

The model interpolates downwards with Dirichlet priors: P(w) = (c(w) + 1) / (N + V + 1), and
P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m), h' being h without its first word. Each text
ends in an end token and starts behind a start token. Tries hold log counts in 1 / 4096ths
of a decade for orders over 1, and exact counts for words. N-grams are told apart by 56-bit keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from carryover.llm.eliasfano import EliasFano, Trie
from carryover.llm.text import BASE, Texts, mix, pieces
from carryover.session import settle

#: Words of the longest n-gram, 2 to 4. Each order above 2 adds about as much shuffle again.
ORDER = 3
#: Weight of the shorter context, by order from 2.
PRIORS = (50.0, 50.0, 50.0, 50.0)
BLOCK_BYTES = 8 << 20
#: Bytes that a task gathers before it sends each block its texts.
PARCELS = 8 << 20
FRAGMENT_BITS, WORD_BITS, TAG_BITS = 27, 27, 2
KEY_BITS = FRAGMENT_BITS + WORD_BITS + TAG_BITS
START, END = np.uint64(0x51A7), np.uint64(0xE11D)
STEP = 4096
ABSENT = 0xFFFF


def _key(order: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(context fragment, word within the context, order) as one sortable key. The words behind
    one context fall into 64 fragments; a single word is a fragment of its own."""
    part = word if order == 1 else word & np.uint64(0x3F)
    fragment = mix((context + np.uint64(order)) * np.uint64(BASE) + part) >> np.uint64(64 - FRAGMENT_BITS)
    within = mix((context ^ np.uint64(order)) * np.uint64(0xD6E8_FEB8_6659_FD93) + word) >> np.uint64(64 - WORD_BITS)
    return (fragment << np.uint64(WORD_BITS + TAG_BITS)) | (within << np.uint64(TAG_BITS)) | np.uint64(order - 1)


class Block:
    """The tokens of some texts and the keys of their n-grams."""

    def __init__(self, column: pa.ChunkedArray, order: int):
        hashes, docs, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for piece in pieces(iter(pa.table({"text": column}).to_batches()), "text"):
            t = Texts(piece.column("text"), lower=True)
            start, end, doc = t.words()
            hashes.append(t.word_hashes(start, end))
            docs.append(doc + rows)
            rows += t.n
        word, doc = np.concatenate(hashes), np.concatenate(docs)
        self.size = np.bincount(doc, minlength=rows) + 1
        total = int(self.size.sum())
        self.text = np.repeat(np.arange(rows), self.size)
        first = np.cumsum(self.size) - self.size
        token = np.full(total, END, np.uint64)
        token[np.arange(len(word)) + doc] = word
        del word, doc, hashes, docs
        token = mix(token)
        self.place = np.arange(total) - first[self.text]
        before, self.keys, context = np.full(total, START, np.uint64), [], np.zeros(total, np.uint64)
        before[1:] = token[:-1]
        before[first] = START
        past = before
        for k in range(1, order + 1):
            self.keys.append(_key(k, context, token))
            # the context of the next order: one word more to the left; texts too short for it
            # are not asked for that order
            context = mix(context * np.uint64(BASE) + past)
            older = np.full(total, START, np.uint64)
            older[1:] = past[:-1]
            older[self.place == 0] = START
            past = older
        self.valid = [self.place >= max(k - 2, 0) for k in range(1, order + 1)]

    def asked(self) -> np.ndarray:
        """All n-grams' keys, with repeats."""
        return np.concatenate([k[v] for k, v in zip(self.keys, self.valid, strict=True)])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _requests(block: int, column: pa.ChunkedArray, train: np.ndarray, order: int, shards: int) -> pa.Table:
    b = Block(column, order)
    # the lowest bit tells a training occurrence, so that one sort in place serves both
    marked = b.asked() << np.uint64(1)
    marked |= np.concatenate([train[b.text[v]] for v in b.valid]).astype(np.uint64)
    marked.sort()
    keys = marked >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    learnt = (marked & np.uint64(1)).astype(np.int64)
    keys, count = keys[first], np.add.reduceat(learnt, first) if len(first) else learnt
    shard = shard_of(keys, shards)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.zeros(0, np.int64)
    cut = np.append(at, len(keys))
    asked = [(int(shard[a]), EliasFano.encode(keys[a:e] - keys[a]).tobytes(), int(keys[a]), _packed(count[a:e])) for a, e in zip(cut, cut[1:], strict=False)]
    return pa.table({"shard": pa.array([x[0] for x in asked], pa.int64()), "block": pa.array([block] * len(asked), pa.int64()),
                     "base": pa.array([x[2] for x in asked], pa.int64()), "keys": pa.array([x[1] for x in asked], pa.binary()),
                     "counts": pa.array([x[3] for x in asked], pa.binary())})


def _packed(v: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2, 4 or 8 bytes, which the first byte tells."""
    width = next(w for w in (1, 2, 4, 8) if not len(v) or int(v.max()) < 1 << 8 * w - (w == 8))
    return bytes([width]) + v.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _levels(keys: np.ndarray, total: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for tag in range(order):
        at = np.flatnonzero((keys & np.uint64(3)) == tag)
        k, n = keys[at], total[at]
        code = n if tag == 0 else np.where(n > 0, np.round(STEP * np.log10(np.maximum(n, 1))), ABSENT).astype(np.uint16)
        out.append((k >> np.uint64(WORD_BITS + TAG_BITS), (k >> np.uint64(TAG_BITS)) & np.uint64((1 << WORD_BITS) - 1), code))
    return out


def _answers(requests: pa.Table, order: int) -> pa.Table:
    """Build one shard's trie from all requests to it and answer each of them."""
    raw = [EliasFano(np.frombuffer(k, np.uint8)).decode() + np.uint64(b) for k, b in zip(requests.column("keys").to_pylist(), requests.column("base").to_pylist(), strict=True)]
    cut, keys = np.cumsum([0, *map(len, raw)]), np.concatenate(raw)
    del raw
    n = np.concatenate([_unpacked(c) for c in requests.column("counts").to_pylist()])
    order_ = np.argsort(keys)
    keys, n = keys[order_], n[order_]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order_] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    keys, total = keys[first], np.add.reduceat(n, first)
    del order_, n, new, first
    trie = Trie(_levels(keys[total > 0], total[total > 0], order), WORD_BITS)
    # an n-gram is looked up once, whoever asked for it
    tag, exact, codes = keys & np.uint64(3), np.zeros(len(keys), np.int64), np.full(len(keys), ABSENT, np.uint16)
    for k in range(order):
        at = np.flatnonzero(tag == k)
        context, word = keys[at] >> np.uint64(WORD_BITS + TAG_BITS), (keys[at] >> np.uint64(TAG_BITS)) & np.uint64((1 << WORD_BITS) - 1)
        if k == 0:
            exact[at] = trie.lookup(0, context, word, 0)
        else:
            codes[at] = trie.lookup(k, context, word, ABSENT)
    single = (tag == 0)[place]
    of_single = np.concatenate([[0], np.cumsum(single)])[cut]
    exact, codes, of_more = exact[place[single]], codes[place[~single]], cut - of_single
    answers = [(_packed(exact[a:b]), codes[c:d].tobytes()) for a, b, c, d in zip(of_single, of_single[1:], of_more, of_more[1:], strict=False)]
    words = total[(keys & np.uint64(3)) == 0]
    once = lambda v: pa.array([int(v)] + [0] * (len(answers) - 1), pa.int64())
    return pa.table({"block": requests.column("block"), "shard": requests.column("shard"), "tokens": once(words.sum()), "kinds": once((words > 0).sum()),
                     "exact": pa.array([a for a, _ in answers], pa.binary()), "codes": pa.array([c for _, c in answers], pa.binary())})


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them; by one sort."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[new], place


def _scores(texts: pa.ChunkedArray, answers: pa.Table, order: int, tokens: int, kinds: int) -> dict[str, np.ndarray]:
    b = Block(texts, order)
    keys, place = _distinct(b.asked())
    answers = answers.sort_by("shard")
    tag, count = keys & np.uint64(3), np.zeros(len(keys))
    exact = [_unpacked(x) for x in answers.column("exact").to_pylist()]
    codes = [np.frombuffer(x, "<u2") for x in answers.column("codes").to_pylist()]
    count[tag == 0] = np.concatenate([np.zeros(0, np.int64), *exact])
    code = np.concatenate([np.zeros(0, np.uint16), *codes])
    count[tag > 0] = np.where(code == ABSENT, 0.0, 10.0 ** (code / STEP))
    n, at = [], 0
    for v in b.valid:
        n.append(np.zeros(len(v)))
        asked = int(v.sum())
        n[-1][v] = count[place[at:at + asked]]
        at += asked
    p = (n[0] + 1) / (tokens + kinds + 1)
    base = np.log10(p)
    ends = float(n[0][np.cumsum(b.size)[0] - 1]) if len(b.size) else 0.0
    for k in range(1, order):
        seen = np.concatenate([[0.0], n[k - 1][:-1]])
        if k == 1:
            seen = np.where(b.place == 0, ends, seen)  # as many starts as ends
        m = PRIORS[k - 1]
        p = np.where(b.valid[k], (np.where(b.valid[k], n[k], 0) + m * p) / (seen + m), p)
    rows = len(b.size)
    return {"n_tokens": b.size, "n_known": np.bincount(b.text[n[0] > 0], minlength=rows), "train_tokens": np.full(rows, tokens),
            "base_score": np.bincount(b.text, base, rows), "score": np.bincount(b.text, np.log10(p), rows)}


def _parcels(held: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of (block, _id, text, train) as one row a block, their texts compressed together."""
    t = pa.Table.from_batches(held).sort_by("block")
    block = t.column("block").to_numpy()
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    texts = Texts(t.column("text"))
    squeeze, out = zstandard.ZstdCompressor(level=3), []
    for a, e in zip(at, np.append(at, len(block))[1:], strict=True):
        raw = np.diff(texts.off[a:e + 1]).astype("<i8").tobytes() + texts.buf[texts.off[a]:texts.off[e]].tobytes()
        out.append(squeeze.compress(raw))
    cut = pa.array(np.append(at, len(block)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cut, t.column(c).combine_chunks()) for c in ("_id", "train")]
    return pa.RecordBatch.from_arrays([pa.array(block[at]), lists[0].cast(schema.field("ids").type), lists[1], pa.array(out, pa.binary())], schema=schema)


def _opened(parcels: pa.Table) -> tuple[pa.ChunkedArray, pa.ChunkedArray, np.ndarray]:
    """(ids, texts, whether learnt from) of the rows in the parcels of a block."""
    texts, loosen = [], zstandard.ZstdDecompressor()
    for ids, parcel in zip(parcels.column("ids"), parcels.column("texts"), strict=True):
        raw, n = loosen.decompress(parcel.as_buffer()), len(ids)
        off = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n))]).astype(np.int64)
        texts.append(pa.LargeStringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(raw[8 * n:])))
    ids = pa.chunked_array([c.flatten() for c in parcels.column("ids").chunks], parcels.schema.field("ids").type.value_type)
    train = [c.flatten().to_numpy(zero_copy_only=False) for c in parcels.column("train").chunks]
    return ids, pa.chunked_array(texts, pa.large_string()), np.concatenate([np.zeros(0, bool), *train])


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities by words alone and by the
    model). Rows for which ``train`` is true are learnt from; all rows are scored.

    Null and empty texts are the end token alone. A null id stays null, rows with a null ``train``
    are not learnt from, repeated rows are learnt from and scored each, other columns are not
    looked at. Without training rows every token has base probability 1.
    """
    if not 2 <= order <= 4:
        raise ValueError("order has to be 2, 3 or 4")
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = own.agg(F.sum(F.octet_length("text") + 1).alias("b")).first().b or 0
    blocks = max(1, math.ceil(size / block_bytes))
    blocked = own.withColumn("block", F.pmod(F.xxhash64("_id", "text"), F.lit(blocks)))
    kind = own.schema["_id"].dataType
    sent = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("texts", T.BinaryType())])
    arrow = to_arrow_schema(sent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in pieces(batches, "text"):
            held.append(b)
            size += b.nbytes
            if size >= PARCELS:
                yield _parcels(held, arrow)
                held, size = [], 0
        if held:
            yield _parcels(held, arrow)

    parcels = blocked.mapInArrow(send, sent)

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        _, texts, learnt = _opened(table)
        return _requests(group[0].as_py(), texts, learnt, order, blocks)

    def answer(table: pa.Table) -> pa.Table:
        return _answers(table, order)

    asked = parcels.groupBy("block").applyInArrow(ask, "shard long, block long, base long, keys binary, counts binary")
    answers = settle(asked.groupBy("shard").applyInArrow(answer, "block long, shard long, tokens long, kinds long, exact binary, codes binary"), "ngrams")
    total = answers.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    tokens, kinds = total.n or 0, total.v or 0

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts, _ = _opened(table)
        return pa.table({"_id": ids} | {k: pa.array(v) for k, v in _scores(texts, found, order, tokens, kinds).items()})

    out = f"_id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parcels.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out).withColumnRenamed("_id", id_col)
