"""Exact n-gram Jaccard join of all documents with all, by universe partition.

A document is the set of its word n-grams. Sets whose sizes can link share a size band. In a
band at most ``H`` n-grams can be in one but not the other of a linked pair, so of ``H + 1``
hash segments of the universe one at least is equal in both; a segment whose sets may differ
by one n-gram (looked up with each of its n-grams left out) counts for two. A cost model
allots each band its segments, and with spare segments each set leaves out its smallest ones,
which would meet the most strangers. Documents that share a signature are candidates.

Copies collapse into one class first. A bucket of candidates is joined to its best connected
member, not squared; what that leaves apart is compared across components, behind a bound
on the Hamming distance of parity sketches that no linked pair can exceed. Each candidate that
passes is verified on the full sets. Links become components by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby
from math import ceil, exp, sqrt
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.llm.frames import BINARY, LONG, arrow_map, chosen
from carryover.llm.text import BASE, Texts, mix, pieces, windows
from carryover.llm.vectors import runs
from carryover.session import drop_shuffles, passing_scratch, settle, settle_counted, shuffle_width

#: 100 * intersection >= percent * union links two sets; this is the percentage if none is given.
PERCENT = 90
SKETCH = 8
#: In sets of more n-grams those bits are too full to tell two apart; they have a long sketch as well.
FULL = 32 * SKETCH
SPARE = 2
RATIO = 1.5
#: Segments of fewer n-grams than this on average are often empty or hold one.
THIN = 4
#: Signatures that a task gathers before it sends them and that a bucket merges at a time, and
#: n-grams of the corpus per bucket.
GATHERED, MERGED, BUCKET_GRAMS = 1 << 21, 1 << 18, 1 << 19
#: Weight of a stranger in a bucket against one signature row; strangers thin out by a
#: factor of four with each n-gram that a segment holds.
STRANGER = 1000.0


def smallest(percent: int) -> int:
    """Sets below this size link with equal sets only."""
    return ceil(percent / (100 - percent))


@cache
def bands(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """Where the size bands begin; no set links with one more than a band below."""
    if not 0 < percent < 100:
        raise ValueError("percent has to be 1 to 99")
    out = [smallest(percent)]
    while out[-1] < limit:
        out.append(max(ceil(out[-1] * RATIO), ceil(out[-1] * 100 / percent), out[-1] + 1))
    return np.array(out)


def allot(low: int, high: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments, how many of them with one deletion, spare ones) for sets of low..high - 1
    n-grams: the cheapest mix whose segments count for more than the differences."""
    top = high - 1
    most = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    if low < THIN * (most + 1) and most > 1:
        return _thin(low, high, most)
    n, best = (low + top) / 2, (float("inf"), 0, 0, 0)
    for deleted in range(min(most + 1, 4)):
        spare = SPARE if not deleted else 0
        segments = max(most + 1 - deleted, deleted) + spare
        if deleted > segments:
            continue
        size = n / segments
        cost = segments - spare + deleted * size + STRANGER * (segments - spare) * 4.0 ** -min(size, 400)
        best = min(best, (cost, segments, deleted, spare))
    return best[1:]


def _thin(low: int, high: int, most: int) -> tuple[int, int, int]:
    """As ``allot``, where plain segments would be thin: small sets have few, each with one
    deletion; of large ones so many are spare that no set has to keep an empty one, which
    it would share with all sets of its band."""
    spare, deleted = SPARE, (most + 2) // 2
    while high > 128 and spare <= most:
        segments = most + 1 + spare
        empty = segments * exp(-low / segments)
        if spare >= empty + 4 * sqrt(empty):
            return segments, 0, spare
        spare += max(1, spare // 50)
    return max(most + 1 - deleted, deleted), deleted, 0


@cache
def allotted(percent: int) -> np.ndarray:
    """``allot`` of each band."""
    cut = bands(percent).tolist()
    return np.array([allot(a, b, percent) for a, b in zip(cut, cut[1:], strict=False)])


BANDS, ALLOTTED = bands(PERCENT), allotted(PERCENT)


def shingle_sets(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram hash), distinct and sorted by both. A text of fewer than ``n`` words has
    its whole sequence as one; a text without words has none."""
    start, end, doc = t.words()
    h = t.word_hashes(start, end)
    size = np.bincount(doc, minlength=t.n)
    keys, docs = [], []
    for k in range(1, n + 1):
        g, at = windows(h, doc, k)
        if k < n:
            whole = size[doc[at]] == k
            g, at = g[whole], at[whole]
        keys.append(g)
        docs.append(doc[at])
    g, d = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(g)
    small = d.astype(np.uint16 if t.n <= 1 << 16 else np.int64)
    order = order[np.argsort(small[order], kind="stable")]
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[new], g[new]


def class_of(d: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit name of each text's set; equal sets, equal name."""
    size, name = np.bincount(d, minlength=n), np.zeros(n, np.uint64)
    np.add.at(name, d, mix(g ^ np.uint64(0xA076_1D64_78BD_642F)))
    return size, mix(name + size.astype(np.uint64)).view(np.int64)


def sketches(d: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Per text, 64 * SKETCH parity bits: each n-gram flips one."""
    bit = mix(g ^ np.uint64(0xE703_7ED1_A0B4_28DB))
    out = np.zeros(n * SKETCH, np.uint64)
    np.bitwise_xor.at(out, d * SKETCH + ((bit >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, SKETCH).view(np.int64)


def long_sketches(d: np.ndarray, g: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """Per text of over ``FULL`` n-grams, 2 to 4 times as many parity bits, a power of two; none of
    the others. The upper half of a sketch on its lower half is the sketch of half as many bits."""
    bits = np.where(size > FULL, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 0)
    first = (np.cumsum(bits) - bits) // 64
    at = np.flatnonzero(bits[d])
    bit, text = mix(g[at] ^ np.uint64(0x1D8E_4E27_C47D_124F)), d[at]
    out = np.zeros(int(bits.sum()) // 64, "<u8")
    np.bitwise_xor.at(out, first[text] + ((bit >> np.uint64(6)).astype(np.int64) & (bits[text] // 64 - 1)), np.uint64(1) << (bit & np.uint64(63)))
    return [out[a:a + n // 64].tobytes() if n else None for a, n in zip(first.tolist(), bits.tolist(), strict=True)]


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two long sketches differ, at the shorter one's length."""
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def signatures(d: np.ndarray, g: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of all sets that can link with a different one."""
    band = np.searchsorted(bands(percent), size, "right") - 1
    under = np.searchsorted(bands(percent), -(-size * percent // 100), "right") - 1
    one, two = np.flatnonzero(band >= 0), np.flatnonzero((under >= 0) & (under < band))
    job_text, job_band = np.concatenate([one, two]), np.concatenate([band[one], under[two]])
    m, deleted, spare = allotted(percent)[job_band].T
    slot0 = np.cumsum(m) - m
    bounds = np.searchsorted(d, np.arange(len(size) + 1))
    count = size[job_text]
    elem = np.repeat(bounds[job_text] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    job = np.repeat(np.arange(len(m)), count)
    e = g[elem]
    seg = ((mix(e ^ np.uint64(0x8EBC_6AF0_9C88_C6E3)) >> np.uint64(32)) * m[job].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    slot, value = slot0[job] + seg, mix(e ^ np.uint64(0x5899_65CC_7537_4CC3))
    total = np.zeros(m.sum(), np.uint64)
    np.add.at(total, slot, value)
    slot_job = np.repeat(np.arange(len(m)), m)
    place = mix((job_band[slot_job] * (1 << 32) + np.arange(len(total)) - slot0[slot_job]).astype(np.uint64))
    sig, held = mix(total ^ place), np.bincount(slot, minlength=len(total))
    order = np.lexsort((sig, held, slot_job))
    rank = np.arange(len(total)) - slot0[slot_job[order]]
    keep = order[rank >= spare[slot_job[order]]]
    less = np.flatnonzero(seg < deleted[job])
    return (np.concatenate([job_text[slot_job[keep]], job_text[job[less]]]),
            np.concatenate([sig[keep], mix((total[slot[less]] - value[less]) ^ place[slot[less]])]).view(np.int64))


def read_sets(docs: DataFrame, n: int) -> DataFrame:
    """Per row of (_id, _text, text): size, class and parity sketches of its set."""
    def read(b: pa.RecordBatch) -> dict:
        t = Texts(b.column("text"), lower=True)
        d, g = shingle_sets(t, n)
        size, name = class_of(d, g, t.n)
        sk = sketches(d, g, t.n)
        return {"n": size, "cls": name, "long": long_sketches(d, g, size)} | {f"s{i}": sk[:, i] for i in range(SKETCH)}

    return arrow_map(docs, read, {"n": LONG, "cls": LONG, "long": BINARY} | {f"s{i}": LONG for i in range(SKETCH)}, ["_id", "_text"])


def _packets(sig: np.ndarray, cls: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Signatures by hash range: five bytes of each, and its class as a number in a list."""
    order = np.argsort(sig)
    sig, cls = sig[order], cls[order]
    bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(sig) else np.zeros(0, np.int64)
    low = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    rows = []
    for a, e in zip(at, np.append(at, len(sig))[1:], strict=True):
        classes, own = np.unique(cls[a:e], return_inverse=True)
        rows.append((int(bucket[a]), low[a:e].tobytes(), own.astype("<u2" if len(classes) <= 1 << 16 else "<u4").tobytes(), classes.astype("<i8").tobytes()))
    bucket_, sigs, owns, lists = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket_, pa.int64()), *(pa.array(x, pa.binary()) for x in (sigs, owns, lists))], names=["bucket", "sigs", "own", "classes"])


def send_signatures(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """The signatures of all rows of (_id, text) that have an id, in packets by hash range. A
    task sends a range what it has gathered, so there are never more packets than signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in pieces(batches, "text"):
            t = Texts(b.column("text"), lower=True)
            d, g = shingle_sets(t, n)
            size_, name = class_of(d, g, t.n)
            who, sig = signatures(d, g, size_, percent)
            held.append((sig.view(np.uint64), name[who]))
            size += len(sig)
            if size >= GATHERED:
                yield _packets(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                held, size = [], 0
        if size:
            yield _packets(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

    return docs.filter("_id is not null").mapInArrow(run, "bucket long, sigs binary, own binary, classes binary")


class Meeting:
    """The distinct signatures of a bucket with the first class of each. ``add`` returns who
    meets another class there; a signature of a great many classes is one entry."""

    def __init__(self):
        self.sig, self.first, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        lead = np.concatenate([[True], sig[1:] != sig[:-1]])
        new = sig[lead]
        at = np.searchsorted(self.sig, new)
        there = (at < len(self.sig)) & (self.sig[np.minimum(at, len(self.sig) - 1)] == new) if len(self.sig) else np.zeros(len(new), bool)
        self.sig = np.insert(self.sig, at[~there], new[~there])
        self.first = np.insert(self.first, at[~there], cls[lead][~there])
        self.told = np.insert(self.told, at[~there], False)
        place = np.repeat(np.searchsorted(self.sig, new), np.diff(np.append(np.flatnonzero(lead), len(sig))))
        other = cls != self.first[place]
        known = np.unique(place[other])
        known = known[~self.told[known]]
        self.told[known] = True
        return np.concatenate([sig[other], self.sig[known]]), np.concatenate([cls[other], self.first[known]])


def meet_signatures(sent: DataFrame, tasks: int) -> DataFrame:
    """(sig, cls) of all classes that share a signature with another one. Five bytes and the
    bucket tell signatures apart; a chance meeting is one candidate more, and is verified."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, meeting: Meeting, held: list) -> pa.RecordBatch:
            sig, cls = meeting.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(mix(sig + np.uint64(bucket) * np.uint64(BASE)).view(np.int64)), pa.array(cls)], names=["sig", "cls"])

        for (bucket,), parts in groupby(runs(batches, ["bucket"]), key=itemgetter(0)):
            meeting, held, size = Meeting(), [], 0
            for _, b in parts:
                for s, o, c in zip(*(b.column(x) for x in ("sigs", "own", "classes")), strict=True):
                    raw = np.zeros((len(s.as_buffer()) // 5, 8), np.uint8)
                    raw[:, :5] = np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, 5)
                    classes = np.frombuffer(c.as_buffer(), "<i8")
                    own = np.frombuffer(o.as_buffer(), "<u2" if len(classes) <= 1 << 16 else "<u4")
                    held.append((raw.view("<u8").reshape(-1).astype(np.uint64), classes[own].astype(np.int64)))
                    size += len(own)
                    if size >= MERGED:
                        yield out(int(bucket), meeting, held)
                        held, size = [], 0
            if held:
                yield out(int(bucket), meeting, held)

    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "sig long, cls long")


def read_members(docs: DataFrame, n: int) -> DataFrame:
    """Per row of (_id, text): class and the sorted n-gram hashes of its set."""
    def read(b: pa.RecordBatch) -> dict:
        t = Texts(b.column("text"), lower=True)
        d, g = shingle_sets(t, n)
        cut = np.searchsorted(d, np.arange(t.n + 1))
        return {"cls": class_of(d, g, t.n)[1], "grams": [g[a:e].tobytes() for a, e in zip(cut, cut[1:], strict=False)]}

    return arrow_map(docs, read, {"cls": LONG, "grams": BINARY}, ["want"])


def _close(a: str, b: str, percent: int) -> Column:
    """What every linked pair fulfils: sizes within reach, and no more parity bits apart than
    n-grams can differ."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def within_reach(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) without those of large sets whose long sketches differ in more bits than
    n-grams of a linked pair can. A sketch has at most a sixteenth of the bytes of its set."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    known = sets.filter("long is not null").select("cls", "n", "long").join(asked.hint("merge"), "cls", "left_semi").dropDuplicates(["cls"])
    side = lambda x: known.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("long").alias(f"long_{x}"))

    def check(batch: pa.RecordBatch) -> dict:
        near = []
        for na, x, nb, y in zip(*(batch.column(c) for c in ("na", "long_a", "nb", "long_b")), strict=True):
            near.append(not (x.is_valid and y.is_valid) or
                        bits_apart(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) * (100 + percent) <= (na.as_py() + nb.as_py()) * (100 - percent))
        return {"_rows": np.flatnonzero(near)}

    return arrow_map(pairs.join(side("a"), "a", "left").join(side("b"), "b", "left"), check, {}, ["a", "b"], "long_a")


def verify(pairs: DataFrame, own: DataFrame, all_sets: DataFrame, info: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that link, decided on the full sets. Texts are read again
    for one representative of each class in question; the long sketches come first, as pairs
    of unlike large sets grow with the square of the corpus and full sets go out with each pair."""
    pairs = settle(within_reach(pairs, all_sets, percent), "near")
    need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(info.select("cls", "rep"), "cls")
    # the same join at every size: how many classes are in question follows the corpus
    texts = own.join(need.select(F.col("rep").alias("_id"), F.col("cls").alias("want")).hint("merge"), "_id").select("want", "text")
    sets = settle(read_members(texts, n).filter("cls = want").select("cls", "grams").dropDuplicates(["cls"]), "sets")
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b"))

    def check(batch: pa.RecordBatch) -> dict:
        link = []
        for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(p) + len(q) - len(np.union1d(p, q))
            link.append(100 * shared >= percent * (len(p) + len(q) - shared))
        return {"_rows": np.flatnonzero(link)}

    links = settle(arrow_map(both, check, {}, ["a", "b"], "ga"), "links")
    del texts, sets, both
    drop_shuffles(links.sparkSession)
    return links


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the smallest class reachable over links (a, b), by alternating large and
    small stars. A round is written before the next reads it; a node's neighbours are only ever
    grouped by aggregates and joins, so a hub is no single task's load."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (got.n, got.h) == state:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("label")).distinct())
        state = (got.n, got.h)


class Join:
    """The tables of one join: rows, candidate buckets, and what is known of their classes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int = PERCENT):
        self.n, self.percent = n, percent
        # the hash of the text tells rows of one id apart
        self.own = chosen(docs, _id=id_col, text=text_col).withColumn("_text", F.xxhash64("text"))
        self.sets, got = settle_counted(read_sets(self.own, n), "sets", grams=F.sum("n"))
        buckets = max(4 * shuffle_width(docs.sparkSession), ceil(got["grams"] / BUCKET_GRAMS))
        sent = send_signatures(self.own, n, percent, buckets)
        self.members = settle(meet_signatures(sent, ceil(buckets / 4)).distinct(), "buckets")
        del sent
        drop_shuffles(docs.sparkSession)
        classes = self.sets.filter("_id is not null and n > 0").groupBy("cls").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(SKETCH)])
        self.info = settle(classes.join(self.members.select("cls").distinct(), "cls", "left_semi"), "classes")

    def stars(self) -> DataFrame:
        """Each bucket's members paired with the one that meets most others, over all buckets."""
        size = self.members.groupBy("sig").agg(F.count("*").alias("size"))
        weight = self.members.join(size, "sig").groupBy("cls").agg(F.sum("size").alias("weight"))
        hub = self.members.join(weight, "cls").groupBy("sig").agg(F.max_by("cls", F.struct("weight", "cls")).alias("hub"))
        pairs = self.members.join(hub, "sig").filter("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        x, y = self.info.select(F.col("cls").alias("a"), F.struct(*self.info.columns).alias("x")), self.info.select(F.col("cls").alias("b"), F.struct(*self.info.columns).alias("y"))
        return settle(pairs.join(x, "a").join(y, "b").filter(_close("x", "y", self.percent)).select("a", "b"), "pairs")

    def rest(self, labels: DataFrame | None, done: DataFrame | None) -> DataFrame:
        """All close pairs of a bucket, if labels are given those across components only."""
        m = self.members.join(self.info, "cls")
        m = m.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")) if labels is not None else m.withColumn("label", F.col("cls"))
        mixed = m.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sig")
        m = m.join(mixed, "sig", "left_semi")
        pairs = (m.alias("x").join(m.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") < F.col("y.label")) & _close("x", "y", self.percent))
                 .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct())
        return settle(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs, "pairs")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(links, membership): every linked pair of different sets, as the smallest ids of their
    classes, and the class of each row, likewise. Copies are not expanded into pairs."""
    j = Join(docs, id_col, text_col, n, percent)
    links = verify(j.rest(None, None), j.own, j.sets, j.info, n, percent)
    rep = j.sets.filter("_id is not null and n > 0").groupBy("cls").agg(F.min("_id").alias("rep"))
    a, b = rep.select(F.col("cls").alias("a"), F.col("rep").alias("id_a")), rep.select(F.col("cls").alias("b"), F.col("rep").alias("id_b"))
    pairs = links.join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return pairs, j.sets.filter("_id is not null and n > 0").join(rep, "cls").select(F.col("_id").alias(id_col), F.col("rep").alias("class_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = PERCENT) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``, the smallest id that
    links of at least ``percent`` per cent lead to.

    A text without words (null, empty or white space) has no n-grams and links with nothing; a
    row with a null id links with nothing and has a null component. Rows of equal sets are one
    class, repeated rows among them, and each is returned. Other columns are not looked at.
    Classes and n-grams are told apart by 64-bit hashes.
    """
    return _labelled(docs, id_col, text_col, n, percent).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _labelled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(_id, _text, n, component_id) of each row, written; what led to it is deleted."""
    with passing_scratch(docs.sparkSession):
        j = Join(docs, id_col, text_col, n, percent)
        first = j.stars()
        links = verify(first, j.own, j.sets, j.info, n, percent)
        labels = components(links)
        links = links.unionByName(verify(j.rest(labels, first), j.own, j.sets, j.info, n, percent))
        labels = components(links)
        real = j.sets.filter("_id is not null and n > 0")
        named = real.groupBy("cls").agg(F.min("_id").alias("rep")).join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        of = named.join(smallest, "label").select("cls", "component_id")
        out = real.join(of, "cls").select("_id", "_text", "n", "component_id")
        alone = j.sets.filter("_id is null or n = 0").select("_id", "_text", "n", F.col("_id").alias("component_id"))
        return settle(out.unionByName(alone), "components", keep=True)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but the first document of each component, columns unchanged. Rows
    with a null id stay; rows of one id and text are one document, rows of one id and different
    texts are judged each by its text."""
    found = _labelled(docs, id_col, text_col, n, percent)
    first = found.filter("_id = component_id").groupBy("_id", "_text").agg(F.count("*").alias("_rows"))
    kept = docs.join(first.select("_id", "_text"), (docs[id_col] == first["_id"]) & (F.xxhash64(docs[text_col]) == first["_text"]), "left_semi")
    if not first.filter("_rows > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.filter(docs[id_col].isNull()))
