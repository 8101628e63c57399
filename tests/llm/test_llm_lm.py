import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGE, LONG, edge, lower, words
from pyspark.sql import functions as F

from carryover.llm import lm
from carryover.llm.eliasfano import EliasFano, Trie


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 99), st.integers(0, 1 << 60)), max_size=60), st.lists(st.integers(0, 1 << 61), max_size=20))
def test_elias_fano(values, queries):
    v = np.sort(np.array(values, np.uint64))
    s = EliasFano(EliasFano.encode(v))
    assert s.decode().tolist() == v.tolist()
    q = np.array(queries + values, np.uint64)
    at, equal = s.successor(q, s.directory())
    assert at.tolist() == np.searchsorted(v, q).tolist() and equal.tolist() == np.isin(q, v).tolist()


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 50, 20_000).astype(np.uint64))
    assert len(EliasFano.encode(v)) * 8 / len(v) < 50 - math.log2(len(v)) + 2 + 4


def test_trie():
    rnd = np.random.default_rng(2)
    key = np.unique(rnd.integers(0, 1 << 20, 3000).astype(np.uint64))
    trie = Trie([(key >> np.uint64(8), key & np.uint64(255), np.arange(len(key), dtype=np.uint16)), (key[:0], key[:0], np.zeros(0, np.int64))], 8)
    q = rnd.integers(0, 1 << 20, 5000).astype(np.uint64)
    got = trie.lookup(0, q >> np.uint64(8), q & np.uint64(255), 0xFFFF)
    want = {int(k): i for i, k in enumerate(key)}
    assert got.tolist() == [want.get(int(x), 0xFFFF) for x in q]
    assert (trie.lookup(1, q, q, -1) == -1).all()


def brute(rows, train, order):
    counts = [Counter() for _ in range(order)]
    lines = [["<s>", *words(lower(t)), None] for _, t in rows]
    for w, use in zip(lines, train, strict=True):
        if use:
            for k in range(1, order + 1):
                counts[k - 1].update(tuple(w[i - k + 1:i + 1]) for i in range(max(1, k - 1), len(w)))
    n, v = sum(counts[0].values()), len(counts[0])
    out = []
    for w in lines:
        base = score = 0.0
        for i in range(1, len(w)):
            p = (counts[0][w[i],] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, min(order, i + 1) + 1):
                context = tuple(w[i - k + 1:i])
                seen = counts[0][None,] if context == ("<s>",) else counts[k - 2][context]
                p = (counts[k - 1][(*context, w[i])] + lm.PRIORS[k - 2] * p) / (seen + lm.PRIORS[k - 2])
            score += math.log10(p)
        out.append((len(w) - 1, sum(counts[0][x,] > 0 for x in w[1:]), n, base, score))
    return out


@pytest.mark.parametrize("order, block", [(2, 1 << 24), (2, 500), (3, 2000), (4, 2000)])
def test_scores_match_brute_force(spark, order, block):
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choices("a b c A dd e, f é 東 gg".split(), k=rnd.randrange(30)))) for i in range(120)]
    rows += [r for r in EDGE if r[1] is not LONG]
    train = [d is not None and d % 3 > 0 for d, _ in rows]
    got = lm.score_texts(edge(spark, rows), F.col("doc_id") % 3 > 0, order=order, block_bytes=block).collect()
    want = brute(rows, train, order)
    key = lambda x: (-1 if x[0] is None else x[0], x[1], x[4])
    a = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    b = sorted(((d, *w) for (d, _), w in zip(rows, want, strict=True)), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-9 * max(1, abs(y[4])) and abs(x[5] - y[5]) < 2e-3 * max(1, abs(y[5]))


def test_edge_cases(spark):
    got = lm.score_texts(edge(spark), F.lit(None).cast("boolean")).collect()
    assert len(got) == len(EDGE) and all(r.train_tokens == 0 and r.base_score == r.score == 0 and r.n_known == 0 for r in got)
    assert lm.score_texts(edge(spark).limit(0), F.lit(True)).count() == 0
    many = lm.score_texts(edge(spark), F.lit(True), block_bytes=1000).collect()
    assert len(many) == len(EDGE) and all(r.n_known == r.n_tokens and r.score < 0 for r in many)


def test_model_beats_the_base_on_held_out_texts(spark):
    rnd = random.Random(4)
    chain = {w: rnd.choices([f"t{i}" for i in range(60)], k=3) for w in [f"t{i}" for i in range(60)]}

    def walk():
        w = [rnd.choice(list(chain))]
        while len(w) < 40:
            w.append(rnd.choice(chain[w[-1]]))
        return " ".join(w)

    docs = spark.createDataFrame([(i, walk()) for i in range(200)], "doc_id long, text string")
    r = lm.score_texts(docs, F.col("doc_id") < 160).where("doc_id >= 160").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b * 0.8


def test_the_query_scores_with_order_3(spark, tmp_path):
    from carryover.llm import queries

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("a b c d".split(), k=12))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_lm_score(spark, str(tmp_path)).collect()}
    want = brute(rows, [not got[d].held_out for d, _ in rows], 3)
    assert all(abs(got[d].score - w[4]) < 2e-3 * abs(w[4]) for (d, _), w in zip(rows, want, strict=True))


def test_a_shard_looks_an_ngram_up_once_for_all_blocks(monkeypatch):
    texts, asked, real = ["a b c a b", "b c a b d", "", "a b c a b"], [], lm.Trie.lookup
    blocks = [lm._requests(k, pa.chunked_array([pa.array([x], pa.large_string())]), np.array([k != 1]), 3, 1) for k, x in enumerate(texts)]
    keys = [EliasFano(np.frombuffer(b.column("keys")[0].as_py(), np.uint8)).decode() + np.uint64(b.column("base")[0].as_py()) for b in blocks]
    monkeypatch.setattr(lm.Trie, "lookup", lambda self, level, context, *x: asked.append(len(context)) or real(self, level, context, *x))
    got = lm._answers(pa.concat_tables(blocks), 3)
    assert sum(asked) == len(set(np.concatenate(keys).tolist()))
    counts = {}
    for b, k in zip(blocks, keys, strict=True):
        for x, n in zip(k.tolist(), lm._unpacked(b.column("counts")[0].as_py()).tolist(), strict=True):
            counts[x] = counts.get(x, 0) + n
    for k, exact, codes in zip(keys, got.column("exact").to_pylist(), got.column("codes").to_pylist(), strict=True):
        assert lm._unpacked(exact).tolist() == [counts[x] for x in k.tolist() if x & 3 == 0]
        assert np.frombuffer(codes, "<u2").tolist() == [round(lm.STEP * np.log10(counts[x])) if counts[x] else lm.ABSENT for x in k.tolist() if x & 3]
    assert sum(got.column("kinds").to_pylist()) == 4 and got.column("tokens").to_pylist()[1:] == [0, 0, 0]
