import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGE, LONG, PROSE, edge, lower, words

from carryover.llm import jaccard as J
from carryover.llm.text import Texts


def shingles(text, n=3):
    w = words(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*[w[i:] for i in range(n)], strict=False)) if w else frozenset()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and label[i] != label[j] and linked(sets[i], sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            low[x] = min(low.get(x, d), d)
    return sorted(((-1 if d is None else d, len(s), -1 if d is None else d if not s else low[x]) for (d, _), s, x in zip(rows, sets, label, strict=True)))


def corpus(seed, sizes, n):
    """Families of copies with a few edits each, so that similarities lie around the limit."""
    rnd, rows = random.Random(seed), []
    vocab = [f"v{i}" for i in range(4000)]
    for i in range(n):
        base = rnd.choices(vocab, k=rnd.choice(sizes))
        for _ in range(rnd.randrange(1, 6)):
            w = list(base)
            for _ in range(rnd.randrange(0, 2 + len(w) // 60)):
                j = rnd.randrange(len(w))
                w[j:j + 1] = rnd.choice([[], [rnd.choice(vocab)], [w[j], rnd.choice(vocab)]])
            rows.append((len(rows) * 7 % 1009, " ".join(w) or "x"))
    return rows


@pytest.mark.parametrize("seed, sizes, n", [(1, [9, 11, 12, 14, 20], 60), (2, [30, 50, 80, 120], 50), (3, [200, 400, 900], 15)])
def test_components_match_brute_force(spark, seed, sizes, n):
    rows = corpus(seed, sizes, n)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(edge(spark, rows)).collect())
    assert got == brute(rows)


def test_links_match_brute_force(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(4, [12, 40, 100], 40))]
    links, members = J.jaccard_links(edge(spark, rows))
    sets = {d: shingles(t) for d, t in rows}
    first = {}
    for d, s in sets.items():
        first.setdefault(s, d)
    want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and linked(s, t)}
    assert {(r.id_a, r.id_b) for r in links.collect()} == want and want
    assert {r.doc_id: r.class_id for r in members.collect()} == {d: first[s] for d, s in sets.items()}


def test_every_linked_pair_shares_a_signature():
    rnd, vocab = random.Random(6), [f"v{i}" for i in range(9000)]
    for n in (11, 12, 13, 16, 22, 23, 33, 34, 50, 75, 110, 165, 245, 370, 560, 1200):
        for _ in range(12):
            a = rnd.choices(vocab, k=n)
            b = list(a)
            while True:
                c = list(b)
                c[rnd.randrange(len(c)):][:1] = []
                j = rnd.randrange(len(c))
                c[j:j + 1] = rnd.choice([[], [rnd.choice(vocab)], [c[j], rnd.choice(vocab)]])
                if not linked(shingles(" ".join(a)), shingles(" ".join(c))):
                    break
                b = c
            t = Texts(pa.array([" ".join(a), " ".join(b)]), lower=True)
            d, g = J.shingle_sets(t, 3)
            size, name = J.class_of(d, g, 2)
            who, sig = J.signatures(d, g, size)
            sk = J.sketches(d, g, 2)
            apart = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(sk[0].view(np.uint64), sk[1].view(np.uint64), strict=True))
            assert apart * 190 <= int(size.sum()) * 10
            assert name[0] == name[1] or set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()), (n, a == b)


def test_allotments_cover_the_differences():
    for (low, high), (m, deleted, spare) in zip(zip(J.BANDS[:30].tolist(), J.BANDS[1:31].tolist(), strict=True), J.ALLOTTED[:30].tolist(), strict=True):
        most = max((a + b) * 10 // 190 for a in (high - 1,) for b in range(a, a * 100 // 90 + 1))
        assert m + deleted - spare >= most + 1 and (not spare or not deleted) and 0 <= deleted <= m, (low, high)


def test_a_hub_and_its_many_copies(spark):
    rnd, vocab = random.Random(8), [f"v{i}" for i in range(5000)]
    base = rnd.choices(vocab, k=150)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    rows.insert(70, (500, " ".join(base)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(edge(spark, rows)).collect())
    assert got == sorted(brute(rows))


def test_components_of_chains(spark):
    rnd = random.Random(3)
    nodes = rnd.sample(range(10_000), 200)
    edges = list(zip(nodes, nodes[1:60], strict=False)) + [(nodes[100], nodes[i]) for i in range(101, 150)] + [(nodes[150], nodes[151])]
    got = {r.cls: r.label for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(nodes[:60]) for x in nodes[:60]} | {x: min(nodes[100:150]) for x in nodes[100:150]} | {x: min(nodes[150:152]) for x in nodes[150:152]}
    assert got == want
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in J.jaccard_components(edge(spark)).collect())
    assert got == brute(EDGE)
    assert J.jaccard_components(edge(spark).limit(0)).count() == 0
    kept = J.keep_one(edge(spark, [*EDGE, (0, PROSE), (9, LONG + " end")]))
    assert kept.columns == edge(spark).columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, -1, 0, 2, 3, 4, 5, 6, 7, 8]


def linked_at(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


@pytest.mark.parametrize("seed, sizes, n", [(11, [9, 12, 16, 20, 30], 50), (12, [40, 60, 90, 130], 40), (13, [200, 400, 900], 12)])
def test_five_words_and_80_per_cent_match_brute_force(spark, seed, sizes, n):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(seed, sizes, n))]
    rnd, vocab = random.Random(seed), [f"v{i}" for i in range(4000)]
    for i, t in list(rows[::3]):
        rows.append((len(rows), " ".join([t, *rnd.choices(vocab, k=len(t.split()) * rnd.randrange(8, 28) // 100)])))
    sets = [shingles(t, 5) for _, t in rows]
    label = list(range(len(rows)))
    apart = 0
    for i in range(len(rows)):
        for j in range(i):
            if linked_at(sets[i], sets[j], 80):
                apart += not linked(shingles(rows[i][1]), shingles(rows[j][1]))
                label = [label[j] if x == label[i] else x for x in label]
    low = {}
    for i, x in enumerate(label):
        low[x] = min(low.get(x, i), i)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(edge(spark, rows), n=5, percent=80).collect()}
    assert got == {i: low[x] for i, x in enumerate(label)} and apart
    assert {r.doc_id for r in J.keep_one(edge(spark, rows), n=5, percent=80).collect()} == set(low.values())


@pytest.mark.parametrize("percent", [50, 67, 80, 95])
def test_allotments_cover_the_differences_at(percent):
    cut = J.bands(percent).tolist()[:25]
    for (low, high), (m, deleted, spare) in zip(zip(cut, cut[1:], strict=False), J.allotted(percent)[:24].tolist(), strict=True):
        most = max((high - 1 + b) * (100 - percent) // (100 + percent) for b in range(high - 1, (high - 1) * 100 // percent + 1))
        assert m + deleted - spare >= most + 1 and (not spare or not deleted) and 0 <= deleted <= m, (low, high)


def test_pipeline_links_five_words_and_80_per_cent(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, *[f"more{i}" for i in range(40)]])), (3, " ".join(rnd.sample(base, 200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {1, 3}


def test_rows_of_one_id_are_kept_by_their_text(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    rows = [(3, a), (5, a + " more"), (5, b), (6, b), (6, b), (None, a), (7, None)]
    got = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(3, a), (5, b), (None, a), (7, None)], key=repr)


def test_meetings_tell_all_that_share_a_signature():
    """Whatever the order and the cut of the packets; a signature of many classes is one entry."""
    r = np.random.default_rng(4)
    sig, cls = r.integers(0, 300, 4000).astype(np.uint64), r.integers(0, 900, 4000)
    sig[:1500], cls[:1500] = 7, np.arange(1500)
    pairs = set(zip(sig.tolist(), cls.tolist()))
    want = {(s, c) for s, c in pairs if len({d for t, d in pairs if t == s}) > 1}
    for step in (4000, 700, 33):
        order, met, got = r.permutation(4000), J.Meeting(), set()
        for at in range(0, 4000, step):
            got |= set(zip(*(x.tolist() for x in met.add(sig[order[at:at + step]], cls[order[at:at + step]]))))
        assert got == want and len(met.sig) == len(np.unique(sig))


def test_packets_bring_back_every_signature():
    r = np.random.default_rng(5)
    sig, cls = r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), r.integers(-(1 << 62), 1 << 62, 40)[r.integers(0, 40, 5000)]
    b = J._packets(sig, cls, 37)
    got = []
    for bucket, s, o, c in zip(*(x.to_pylist() for x in b.columns)):
        raw = np.frombuffer(s, np.uint8).reshape(-1, 5)
        low = sum(raw[:, k].astype(np.uint64) << np.uint64(8 * k) for k in range(5))
        got += [(bucket, x, y) for x, y in zip(low.tolist(), np.frombuffer(c, "<i8")[np.frombuffer(o, "<u2")].tolist())]
    assert sorted(got) == sorted(((x >> 32) * 37 >> 32, x & (1 << 40) - 1, y) for x, y in zip(sig.tolist(), cls.tolist()))
    assert J._packets(sig[:0], cls[:0], 37).num_rows == 0


def test_a_long_sketch_differs_in_no_more_bits_than_sets_in_ngrams():
    r, vocab = random.Random(8), [f"v{i}" for i in range(4000)]
    for size in (300, 700, 1020, 1030, 5000):
        base = r.choices(vocab, k=size)
        for edits in (0, 1, 9, size // 10):
            other = list(base)
            for _ in range(edits):
                other.insert(r.randrange(len(other)), r.choice(vocab))
            d, g = J.shingle_sets(Texts(pa.array([" ".join(base), " ".join(other), "a b"])), 3)
            x, y, none = J.long_sketches(d, g, np.bincount(d, minlength=3))
            apart = J.bits_apart(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))
            assert none is None and apart <= len(set(g[d == 0].tolist()) ^ set(g[d == 1].tolist())) and len(x) <= size // 2 + 64
            assert apart > edits or not edits


def test_large_sets_that_are_unlike_are_not_sent_out_whole(spark, monkeypatch):
    r, vocab, sent = random.Random(9), [f"v{i}" for i in range(4000)], []
    base = [r.choices(vocab, k=1500) for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join(["new", *base[0]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    j = J.Join(docs, "doc_id", "text", 5, 80)
    info = j.sets.withColumnRenamed("_id", "rep")
    x, y = info.alias("x"), info.alias("y")
    pairs = x.crossJoin(y).filter("x.cls < y.cls").filter(J._close("x", "y", 80)).selectExpr("x.cls a", "y.cls b")
    assert pairs.count() == 21
    real = J.settle
    monkeypatch.setattr(J, "settle", lambda df, name="stage", **kw: sent.append((name, real(df, name, **kw))) or sent[-1][1])
    assert J.verify(pairs, j.own, j.sets, info, 5, 80).count() == 1
    assert [df.count() for name, df in sent if name == "sets"] == [2]
