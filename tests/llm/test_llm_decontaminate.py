import random

import numpy as np
from llm_cases import EDGE, LONG, PROSE, edge

from carryover.llm import decontaminate as D

VOCAB = [f"w{i}" for i in range(3000)]
RND = random.Random(5)
ITEMS = [(i, " ".join(RND.choices(VOCAB, k=n))) for i, n in enumerate([3, 8, 11, 12, 14, 20, 24, 31, 40, 48, 60, 90])]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(text, k, rnd):
    w = text.split()
    for _ in range(k):
        j = rnd.randrange(len(w))
        w[j:j + 1] = rnd.choice([[], [rnd.choice(VOCAB)], [w[j], rnd.choice(VOCAB)]])
    return " ".join(w)


def bench(spark, items=ITEMS):
    return spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")


def test_finds_planted_items_and_leaves_clean_texts(spark):
    rnd, rows, want = random.Random(9), [], set()
    for i, t in ITEMS:
        for k in sorted({0, int(0.1 * len(t.split())) if len(t.split()) >= D.SHORT else 0}):
            for copy in range(4):
                d = len(rows)
                rows.append((d, " ".join(rnd.choices(VOCAB, k=rnd.randrange(90))) + "\n" + edited(t, k, rnd).upper() + ", " + " ".join(rnd.choices(VOCAB, k=rnd.randrange(90)))))
                want.add((d, i))
    rows += [(d, " ".join(rnd.choices(VOCAB, k=300))) for d in range(len(rows), len(rows) + 50)]
    text = dict(rows)
    for block in (D.BLOCK_WORDS, 60):
        got = D.find_leaks(edge(spark, rows), bench(spark), block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        item, words = ITEMS[r.item_id][1].split(), text[r.doc_id].lower().replace(",", " ").split()
        assert r.edits == distance(item, words[r.first_word:r.first_word + r.n_words])
        assert abs(r.similarity - (1 - r.edits / len(item))) < 1e-12


def test_recall_at_the_edge_of_similarity():
    import pyarrow as pa

    rnd = random.Random(2)
    items = [" ".join(rnd.choices(VOCAB, k=rnd.randrange(14, 60))) for _ in range(150)]
    index = D.ItemIndex.build(list(range(150)), items)
    texts = [" ".join(rnd.choices(VOCAB, k=rnd.randrange(40))) + " " + edited(t, int(D.EDITS * len(t.split())), rnd) + " tail" for t in items]
    found = {(h[0], h[1]) for h in index.hits(D.folded(pa.array(texts)))}
    assert np.mean([(i, i) in found for i in range(150)]) >= 0.9


def test_recall_at_every_length():
    """Items with as many edits as are allowed, from the shortest that may have one."""
    import pyarrow as pa

    rnd = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    for n in (*range(D.SHORT, 34), 40, 47, 48, 49, 60, 90):
        items = [" ".join(rnd.choices(words, k=n)) for _ in range(150)]
        index = D.ItemIndex.build(list(range(150)), items)
        texts = [" ".join(rnd.choices(words, k=rnd.randrange(40))) + " " + edited(t, int(D.EDITS * n), rnd) + " tail" for t in items]
        found = {(h[0], h[1]) for h in index.hits(D.folded(pa.array(texts)))}
        assert np.mean([(i, i) in found for i in range(150)]) >= 0.9, n


def test_edge_cases(spark):
    items = [(1, PROSE), (2, PROSE + "!"), (3, None), (4, ""), (None, PROSE), (5, "东京 tower")]
    got = D.find_leaks(edge(spark), bench(spark, items)).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert D.find_leaks(edge(spark), bench(spark).limit(0)).count() == 0 and D.find_leaks(edge(spark).limit(0), bench(spark)).count() == 0
    kept = D.drop_leaks(edge(spark), bench(spark, items))
    assert kept.columns == edge(spark).columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted((d or 0, len(t or "")) for d, t in EDGE if t != PROSE)
    assert any(r.text == LONG for r in kept.collect()) and D.drop_leaks(edge(spark), bench(spark).limit(0)).count() == len(EDGE)


def test_an_item_behind_a_long_run_of_its_first_words():
    import pyarrow as pa

    rnd = random.Random(21)
    for period in (["ha"], ["ha", "ho"]):
        for run in (0, 20, 60, 62, 300):
            start = (period * 8)[:8]
            item = [*start, *rnd.sample(VOCAB, 12)]
            text = [*(period * run)[:run], *item, *rnd.sample(VOCAB, 5)]
            index = D.ItemIndex.build([1], [" ".join(item)])
            got = index.hits(D.folded(pa.array([" ".join(text)])))
            assert got == [(0, 0, run, 20, 0)], (period, run, got)
