import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGE, LONG, PROSE, edge, words

from carryover.llm import quality as Q
from carryover.llm.text import Texts


def brute(text):
    w, text = words(text), text or ""
    five = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = {f: five.count(f) for f in set(five)} if len(five) < 2000 else None
    covered = None if count is None else {i + j for i, f in enumerate(five) if count[f] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, None if covered is None else len(covered)


def test_counts_match_brute_force():
    texts = [t for _, t in EDGE if t is not LONG] + ["a b c d e x a b c d e", "l one\nl one\n \nl one", "#|<>&%$* é", "a " * 30, "x\n" * 4]
    m = Q.measure(Texts(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), t


def test_edge_cases_have_one_row_each(spark):
    got = Q.quality_rules(edge(spark)).collect()
    assert len(got) == len(EDGE)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[2, 0].base_failed and by[3, 0].base_failed and not by[4, 0].kept
    assert by[1, len(words(PROSE))].kept and by[None, len(words(PROSE))].kept and sum(r.doc_id == 1 for r in got) == 2
    assert by[5, 120_000].n_words == len(words(LONG))
    assert Q.quality_rules(edge(spark).limit(0)).count() == 0


def test_em_tells_good_from_bad():
    rnd = np.random.default_rng(1)
    prose = [" ".join(rnd.choice(PROSE.split(), 60)) for _ in range(300)]
    junk = [" ".join(w + "###" for w in p.split()) for p in prose[:20]] + [" | ".join(p.split()) for p in prose[20:40]] + [p.upper().replace(" ", "!! ") for p in prose[40:60]]
    code = Q.votes(Q.measure(Texts(pa.array(prose + junk))))
    u, n = np.unique(code, return_counts=True)
    p = Q.fit_patterns(u, n).posterior(code)
    assert (p[:300] >= 0.5).mean() > 0.99 and (p[300:] < 0.5).mean() > 0.9


def test_only_clean_documents_are_all_kept():
    code = Q.votes(Q.measure(Texts(pa.array([PROSE] * 50))))
    u, n = np.unique(code, return_counts=True)
    assert (Q.fit_patterns(u, n).posterior(u) >= 0.5).all()
    empty = Q.fit_patterns(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert (empty.posterior(u) >= 0.5).all()


def test_keep_good_returns_the_documents(spark):
    docs = edge(spark)
    kept = Q.keep_good(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept.collect()) == [(0, len(PROSE)), (1, len(PROSE)), (1, len(PROSE))] + ([(5, len(LONG))] if any(r.doc_id == 5 for r in kept.collect()) else [])
    assert Q.keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize("good", [0.33, 0.6, 0.9])
def test_rates_are_free(good):
    """Simulated votes: the share of good documents and the rates are found, whichever is larger;
    the first guess says four fifths are good."""
    import numpy as np
    r = np.random.default_rng(9)
    n, k = 60_000, len(Q.RULES)
    true = np.stack([r.uniform(0.2, 0.7, k), r.uniform(0.005, 0.06, k), r.uniform(0.5, 0.95, k), r.uniform(0.05, 0.4, k)], 1)
    kind = r.random(n) < good
    u = r.random((n, k))
    bad, fine = np.where(kind[:, None], true[:, 1], true[:, 0]), np.where(kind[:, None], true[:, 2], true[:, 3])
    votes = np.where(u < bad, 2, np.where(u > 1 - np.minimum(fine, 1 - bad), 1, 0))
    code, inverse, count = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_inverse=True, return_counts=True)
    model = Q.fit_patterns(code, count)
    kept = model.posterior(code)[inverse] >= 0.5
    assert abs(model.good - good) < 0.03 and (kept == kind).mean() > 0.97
    assert np.abs(np.array(model.rates)[:, 0] - true[:, 0]).max() < 0.05
