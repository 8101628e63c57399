import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SPACE, lower

from carryover.llm import text as X

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab A\n\té東.|", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    t = X.Texts(pa.array(texts, pa.string()), lower=True)
    start, end, doc = t.words()
    got = [[] for _ in texts]
    for a, b, d in zip(start, end, doc, strict=True):
        got[d].append(t.buf[a:b].tobytes().decode())
    want = [SPACE.findall(lower(x)) for x in texts]
    assert got == want
    h, flat = t.word_hashes(start, end).tolist(), [w for x in want for w in x]
    assert len(set(zip(flat, h, strict=True))) == len(set(flat)) == len(set(h))
    g, at = X.windows(np.array(h, np.uint64), doc, 2)
    assert len(g) == sum(max(len(x) - 1, 0) for x in want)
    assert [int(t.code_points()[e]) for e in t.off[1:]] == [int(x) for x in np.cumsum([len(x or "") for x in texts])]


def test_words_of_letters():
    t = X.Texts(pa.array(["Don't stop—3 é's", "x"]))
    start, end, _ = t.words(X.WORD_BYTES)
    assert [t.buf[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "Don't stop—3 é's x")


def test_pieces_cut_between_texts_only():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c" * 5]})
    got = [p.column("text").to_pylist() for p in X.pieces(iter([b, b.slice(0, 0)]), "text", 12)]
    assert got == [["a" * 10, None], ["b" * 100, ""], ["c" * 5]] or sum(got, []) == b.column("text").to_pylist()
    sliced = X.Texts(b.slice(2).column("text"))
    assert sliced.n == 3 and len(sliced.buf) == 105
