import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGE, LONG, edge

from carryover.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def plain(text):
    return B.encoding(PATH, P.PATTERN).encode_ordinary(text or "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab' \n\t\u3000\u00a0é東1!\x1c", max_size=60), st.integers(1, 9))
def test_chunks_do_not_change_the_ids(text, chunk):
    ids = B.encode_text(text, PATH, P.PATTERN, chunk)
    assert ids.tolist() == plain(text) and B.decode_ids(ids, PATH, P.PATTERN).decode() == text


@pytest.mark.parametrize("spread", [B.SPREAD, 40, 0])
def test_rows_and_round_trip(spark, spread):
    rows = [r for r in EDGE if r[1] is not LONG] + [(5, LONG[:5000]), (5, LONG[:5000])]
    got = B.bpe_encode(edge(spark, rows), PATH, P.PATTERN, chunk=50, spread_over=spread).collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=key) == sorted(((d, plain(t)) for d, t in rows), key=key)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_digests(spark):
    got = {r.doc_id: r for r in B.bpe_round_trip(edge(spark, [(1, "a b"), (2, None)]), PATH, P.PATTERN).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest() and got[2].n_tokens == 0
    assert got[1].ids_sha256 == hashlib.sha256(np.array(plain("a b"), "<u4").tobytes()).hexdigest()
    assert B.bpe_round_trip(edge(spark).limit(0), PATH, P.PATTERN).count() == 0
