import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from llm_cases import PROSE
from test_llm_jaccard import shingles

from carryover.llm import bpe, queries

RND = random.Random(11)
VOCAB = [f"{a}{b}{c}" for a in ("the", "an", "or", "ti") for b in ("on", "er", "in", "al") for c in ("", "s", "ed", "ing", "ly")]


def prose(n):
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(RND.choices(VOCAB, k=n))) + "."


ITEM = prose(30)
BASE = prose(200)
KEY = "0123456789abcdef" * 2
CLEAN = [prose(RND.randrange(40, 300)) for _ in range(40)]
ROWS = [(i, t) for i, t in enumerate(CLEAN)] + [
    (50, BASE), (51, BASE), (52, BASE + " extra"), (53, BASE.upper().lower()),
    (60, f"{CLEAN[0][:200]} {ITEM} {CLEAN[1][:150]}"), (61, f"{prose(50)} token = \"{KEY}\" {prose(20)}"),
    (70, " ".join(w + "###" for w in prose(60).split())), (71, "too short"), (72, None), (73, "a b c d e " * 40)]


def write(spark, path):
    spark.createDataFrame([(d, t, "en", "s", len(t) if t else None) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_and_result(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names or i == len(corpus_pipeline.STAGES) - 1
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = set(range(40)) | {50, 51, 52, 53, 60, 61}
    assert left == [good, good - {51, 52, 53}, good - {51, 52, 53, 60}, good - {51, 52, 53, 60}, good - {51, 52, 53, 60}]
    assert len({shingles(t) for d, t in ROWS if d in left[1]}) == len(left[1])
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {d: bytes(r.ids) for d, r in whole.items()} == {r.doc_id: bytes(r.ids) for r in docs.collect()}
    path = P.path(queries.RANKS)
    for d, r in whole.items():
        want = dict(ROWS)[d] if d != 61 else dict(ROWS)[d].replace(f'token = "{KEY}', "[secret]")
        assert bpe.decode_ids(np.frombuffer(r.ids, "<u4"), path, P.PATTERN).decode() == want and r.n_tokens == len(r.ids) // 4


def test_an_empty_table_stays_empty(spark, tmp_path):
    write(spark, str(tmp_path / "a"))
    empty = spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert PROSE
