import pytest
from llm_cases import EDGE, edge
from pyspark.sql import functions as F

from carryover.llm import langid as G

EN = ["the house and the garden are by the river", "that was the weather of this week", "they think with their hands"]
DE = ["das Haus und der Garten sind an dem Fluss", "das war das Wetter dieser Woche", "sie denken mit ihren Händen"]


def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in EN] + [(t, "de") for t in DE])] + [(90, "xyz", None), (91, None, "en")]
    return G.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_predicts_unseen_texts(spark):
    docs = edge(spark, [(1, "the river and the week"), (2, "der Fluss und die Woche"), (3, "123 ..."), (4, None), (5, ""), (6, "東京")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify_languages(docs, model(spark)).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values()) and got[6][0] in ("en", "de")


def test_edge_cases(spark):
    got = G.identify_languages(edge(spark), model(spark)).collect()
    assert len(got) == len(EDGE)
    none = G.fit_languages(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in G.identify_languages(edge(spark), none).collect()} == {"und"}
    assert G.identify_languages(edge(spark).limit(0), model(spark)).count() == 0


def test_folds(spark):
    import zlib

    d = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "i long")
    got = {r.i: r.h for r in d.select("i", G.held_out(F.col("i"), 4, 2).alias("h")).collect()}
    assert got.pop(None) is False
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_only_letters_of_any_plane_count():
    import numpy as np
    import pyarrow as pa

    from carryover.llm.text import Texts

    m = G.LanguageModel(("de", "en"), np.log(np.array([0.5, 0.5])), np.zeros((2, G.BUCKETS), np.float32))
    lang, score = m.predict(Texts(pa.array(["\U0001F600\U0001F680", "\U0001F600 12", "\U00020000", "\U00010400"])))
    assert lang == ["und", "und", "de", "de"] and score.tolist() == [0.0, 0.0, 0.5, 0.5]
    assert G._folding()[0x10400] == 0x10428


def test_score_depends_on_the_text_alone(spark):
    """Alone, first, last or behind megabytes of other text: the same score, and that of plain
    naive Bayes in double precision."""
    import numpy as np
    import pyarrow as pa

    from carryover.llm.langid import LanguageModel, fold, grams
    from carryover.llm.text import Texts
    r = np.random.default_rng(1)
    weights = np.log(r.dirichlet(np.ones(1 << 15), 3)).astype(np.float32)
    model = LanguageModel(("a", "b", "c"), np.log(np.array([0.2, 0.3, 0.5])), weights)
    texts = ["".join(r.choice(list("abcdefg hij"), n)) for n in (3, 40, 400, 4000)]
    long = "".join(r.choice(list("klmnop qrst"), 1 << 20))
    for t in texts:
        alone = model.predict(Texts(pa.array([t])))
        for order in ([t, long, long], [long, long, t], [long, t, long]):
            got = model.predict(Texts(pa.array(order)))
            assert got[1][order.index(t)] == alone[1][0] and got[0][order.index(t)] == alone[0][0]
        cp, off = fold(Texts(pa.array([t])))
        logs = model.prior.copy()
        for bucket, _ in grams(cp, off):
            logs += weights[:, bucket].astype(float).sum(axis=1)
        assert alone[1][0] == pytest.approx(1 / np.exp(logs - logs.max()).sum(), rel=1e-9) and alone[0][0] == "abc"[logs.argmax()]
