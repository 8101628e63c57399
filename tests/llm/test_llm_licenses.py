from llm_cases import EDGE, PROSE, edge

from carryover.llm import licenses as L

MIT = L.TEMPLATES[0][1]
TEMPLATE_BY = "This work is licensed under a Creative Commons Attribution 4.0 International License"
CASES = [
    (10, f"{PROSE} Released under the MIT License. {PROSE}"), (11, f"{PROSE}\n{MIT}\n{PROSE}"), (12, MIT.upper()),
    (13, MIT.replace("without limitation", "with no limitation at all").replace("free of charge,", "")),
    (14, "Licensed under CC BY-NC 4.0."), (15, "the Apache  License; an apache\nlicense, and MIT license. general public license"),
    (16, "free of charge to any person with no restriction to use"), (17, f"{MIT} {PROSE} {MIT}"),
]


def test_cases(spark):
    got = {r.doc_id: r for r in L.license_scan(edge(spark, CASES)).collect()}
    assert len(got) == len(CASES)
    assert {d: got[d].labels for d in got} == {10: "mit", 11: "mit", 12: "mit", 13: "mit", 14: "cc-by-nc", 15: "apache,gpl,mit", 16: "", 17: "mit"}
    assert got[16].score == 0 and got[14].score == 1 and 0.8 <= got[13].score < 1
    for d, t in CASES:
        n, hits = L.base_scan(t)
        r = got[d]
        assert (r.n_words, r.n_base) == (n, len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))


def test_every_template_against_every_other(spark):
    """Each grant alone, in prose and next to another has its own label and no other's."""
    from carryover.llm.licenses import TEMPLATES
    texts = [(i, t) for i, (_, t) in enumerate(TEMPLATES)] + [(100 + i, f"{PROSE} {t} {PROSE}") for i, (_, t) in enumerate(TEMPLATES)]
    pairs = [(1000 + 100 * i + j, f"{a}\n\n{PROSE}\n\n{b}") for i, (_, a) in enumerate(TEMPLATES) for j, (_, b) in enumerate(TEMPLATES) if i < j]
    df = spark.createDataFrame(texts + pairs, "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in L.license_scan(df).collect()}
    def own(i):
        return {TEMPLATES[i][0]} | {label for _, label in L.base_scan(TEMPLATES[i][1])[1]}
    for i in range(len(TEMPLATES)):
        assert got[i] == got[100 + i] == own(i), TEMPLATES[i]
    assert {d: got[d] for d, _ in pairs} == {1000 + 100 * i + j: own(i) | own(j) for i in range(len(TEMPLATES)) for j in range(i + 1, len(TEMPLATES))}


def test_words_in_between_tell_licenses_apart(spark):
    gpl = "it under the terms of the GNU General Public License as published by the Free Software Foundation"
    texts = [(1, gpl), (2, gpl.replace("General", "Lesser General")), (3, TEMPLATE_BY.replace("Attribution", "Attribution-NoComercial")),
             (4, TEMPLATE_BY.replace("International License", "International Public License"))]
    got = {r.doc_id: r.labels for r in L.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "gpl", 2: "gpl,lgpl", 3: "", 4: "cc-by"}


def test_edge_cases(spark):
    got = L.license_scan(edge(spark)).collect()
    assert len(got) == len(EDGE) and {r.labels for r in got} == {""} and {r.score for r in got} == {0.0}
    assert L.license_scan(edge(spark).limit(0)).count() == 0
