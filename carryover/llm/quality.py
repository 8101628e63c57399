"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote
patterns (at most 3 ** rules, whatever the corpus) estimates how often each rule is right
and how common good documents are; a document's posterior probability decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.llm.frames import BOOL, DOUBLE, LONG, arrow_map, chosen
from carryover.llm.text import NOT_SPACE, Texts, mix, windows
from carryover.session import settle

def _set(chars: str | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return out


SYMBOLS = _set("#*$%&|<>")
MARKS = _set("#*$%&|<>!@=+/^~_{}[]`" + chr(92))
STOPS = _set(".?")
NOT_NEWLINE = ~_set("\n")
UPPER = _set([*range(0x41, 0x5B)])
LETTER = _set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0xF5)])


def _share(m: dict, part: str, whole: str = "n_words") -> np.ndarray:
    return m[part] / np.maximum(m[whole], 1)


def _vote(bad: np.ndarray, good: np.ndarray | None = None) -> np.ndarray:
    """2 where bad, else 1 where good, else 0 (abstains)."""
    return np.where(bad, 2, 0 if good is None else np.where(good, 1, 0))


#: Each rule votes on a text from its counts. Rules about one defect abstain where it is absent:
#: that a text has no repeated lines says nothing of its symbols.
RULES = (
    ("clean_words", lambda m: _vote(_share(m, "n_clean") < 0.75, _share(m, "n_clean") >= 0.9)),
    ("sentences", lambda m: _vote((m["n_words"] >= 40) & (_share(m, "n_stops") < 0.005), (_share(m, "n_stops") >= 0.02) & (_share(m, "n_stops") <= 0.5))),
    ("length", lambda m: _vote(m["n_words"] < 10, m["n_words"] >= 20)),
    ("word_length", lambda m: _vote((_share(m, "word_chars") > 15) | (_share(m, "word_chars") < 2), (_share(m, "word_chars") <= 11) & (_share(m, "word_chars") >= 3))),
    ("symbols", lambda m: _vote(_share(m, "n_symbols") > 0.2)),
    ("upper_case", lambda m: _vote(_share(m, "n_upper", "n_letters") > 0.5)),
    ("exclamations", lambda m: _vote(_share(m, "n_exclaim") > 0.3)),
    ("few_letters", lambda m: _vote(_share(m, "n_letters", "word_chars") < 0.5)),
    ("repeated_lines", lambda m: _vote((m["n_lines"] >= 4) & (_share(m, "n_dup_lines", "n_lines") > 0.3))),
    ("repeated_words", lambda m: _vote(_share(m, "n_repeat_words") > 0.2)),
    ("few_kinds", lambda m: _vote((m["n_words"] >= 20) & (_share(m, "n_kinds") < 0.1))),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(t: Texts) -> dict[str, np.ndarray]:
    """Counts of each text of a piece."""
    start, end, doc = t.words()
    n = np.bincount(doc, minlength=t.n)
    h = t.word_hashes(start, end)
    letter, chars = LETTER[t.buf], t.code_points()
    letters, marks, worded = t.running(letter), t.running(MARKS[t.buf]), t.running(NOT_SPACE[t.buf])
    clean = (letters[end] > letters[start]) & (marks[end] == marks[start])
    line_start, line_end, line_doc = t.words(NOT_NEWLINE)
    has = worded[line_end] > worded[line_start]
    line_start, line_end, line_doc = line_start[has], line_end[has], line_doc[has]
    w, at = windows(h, doc, 5)
    again = _repeated(mix(w ^ mix(doc[at].astype(np.uint64))))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + 5, -1)
    return {
        "n_words": n, "word_chars": np.bincount(doc, chars[end] - chars[start], t.n).astype(np.int64), "n_symbols": t.count(SYMBOLS[t.buf]),
        "n_lines": np.bincount(line_doc, minlength=t.n), "n_dup_lines": _copies(t.word_hashes(line_start, line_end), line_doc, t.n),
        "n_repeat_words": np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=t.n), "n_kinds": n - _copies(h, doc, t.n),
        "n_clean": np.bincount(doc[clean], minlength=t.n), "n_stops": np.bincount(doc[STOPS[t.buf[end - 1]]], minlength=t.n),
        "n_upper": t.count(UPPER[t.buf]), "n_letters": t.count(letter), "n_exclaim": t.count(t.buf == 0x21),
    }


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _copies(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text, how many hashes equal an earlier one of the text."""
    order = np.argsort(mix(h ^ mix(doc.astype(np.uint64))))
    hs, ds = h[order], doc[order]
    same = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
    return np.bincount(ds[1:][same], minlength=n)


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """The pattern of votes as one number: base 3, digit 0 abstain, 1 good, 2 bad."""
    code = np.zeros(len(m["n_words"]), np.int64)
    for _, rule in RULES:
        code = code * 3 + rule(m)
    return code


@dataclass(frozen=True)
class QualityModel:
    """``good`` is the prior; ``rates`` has, for each rule, P(says bad) on bad and on good
    documents and P(says good) on good and on bad ones."""

    good: float
    rates: tuple[tuple[float, float, float, float], ...]

    def posterior(self, code: np.ndarray) -> np.ndarray:
        """P(good) of a vote pattern."""
        return _posterior(_digits(code), self.good, np.array(self.rates))


#: First guess of the rates and of the share of good documents, and how many imagined documents
#: of either kind stand for it.
GUESS, GUESSED_GOOD, IMAGINED = (0.5, 0.005, 0.9, 0.5), 0.8, 10
TINY = 1e-6


def _digits(code: np.ndarray) -> np.ndarray:
    k = len(RULES)
    return np.stack([code // 3 ** (k - 1 - j) % 3 for j in range(k)], 1)


def _posterior(d: np.ndarray, good: float, rates: np.ndarray) -> np.ndarray:
    odds = np.log(good / (1 - good)) + ((d == 1) * np.log(rates[:, 2] / rates[:, 3]) - (d == 2) * np.log(rates[:, 0] / rates[:, 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit_patterns(code: np.ndarray, count: np.ndarray, rounds: int = 1000) -> QualityModel:
    """Expectation-maximisation over vote patterns; an abstention carries no weight.

    Rates and the share of good documents are free. ``IMAGINED`` documents of either kind stand
    for the first guess, which is all that is left on an empty table. The two kinds have no names
    of their own: the one in which rules say bad more often is the bad one.
    """
    d, good = _digits(code), GUESSED_GOOD
    first = np.tile(GUESS, (len(RULES), 1))
    rates = first
    for _ in range(rounds):
        p = _posterior(d, good, rates)
        w, v = count * p, count * (1 - p)
        new = np.stack([v @ (d == 2), w @ (d == 2), w @ (d == 1), v @ (d == 1)], 1) + IMAGINED * first
        new = np.clip(new / (np.array([v.sum(), w.sum(), w.sum(), v.sum()]) + IMAGINED), TINY, 1 - TINY)
        good = float(np.clip((w.sum() + IMAGINED * GUESSED_GOOD) / (count.sum() + IMAGINED), TINY, 1 - TINY))
        done, rates = np.abs(new - rates).max() < 1e-9, new
        if done:
            break
    if rates[:, 0].sum() < rates[:, 1].sum():
        good, rates = 1 - good, rates[:, [1, 0, 3, 2]]
    return QualityModel(good, tuple(tuple(map(float, r)) for r in rates))


def fit_quality(docs: DataFrame, text_col: str = "text") -> QualityModel:
    """Estimate the rules' accuracies over all documents (one pass; only the counts of vote
    patterns, at most 3 ** len(RULES) rows, reach the driver)."""
    seen = arrow_map(chosen(docs, text=text_col), lambda b: {"code": votes(measure(Texts(b.column("text"))))}, {"code": LONG})
    return _fit(seen)[0]


def _failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``kept`` and ``quality`` (posterior).

    A null or empty text has no words and fails the base rules. A null id is kept as null,
    repeated rows give repeated results, an empty table gives an empty one, and columns
    other than the two named are not looked at. Ties at the threshold are kept.
    """
    def read(b: pa.RecordBatch) -> dict:
        m = measure(Texts(b.column("text")))
        return {k: m[k] for k in COUNTS} | {"base_failed": _failed(m), "code": votes(m)}

    out = dict.fromkeys(COUNTS, LONG) | {"base_failed": BOOL, "code": LONG}
    seen = settle(arrow_map(chosen(docs, _id=id_col, text=text_col), read, out, ["_id"]), "quality")
    model, codes = _fit(seen)
    table = docs.sparkSession.createDataFrame(
        list(zip(codes.tolist(), model.posterior(codes).tolist(), strict=True)), "code long, quality double")
    # at most 3 ** rules patterns exist, however large the corpus
    return (seen.join(F.broadcast(table), "code")
            .select(F.col("_id").alias(id_col), *COUNTS, "base_failed",
                    (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality"))


def _fit(seen: DataFrame) -> tuple[QualityModel, np.ndarray]:
    rows = seen.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes = np.array([r.code for r in rows], np.int64)
    return fit_patterns(codes, np.array([r.n for r in rows], np.int64)), codes


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and nothing else."""
    model = fit_quality(docs, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]

    def pick(b: pa.RecordBatch) -> dict:
        m = measure(Texts(b.column(text)))
        return {"_rows": np.flatnonzero(~_failed(m) & (model.posterior(votes(m)) >= threshold))}

    return arrow_map(plain, pick, {}, names, text).toDF(*docs.columns)
