"""URL filters: host and path rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.llm.frames import DOUBLE, arrow_map, chosen
from carryover.llm.text import LOWER, Texts, mix

BUCKETS = 1 << 16
ORDERS = (3, 4, 5)
MAX_LABELLED = 20_000
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A small labelled table of made-up urls: 1 is to be blocked. In the first part both kinds have
#: the same domains and paths, in the second both have the same hosts, and names in the path tell them apart.
UNWANTED = ("casino-royal", "online-casino", "win-casino", "free-poker", "best-bets", "sports-bets", "spam-site", "link-farm", "seo-spam", "ads-server", "ads-click", "ad-tracker",
            "click-ads", "poker-bonus", "free-slots", "discount-pills", "adult-cams", "xxx-videos", "lottery-win", "payday-loans")
WANTED = ("library", "gardening", "news", "weather", "python-docs", "museum", "university", "science", "cooking", "history", "health", "music-forum", "travel", "chess-wiki",
          "theatre", "another-thing", "nature", "station", "archive", "railway")
LABELLED = tuple((f"https://{front}{name}.example.{domain}/{path}", label) for names, label in ((UNWANTED, 1), (WANTED, 0)) for name in names
                 for front, domain, path in (("", "com", "en/1042"), ("www.", "net", "fr/88.html"), ("m.", "org", "de/2020/?page=2"), ("blog.", "com", "")))
LABELLED += tuple((f"https://{host}/{front}{name}{back}", label) for names, label in ((UNWANTED, 1), (WANTED, 0)) for name in names
                  for host, front, back in (("www.example.com", "", "/index"), ("example.net", "en/", "/1042"), ("pages.example.org", "a/", ".html")))


def host_of(url: Column) -> Column:
    """Host in lower case; empty for null or if there is no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER_CASE, LOWER_CASE)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, both null if none does. ``rules`` are
    (verdict, host/path) and written in code, so they are a chain of conditions."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: np.ndarray

    def probability(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """P(block) of each url."""
        z = np.full(len(host), self.bias)
        for row, bucket in _features(host, path):
            z += np.bincount(row, self.weights[bucket], len(host))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _features(host: pa.Array, path: pa.Array):
    """(row, bucket) of every character n-gram of host and path; digits count as one character."""
    digit = LOWER.copy()
    digit[0x30:0x3A] = 0x30
    for salt, part in ((1, host), (2, path)):
        t = Texts(part)
        b, doc = digit[t.buf].astype(np.uint64), np.repeat(np.arange(t.n), np.diff(t.off))
        for k in ORDERS:
            m = max(len(b) - k + 1, 0)
            key = np.full(m, salt * 8 + k, np.uint64)
            for j in range(k):
                key = key * np.uint64(257) + b[j:m + j]
            at = np.flatnonzero(doc[:m] == doc[k - 1:]) if m else np.zeros(0, np.int64)
            yield doc[at], (mix(key[at]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def fit_urls(host: list[str], path: list[str], label: list[int], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> UrlModel:
    """Gradient descent over a small table (at most ``MAX_LABELLED`` rows)."""
    if len(label) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    y, w, bias = np.array(label, float), np.zeros(BUCKETS), 0.0
    n = max(len(y), 1)
    parts = list(_features(pa.array(host, pa.string()), pa.array(path, pa.string())))
    row, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    for _ in range(rounds):
        z = bias + np.bincount(row, w[bucket], len(y))
        g = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(bucket, g[row], BUCKETS) / n + ridge * w)
        bias -= rate * g.sum() / n
    return UrlModel(float(bias), w)


def train_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> UrlModel:
    """Fit on a labelled table of at most ``MAX_LABELLED`` rows; rows without a label are left
    out, a larger table is an error rather than a sample."""
    rows = (labelled.filter(F.col(label_col).isNotNull())
            .select(host_of(F.col(url_col)).alias("h"), path_of(F.col(url_col)).alias("p"), F.col(label_col).cast("int").alias("y"))
            .limit(MAX_LABELLED + 1).collect())
    return fit_urls([r.h for r in rows], [r.p for r in rows], [r.y for r in rows])


def url_filter(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``host``, ``path``, ``rule``, ``verdict`` and ``p_block``.

    The model blocks what is at least ``threshold`` likely to be unwanted. Null urls and urls without ``://`` have empty host and path and are judged by the model's
    bias. Of rules that fit, the longest text wins. A null id stays null, repeated rows give
    repeated results, other columns are not looked at.
    """
    own = chosen(pages, _id=id_col, url=url_col).select("_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = arrow_map(own, lambda b: {"p_block": model.probability(b.column("host"), b.column("path"))}, {"p_block": DOUBLE}, ["_id", "host", "path"], "path")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
