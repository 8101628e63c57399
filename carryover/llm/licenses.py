"""License scans by diagonal voting.

Every word k-gram of every text is looked up among the k-grams of the license templates; a
hit at text word p and template word t votes for diagonal p - t. Neighbouring diagonals are
merged into spans (edits shift a copy by a word or two). A span is verified: enough of the
template's words are covered, and at each place where a template of another license differs
from this one, the text reads like this one.
"""

from __future__ import annotations

import difflib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.llm.frames import LONG, STRING, arrow_map, chosen
from carryover.llm.text import LOWER, WORD_BYTES, Texts, windows
from carryover.session import settle

K = 3
#: Phrases of the base scan and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording by which public licenses are granted or named.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)


def _hashed(text: str) -> np.ndarray:
    t = Texts(pa.array([text]), lower=True)
    start, end, _ = t.words(WORD_BYTES)
    return t.word_hashes(start, end)


def _grams(texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(hash, template, position, words of the template) of every k-gram."""
    out = []
    for i, text in enumerate(texts):
        h = _hashed(text)
        g, at = windows(h, np.zeros(len(h), np.int64), K)
        out += [(int(v), i, int(p), len(h)) for v, p in zip(g.view(np.int64), at, strict=True)]
    return out


def _words(text: str) -> list[str]:
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.encode().translate(bytes(LOWER)).decode())


def _telling(templates: tuple[tuple[str, str], ...]) -> list[list[list[int]]]:
    """Per template, sets of k-gram positions of which one each has to be hit.

    Where a template of another license says the same with other words in between, a text that
    has those words covers most of both. So for each such place the template's k-grams across
    it that the other one lacks are a set: a text of the other license has none of them.
    """
    words = [_words(t) for _, t in templates]
    out: list[list[list[int]]] = []
    for i, (own, _) in enumerate(templates):
        mine, sets = words[i], set()
        for j, (other, _) in enumerate(templates):
            theirs = words[j]
            match = difflib.SequenceMatcher(None, mine, theirs, autojunk=False)
            ops = match.get_opcodes()
            same = [n for n, (tag, *_) in enumerate(ops) if tag == "equal"]
            if own == other or 2 * sum(ops[n][2] - ops[n][1] for n in same) < min(len(mine), len(theirs)):
                continue
            lacking = set(zip(*(mine[k:] for k in range(K)))) - set(zip(*(theirs[k:] for k in range(K))))
            for tag, a, e, _, _ in ops[same[0] + 1:same[-1]]:
                across = [p for p in range(max(0, a - K + 1), min(len(mine) - K + 1, max(e, a))) if tuple(mine[p:p + K]) in lacking and (e > a or p + K > a)]
                if tag != "equal" and across:
                    sets.add(tuple(across))
        out.append([list(s) for s in sorted(sets)])
    return out


def scan(docs: DataFrame, grams: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row: the base scan, and place and hash of every k-gram that some template has.
    The k-grams of the templates are few, so the semi-join with them runs where the text is."""
    known = np.unique(grams)
    sieve = np.zeros(1 << 16, bool)
    sieve[known.view(np.uint64) & np.uint64(0xFFFF)] = True
    phrases = [(_hashed(p), label) for p, label in PHRASES]

    def read(b: pa.RecordBatch) -> dict:
        t = Texts(b.column("text"), lower=True)
        start, end, doc = t.words(WORD_BYTES)
        h = t.word_hashes(start, end)
        n = np.bincount(doc, minlength=t.n)
        base = np.concatenate([[0], np.cumsum(n)])[:-1]
        places, labels = [np.zeros(0, np.int64)], [[] for _ in range(t.n)]
        for words, label in phrases:
            m = len(h) - len(words) + 1
            hit = np.ones(max(m, 0), bool)
            for j, w in enumerate(words):
                hit &= h[j:m + j] == w if m > 0 else False
            at = np.flatnonzero(hit)
            at = at[doc[at] == doc[at + len(words) - 1]]
            places.append(at)
            for d in np.unique(doc[at]):
                labels[d].append(label)
        at = np.sort(np.concatenate(places))
        word, d = at - base[doc[at]], doc[at]
        bounds = np.searchsorted(d, np.arange(t.n + 1))
        found = np.diff(bounds) > 0
        first, last = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
        first[found], last[found] = word[bounds[:-1][found]], word[bounds[1:][found] - 1]
        g, pos = windows(h, doc, K)
        maybe = np.flatnonzero(sieve[g & np.uint64(0xFFFF)])
        g, pos = g[maybe].view(np.int64), pos[maybe]
        real = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
        g, pos = g[real], pos[real]
        cut = np.searchsorted(doc[pos], np.arange(t.n + 1)).astype(np.int32)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(cut), pa.array(v, pa.int64()))
        return {"n_words": n, "n_base": np.diff(bounds), "first_word": pa.array(first, mask=~found), "last_word": pa.array(last, mask=~found),
                "base_labels": [",".join(sorted(x)) for x in labels], "at": lists(pos - base[doc[pos]] if len(pos) else pos), "gram": lists(g)}

    many = T.ArrayType(LONG)
    out = {"n_words": LONG, "n_base": LONG, "first_word": LONG, "last_word": LONG, "base_labels": STRING, "at": many, "gram": many}
    key = chosen(docs, _id=id_col, text=text_col).withColumn("_row", F.monotonically_increasing_id())
    return arrow_map(key, read, out, ["_id", "_row"])


def license_spans(found: DataFrame, grams: list[tuple[int, int, int, int]], telling: list[list[list[int]]], slack: int = 3, cover: float = 0.8) -> DataFrame:
    """Spans (_row, template, first and last word, coverage) from the hits of ``scan``.
    The hits of one text meet a template's positions in a join, vote per diagonal, and
    diagonals at most ``slack`` apart are one span. It needs a hit in each of the template's
    ``telling`` sets."""
    spark = found.sparkSession
    table = spark.createDataFrame(grams, "gram long, template int, tpos int, size int")
    hits = found.select("_row", F.explode(F.arrays_zip("at", "gram")).alias("h")).select("_row", "h.at", "h.gram")
    votes = (hits.join(F.broadcast(table), "gram")  # templates are constants of this module
             .groupBy("_row", "template", "size", (F.col("at") - F.col("tpos")).alias("diagonal"))
             .agg(F.collect_set("tpos").alias("tpos"), F.min("at").alias("first"), F.max("at").alias("last")))
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    jump = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= slack, 0).otherwise(1)
    merged = (votes.withColumn("jump", jump).withColumn("span", F.sum("jump").over(along))
              .groupBy("_row", "template", "size", "span")
              .agg(F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last")))
    words = F.array_distinct(F.flatten(F.transform("tpos", lambda p: F.sequence(p, p + K - 1))))
    needs = F.array(*[F.array(*[F.array(*[F.lit(p) for p in n]) for n in sets]).cast("array<array<int>>") for sets in telling])
    return (merged.withColumn("coverage", F.size(words) / F.col("size"))
            .filter(F.forall(F.element_at(needs, F.col("template") + 1), lambda n: F.arrays_overlap(n, "tpos")))
            .filter((F.col("coverage") >= cover) & (F.col("last") - F.col("first") < 2 * F.col("size") + slack))
            .select("_row", "template", "first", "last", "coverage"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: tuple[tuple[str, str], ...] = TEMPLATES, cover: float = 0.8) -> DataFrame:
    """One row per input row: ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels`` and ``score`` (best coverage of a template, 1 for a phrase).

    Null and empty texts have no words, empty labels and score 0. A null id stays null,
    repeated rows give repeated results, an empty table gives an empty one, and columns
    other than the two named are not looked at. Several spans of one license are one label.
    """
    grams = _grams([t for _, t in templates])
    found = settle(scan(docs, np.array([g[0] for g in grams], np.int64), id_col, text_col), "licenses")
    spans = license_spans(found, grams, _telling(templates), cover=cover)
    named = F.element_at(F.array(*[F.lit(x) for x, _ in templates]), F.col("template") + 1)
    best = spans.groupBy("_row").agg(F.collect_set(named).alias("more"), F.max("coverage").alias("best"))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    every = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    return found.join(best, "_row", "left").select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def base_scan(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """The base rule in plain Python, for tests."""
    words = _words(text or "")
    hits = [(i, label) for p, label in PHRASES for k in [p.split()] for i in range(len(words)) if words[i:i + len(k)] == k]
    return len(words), sorted(hits)
