"""License scans: an exact set-similarity join of text blocks with license templates.

A block of a template of m words is any m consecutive words of a text (the whole text, if it
has fewer). It matches if it holds at least ``threshold`` of the template's distinct tokens
(containment). All matching blocks are found, by these filters:

* tokens are ordered by their frequency in the whole corpus, rarest first (a grouped count
  over all texts);
* prefix: of a template with k tokens, of which a block must hold r, a block has one of the
  k - r + 1 rarest, so only blocks around these are looked at;
* position: if the rarest one that a block holds stands at place i of the order, it can hold k - i at most;
  what is needed must also occur among the words that reach a block around it;
* length: texts with fewer than r words of the template can't match.

The blocks left are counted exactly by a sliding sum. Blocks of one template that overlap or touch
become one span with the containment of the best of them.

Phrases are plain: a label whose words stand consecutively. Letters A-Z count as small ones,
words are runs of ASCII letters, digits and any other character beyond ASCII.

Templates go to all tasks as one table, so they are few: more than ``MOST_TOKENS`` words in
all raise an error. Defined results: a NULL text is empty and has no words, phrases or
blocks; texts are read whole; templates without words are left out; repeated rows are rows of their own; an empty
table gives an empty result; other columns stay, and those named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import nested, unnested

#: A word, in texts whose letters A-Z are small.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

THRESHOLD = 0.8
#: Words of all templates together, at most.
MOST_TOKENS = 1_000_000

# The phrases of the base and the opening words of well-known notices.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    ("mit-notice", "Released under the MIT License."),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORD = re.compile(WORD)
_SMALL = str.maketrans(UPPER, LOWER)

_PLACES = T.ArrayType(T.StructType().add("label", "string").add("at", "long"))
_SPANS = T.ArrayType(
    T.StructType().add("label", "string").add("start", "long").add("end", "long").add("containment", "double")
)
FOUND = T.StructType().add("n_words", "long").add("places", _PLACES).add("spans", _SPANS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_SMALL))


def needed(tokens: int, threshold: float) -> int:
    """The least whole number of tokens that makes the containment."""
    n = max(1, int(tokens * threshold))
    return n if n >= tokens * threshold else n + 1


def token_counts(docs: DataFrame, text: str, templates: Sequence[tuple[str, str]]) -> dict[str, int]:
    """How often each token of the templates occurs in all texts."""
    vocabulary = {w for _, t in templates for w in words_of(t)}
    if not vocabulary:
        return {}
    own = docs.sparkSession.createDataFrame([(w,) for w in sorted(vocabulary)], "word string")
    small = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    words = docs.select(F.explode(F.regexp_extract_all(small, F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.join(F.broadcast(own), "word").groupBy("word").count()  # a row per token of the templates
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counted.collect()}


class Index:
    """Templates by their rarest tokens."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], counts: dict[str, int], threshold: float):
        self.numbers: dict[str, int] = {}
        number = lambda w: self.numbers.setdefault(w, len(self.numbers))
        ranked = sorted({w for _, t in templates for w in words_of(t)}, key=lambda w: (counts.get(w, 0), w))
        for w in ranked:
            number(w)
        self.templates = []
        #: token -> (template, place in the template's order)
        self.prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for label, text in templates:
            words = words_of(text)
            if not words:
                continue
            order = sorted({number(w) for w in words})
            need = needed(len(order), threshold)
            for i, token in enumerate(order[: len(order) - need + 1]):
                self.prefixes[token].append((len(self.templates), i))
            self.templates.append((label, len(words), np.array(order), need))
        self.phrases = [(label, [number(w) for w in words_of(p)]) for label, p in phrases if words_of(p)]

    def ids(self, words: list[str]) -> np.ndarray:
        """Token numbers; -1 for words of no template or phrase."""
        get = self.numbers.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        found = []
        for label, phrase in self.phrases:
            k = len(phrase)
            at = np.flatnonzero(ids[: max(0, len(ids) - k + 1)] == phrase[0])
            for i in range(1, k):
                at = at[ids[at + i] == phrase[i]]
            found.extend((int(i), label) for i in at)
        return sorted(found)

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(start, end, label, containment) of what matching blocks cover, end exclusive."""
        known = np.flatnonzero(ids >= 0)
        own = ids[known]
        if len(known) < min((need for *_, need in self.templates), default=1):
            return []
        around: dict[int, list[np.ndarray]] = defaultdict(list)
        for token in set(own.tolist()) & self.prefixes.keys():
            at = known[own == token]
            for template, place in self.prefixes[token]:
                _, m, order, need = self.templates[template]
                # Words from this place of the order on, within reach of a block around it.
                later = known[np.isin(own, order[place:])]
                reach = np.searchsorted(later, at + m) - np.searchsorted(later, at - m, "right")
                around[template].append(at[reach >= need])
        found = []
        for template, places in around.items():
            label, m, order, need = self.templates[template]
            at = np.sort(np.concatenate(places))
            if not len(at):
                continue
            # Stretches of words within reach of a block around a prefix token, each counted once.
            cut = np.flatnonzero(np.diff(at) >= 2 * m)
            first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
            for a, b in zip(at[first].tolist(), at[last].tolist()):
                lo, hi = max(0, a - m + 1), min(len(ids), b + m)
                found.extend((lo + s, lo + e, label, c) for s, e, c in self._blocks(ids[lo:hi], m, order, need))
        return sorted(found)

    @staticmethod
    def _blocks(ids: np.ndarray, m: int, order: np.ndarray, need: int) -> list[tuple[int, int, float]]:
        """Spans of the blocks of m words in a stretch that hold ``need`` different tokens."""
        n = len(ids)
        blocks = max(1, n - m + 1)
        width = min(m, n)
        held = np.zeros(blocks, dtype=np.int64)
        # A token counts in the blocks from the end of its last occurrence's reach to its own place.
        for token in order:
            at = np.flatnonzero(ids == token)
            if not len(at):
                continue
            begin = np.maximum(at - width + 1, np.append(0, at[:-1] + 1))
            begin, end = np.minimum(begin, blocks), np.minimum(at, blocks - 1) + 1
            step = np.zeros(blocks + 1, dtype=np.int64)
            np.add.at(step, begin[begin < end], 1)
            np.add.at(step, end[begin < end], -1)
            held += np.cumsum(step[:-1])
        good = np.flatnonzero(held >= need)
        if not len(good):
            return []
        cut = np.flatnonzero(np.diff(good) > width)
        first, last = np.append(0, cut + 1), np.append(cut, len(good) - 1)
        return [
            (int(good[i]), int(good[j]) + width, float(held[good[i : j + 1]].max() / len(order))) for i, j in zip(first, last)
        ]


def scan(
    docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with n_words, license_places(label, at) and license_spans(label, start, end, containment), all in words."""
    if sum(len(words_of(t)) for _, t in [*templates, *phrases]) > MOST_TOKENS:
        raise ValueError(f"templates of more than {MOST_TOKENS} words")
    index = Index(templates, phrases, token_counts(docs, text, templates), threshold)

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t)
                ids = index.ids(words)
                places = [{"label": label, "at": i} for i, label in index.places(ids)]
                spans = [{"label": w, "start": s, "end": e, "containment": c} for s, e, w, c in index.spans(ids)]
                rows.append((len(words), places, spans))
            yield pd.DataFrame(rows, columns=FOUND.names)

    met = nested(docs).withColumn("_found", found(F.col("_row").getField(text)))
    added = {"n_words": "n_words", "license_places": "places", "license_spans": "spans"}
    return unnested(met, docs.columns, **{c: F.col(f"_found.{f}") for c, f in added.items()})
