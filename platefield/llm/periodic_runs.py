"""Runs of repeated words: sparse diagonal matching over the words of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) that spans at least ``max(LEAST, TURNS * q)`` words and that no neighbouring word
extends. On the diagonal of lag q, which compares each word with the one q before it, a run
is a stretch of at least 3 q matches.

Words are read in order and each looks up its earlier occurrences; an occurrence q words
back adds one to the match length of the active lag q, and a lag that fails to match ends and, if
it is long enough, emits its run. Taken literally this costs the square of a word's
occurrences, so lags advance in strides: lags B to 2B-1 (B a power of two) move by aligned blocks
of B words, whose occurrences are found by fingerprints. A run of such a lag covers two aligned
blocks at least, so none is lost; a lag with one block only is dropped, and where a lag ends it
is settled word by word on either side. All lags of a text of n words cost n log n steps,
also for a text that repeats one word.

A lag whose stretch lies in a run of a smaller period is a multiple of that period
(two periods of one stretch have their greatest common divisor as a period too), so it
isn't a run of its own.

Defined results: a NULL or empty text has no words and no runs, its collapsed text is
empty; texts are read whole, each in one task (words of very long texts are compared in slices); repeated rows
are rows of their own; an empty table gives an empty result; other columns stay, and those
named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, nested, unnested

#: Least words of a run, and least length as a multiple of its period.
LEAST, TURNS = 6, 4
#: Words whose lags are matched together, and comparisons made at once.
WORDS_AT_ONCE, SLICE = 1 << 17, 1 << 21

FOUND = T.StructType().add(
    "runs", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))
).add("collapsed", "string")

_WORD = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def _block_matches(prints: np.ndarray, anchors: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, lag) of each block that equals one ``lag`` words before, for lags block..2*block-1."""
    windows = np.lib.stride_tricks.sliding_window_view(prints, block)
    at, lags = [], []
    step = max(1, SLICE // block)
    for i in range(0, len(anchors), step):
        some = anchors[i : i + step]
        row, col = np.nonzero(windows[some - 2 * block + 1] == prints[some, None])
        at.append(some[row])
        lags.append(2 * block - 1 - col)
    return np.concatenate(at), np.concatenate(lags)


def _ends(words: np.ndarray, first: int, last: int, lag: int) -> tuple[int, int]:
    """The matching stretch of a lag around words first..last, which match; blocks beyond them don't."""
    reach = min(lag, first - lag)
    differ = np.flatnonzero(words[first - reach : first] != words[first - reach - lag : first - lag])
    left = first - reach + (differ[-1] + 1 if len(differ) else 0)
    ahead = words[last + 1 : last + 1 + lag]
    differ = np.flatnonzero(ahead != words[last + 1 - lag : last + 1 - lag + len(ahead)])
    return left, last + (differ[0] if len(differ) else len(ahead))


def find_runs(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start and period, in texts that begin at ``starts``.

    ``words`` are word numbers; between two texts stands a number that occurs once.
    """
    n = len(words)
    lengths = np.diff(np.append(starts, n))
    longest = int(lengths.max(initial=0))
    prints = _mixed(words.astype(np.uint64) * _ODD[0])
    runs: list[tuple[int, int, int]] = []
    block = 1
    while TURNS * block <= longest:
        # From 2 * block on all lags are there; a run at the very beginning still holds two blocks behind that.
        anchors = np.arange(2 * block, n - block + 1, block)
        text = np.searchsorted(starts, anchors, "right") - 1
        anchors = anchors[lengths[text] >= TURNS * block]
        if len(anchors):
            at, lags = _block_matches(prints, anchors, block)
            order = np.lexsort((at, lags))
            at, lags = at[order], lags[order]
            goes_on = (np.diff(lags) == 0) & (np.diff(at) == block)
            first = np.flatnonzero(np.append(True, ~goes_on)) if len(at) else at
            last = np.flatnonzero(np.append(~goes_on, True)) if len(at) else at
            long = last > first
            lag, lo, hi = lags[first[long]], at[first[long]], at[last[long]] + block - 1
            if len(lag) and runs:
                known = np.array(sorted(runs))
                reach = np.maximum.accumulate(known[:, 0] + known[:, 1] - 1)
                near = np.searchsorted(known[:, 0], lo - lag, "right") - 1
                own = (near < 0) | (reach[np.maximum(near, 0)] < hi)
                lag, lo, hi = lag[own], lo[own], hi[own]
            for q, a, b in zip(lag.tolist(), lo.tolist(), hi.tolist()):
                left, right = _ends(words, a, b, q)
                length = right - left + 1 + q
                if length >= max(LEAST, TURNS * q):
                    runs.append((left - q, length, q))
        if n < 2 * block:
            break
        prints = _mixed(prints[:-block] * _ODD[0] + (prints[block:] ^ _ODD[1]))
        block *= 2
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(kept)])


def _search(texts: list[list[str]]) -> Iterator[tuple[list[dict], str]]:
    numbers: dict[str, int] = {}
    ids: list[int] = []
    starts = []
    mark = -1
    for words in texts:
        starts.append(len(ids))
        ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
        ids.append(mark)
        mark -= 1
    found = find_runs(np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64))
    cuts = np.searchsorted(found[:, 0], np.append(starts, len(ids)))
    for i, words in enumerate(texts):
        own = [(int(s) - starts[i], int(n), int(q)) for s, n, q in found[cuts[i] : cuts[i + 1]]]
        yield [{"start": s, "length": n, "period": q} for s, n, q in own], _collapsed(words, own)


@F.pandas_udf(FOUND)
def _found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        done: list[tuple[list[dict], str]] = []
        some: list[list[str]] = []
        size = 0
        for text in texts:
            some.append(_WORD.findall(text or ""))
            size += len(some[-1])
            if size >= WORDS_AT_ONCE:
                done.extend(_search(some))
                some, size = [], 0
        done.extend(_search(some))
        yield pd.DataFrame(done, columns=["runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start and length in words, period), by start and period, and ``collapsed``.

    ``collapsed`` has the words, joined by one space, that don't stand in a run after its first period.
    """
    met = nested(docs).withColumn("_found", _found(F.col("_row").getField(text)))
    return unnested(met, docs.columns, runs=F.col("_found.runs"), collapsed=F.col("_found.collapsed"))


def repeated_tail(words: Column, h: Column) -> Column:
    """``words`` with a periodic tail where ``h``, an unsigned crc32, ends in 0; a planted fixture.

    With g = floor(h / 10), word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # Whole numbers, so that they may count and name places of an array.
    a, p = a.cast("int"), p.cast("int")
    tail = F.transform(F.sequence(a, F.size(words) - 1), lambda i: F.get(words, a + (i - a) % p))
    return F.when((h % 10 == 0) & (n > 0), F.concat(F.slice(words, F.lit(1), a), tail)).otherwise(words)
