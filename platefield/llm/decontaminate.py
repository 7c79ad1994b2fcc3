"""Benchmark decontamination: CGK walks and bit-sampling LSH over words, verified by exact edit distance.

A document is contaminated by an item if one of its windows, which are as long as the
item give or take the allowed edits, is within ``1 - similarity`` times the item's words
of it in edit distance. Words are compared in lower case and without punctuation.

1. A CGK walk reads a word per step and goes on to the next one if a random bit of word and step says so. Walks
   of an item and of an edited copy that share their bits fall out of step at an edit and soon into step again, so
   the edit distance becomes a Hamming distance of the words read.
2. Bit sampling: a repetition compares ``SAMPLES`` steps spread over the whole walk, forward from a window's start or
   backward from its end; windows and items that agree there share a bucket. All windows walk that can hold a match:
   those around a run of words that is a piece of some item (see 5) in a stretch with enough of its words.
3. Per class of lengths, repetitions are added until copies with the most edits allowed, at the head, in the middle, at
   the tail or spread, are met with a share of ``RECALL`` (tried on ``TRIED`` items of the class), up to ``MOST_REPEATS``.
4. Every pair that meets is judged exactly, first by how many of its words the item has at all
   (n - k at least), then by edit distance.
5. What sampling misses is found by an exact backstop: an item of n words with k edits allowed, cut into k + 1 pieces,
   has a piece without an edit, and the window starts within k words of where that piece puts it. Each run of words that is a
   piece names item and stretch, which are judged alike. So no pair is lost, wherever its edits lie.

The benchmark is broadcast in blocks of bounded size; each block is one pass over the
documents, without a shuffle. Each document is handled whole, by itself.

Defined results: NULL or empty texts and items match nothing; repeated rows are rows of
their own; items of few words allow no edit and must occur as they are; of an item's windows
in a document that of the fewest edits is given, of these the first, and of these the
shortest; without documents or items nothing is contaminated; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8
#: Words of the items of one block, which is what one broadcast holds.
BLOCK_WORDS = 500_000
PIECE = 4
#: Pairs of a piece and an item that are judged at once, and cells of a table of edits.
SEEDS, CELLS = 1 << 20, 1 << 22
#: Characters that a word may have around it and that don't count.
PUNCTUATION = string.punctuation + "«»‹›„“”‘’‚…–—¡¿·•"
LOST = 0  # words that no item has
#: Steps compared by a repetition, the share of edited copies to be met, repetitions at most, and items tried per class.
SAMPLES, RECALL, MOST_REPEATS, TRIED = 3, 0.95, 64, 64
#: Items of one class have lengths within this ratio. Windows that walk at once.
CLASS, WALKERS = 1.25, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(word: str) -> str:
    return word.strip(PUNCTUATION).lower()


def edits_allowed(words: int, similarity: float = SIMILARITY) -> int:
    return int(words * (1 - similarity) + 1e-9)


def scramble(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of each value."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Item word number of a word as written: LOST if no item has it, -1 if it is punctuation only."""

    def __init__(self, known: dict[str, int], limit: int = 1 << 20):
        super().__init__()
        self.known, self.limit = known, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        p = plain(word)
        found = self.known.get(p, LOST) if p else -1
        self[word] = found
        return found


def walk(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, steps: np.ndarray, seed: int, forward: bool) -> np.ndarray:
    """A key per walk: the words that walks from ``at`` read at ``steps``; outside ``low`` to ``high`` they read nothing."""
    at = at.copy()
    key = np.full(len(at), seed, np.uint64)
    numbers = scramble(np.arange(1, steps[-1] + 2, dtype=np.uint64) * MIX + np.full(1, seed, np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    turn = 1 if forward else -1
    for step in range(steps[-1] + 1):
        word = np.where((at >= low) & (at < high), words[np.clip(at, 0, len(words) - 1)], -2).astype(np.uint64)
        if step in steps:
            key = (key + word) * MIX
        # Multiplicative hashing: the bit is shared by all walks that read the word at this step.
        at += turn * (((word + np.uint64(3)) * MIX * numbers[step]) >> np.uint64(63)).astype(np.int64)
    return scramble(key)


def edited(item: np.ndarray, edits: int, place: str, rng: np.random.Generator) -> np.ndarray:
    """A copy of ``item`` with as many words replaced, left out or put in; -3 stands for strange words."""
    n = len(item)
    start = {"head": 0, "middle": max(0, (n - edits) // 2), "tail": max(0, n - edits)}.get(place)
    chosen = set((rng.choice(n, edits, replace=False) if start is None else range(start, min(n, start + edits)))) if edits else set()
    out: list[int] = []
    for i, word in enumerate(item.tolist()):
        kind = rng.integers(3) if i in chosen else -1
        out += [word] if kind < 0 else [-3] if kind == 0 else [] if kind == 1 else [-3, word]
    return np.array(out, np.int64)


class Buckets:
    """The items of one class of lengths, by the keys of their walks."""

    def __init__(self, bench: Benchmark, numbers: list[int]):
        self.numbers = np.array(numbers)
        items = [bench.items[i] for i in numbers]
        self.sizes = np.array([len(x) for x in items])
        allowed = [edits_allowed(len(x), bench.similarity) for x in items]
        self.reach = max(allowed)
        rng = np.random.default_rng(len(items[0]) * 1_000_003 + len(items))
        tried = [(j, edited(items[j], allowed[j], p, rng)) for j in range(0, len(items), -(-len(items) // TRIED)) for p in ("head", "middle", "tail", "spread", "spread")]
        whole, low, high = self._joined(items)
        copies, begin, end = self._joined([x for _, x in tried])
        wanted = np.array([j for j, _ in tried])
        met = np.zeros(len(tried), bool)
        self.repeats: list[tuple[bool, np.ndarray, int, np.ndarray, np.ndarray]] = []
        while len(self.repeats) < MOST_REPEATS and (met.mean() < RECALL or not self.repeats):
            r = len(self.repeats)
            forward, seed = r % 2 == 0, r + 1
            # A walk takes two steps a word; all of it may be compared.
            steps = np.sort(rng.choice(2 * self.sizes.min(), min(SAMPLES, 2 * self.sizes.min()), replace=False))
            keys = walk(whole, low if forward else high - 1, low, high, steps, seed, forward)
            order = np.argsort(keys, kind="stable")
            self.repeats.append((forward, steps, seed, keys[order], order))
            own = walk(copies, begin if forward else end - 1, begin, end, steps, seed, forward)
            met |= own == keys[wanted]
        self.recall = float(met.mean())

    @staticmethod
    def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        end = np.cumsum([len(x) for x in texts])
        return np.concatenate(texts), end - [len(x) for x in texts], end

    def meetings(
        self, repeat: int, words: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, texts, places where the item would begin) of the windows from, or backward to, ``starts`` that share a bucket with an item."""
        forward, steps, seed, keys, order = self.repeats[repeat]
        text = np.searchsorted(end, starts, "right")
        for i in range(0, len(starts), WALKERS):
            some, of = starts[i : i + WALKERS], text[i : i + WALKERS]
            own = walk(words, some, begin[of], end[of], steps, seed, forward)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = high - low
            row = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            place = np.repeat(some, n) if forward else np.repeat(some, n) + 1 - self.sizes[row]
            yield self.numbers[row], np.repeat(of, n), place


class Benchmark:
    """One block of items, with the pieces to screen by and the items and places of each."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.known: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            words = [p for p in map(plain, (text or "").split()) if p]
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], np.int64))
        self.similarity = similarity
        found = defaultdict(list)
        for item, x in enumerate(self.items):
            k = edits_allowed(len(x), similarity)
            step = len(x) // (k + 1)
            q = min(PIECE, step)
            codes = self.codes(x, q)
            found[q] += [(int(codes[i * step]), item, i * step) for i in range(k + 1)]
        # Rows of one code follow each other: code, item and where in the item.
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for q, rows in found.items():
            codes, items_of, offsets = zip(*sorted(rows))
            self.pieces[q] = np.array(codes, np.uint64), np.array(items_of, np.int64), np.array(offsets, np.int64)
        self.classes: list[Buckets] = []
        same: list[int] = []
        for item in sorted(range(len(self.items)), key=lambda i: len(self.items[i])):
            if same and len(self.items[item]) > CLASS * len(self.items[same[0]]):
                self.classes.append(Buckets(self, same))
                same = []
            same.append(item)
        if same:
            self.classes.append(Buckets(self, same))
        self.class_of = np.zeros(len(self.items), np.int64)
        for number, own in enumerate(self.classes):
            self.class_of[own.numbers] = number
        #: Words within which places of an item count as one.
        self.room = np.array([edits_allowed(len(x), similarity) + 1 for x in self.items], np.int64)

    def codes(self, words: np.ndarray, q: int) -> np.ndarray:
        """A number for each run of q words."""
        n = len(words) - q + 1
        code = np.zeros(max(n, 0), np.uint64)
        for i in range(q):
            code = (code + words[i : i + n].astype(np.uint64)) * MIX
        return scramble(code)

    def screen(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Where runs of q words are pieces of items: q, places, and the rows of ``pieces[q]`` from and to."""
        hits = []
        known = words > LOST
        for q, (codes, _, _) in self.pieces.items():
            n = len(words) - q + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for i in range(1, q):
                whole &= known[i : i + n]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            code = np.zeros(len(at), np.uint64)
            for i in range(q):
                code = (code + words[at + i].astype(np.uint64)) * MIX
            code = scramble(code)
            low, high = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
            hit = high > low
            if hit.any():
                hits.append((q, at[hit], low[hit], high[hit]))
        return hits

    def seeds(self, texts: list[np.ndarray], begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, texts, places where the item would begin without edits before the piece), in parts of bounded size.

        Text i begins at ``begin[i]``; places are counted over all texts.
        """
        for text, words in enumerate(texts):
            for q, at, low, high in self.screen(words):
                n = high - low
                part = (np.cumsum(n) - n) // SEEDS
                for p in np.unique(part):
                    own = part == p
                    count = n[own]
                    row = np.repeat(low[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    _, items, offsets = self.pieces[q]
                    yield items[row], np.full(len(row), text), np.repeat(at[own], count) - offsets[row] + begin[text]

    def likely(self, seeds: tuple, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different ones of ``seeds`` in whose stretch the item has enough words."""
        items, texts, places = (x[np.unique(np.stack(seeds), axis=1, return_index=True)[1]] for x in seeds)
        kept = np.zeros(len(items), bool)
        own = np.zeros(len(self.known) + 1, bool)
        for group in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
            if not len(group):
                continue
            item = self.items[items[group[0]]]
            k = edits_allowed(len(item), self.similarity)
            own[item] = True
            rows = max(1, CELLS // (len(item) + 2 * k))
            for i in range(0, len(group), rows):
                some = group[i : i + rows]
                text = texts[some]
                kept[some] = shared_words(own, len(item), words, places[some], begin[text], end[text], k) >= len(item) - k
            own[item] = False
        return items[kept], texts[kept], places[kept]

    def met(self, seeds: tuple, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What walks of the windows around ``seeds`` meet; of places closer than an item's edits, whose stretches overlap, the first."""
        for number, own in enumerate(self.classes):
            items, texts, places = (x[self.class_of[seeds[0]] == number] for x in seeds)
            for repeat, (forward, *_) in enumerate(own.repeats):
                if not len(items):
                    break
                # Forward from where the item may begin, backward from where it may end.
                at = places if forward else places + np.array([len(self.items[i]) - 1 for i in items])
                around = at[:, None] + np.arange(-own.reach, own.reach + 1)
                starts = np.unique(around[(around >= begin[texts, None]) & (around < end[texts, None])])
                seen = []
                for met, of, place in own.meetings(repeat, words, begin, end, starts):
                    if len(met):
                        _, first = np.unique(np.stack([met, of, place // self.room[met]]), axis=1, return_index=True)
                        seen.append(met * len(begin) + of)
                        yield met[first], of[first], place[first]
                if seen:
                    # What has met an item need not meet it again.
                    left = ~np.isin(items * len(begin) + texts, np.concatenate(seen))
                    items, texts, places = items[left], texts[left], places[left]

    def matches(self, texts: list[np.ndarray], walks: bool = True, backstop: bool = True) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits) of the best window of each item in each text.

        Without ``backstop`` those that walks meet, without ``walks`` those that pieces name.
        """
        sizes = np.array([len(w) for w in texts], np.int64)
        end = np.cumsum(sizes)
        begin = end - sizes
        words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def settle(parts: list) -> None:
            seeds = self.likely([np.concatenate(x) for x in zip(*parts)], words, begin, end)
            if walks:
                self.judge(list(self.met(seeds, words, begin, end)), words, begin, end, best)
            if backstop:
                self.judge([seeds], words, begin, end, best)

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for seed in self.seeds(texts, begin):
            parts.append(seed)
            held += len(seed[0])
            if held >= SEEDS:
                settle(parts)
                parts, held = [], 0
        if parts:
            settle(parts)
        return [(text, item, first, n, e) for (text, item), (e, first, n) in sorted(best.items())]

    def judge(self, parts: list, words: np.ndarray, begin: np.ndarray, end: np.ndarray, best: dict) -> None:
        """Take the best windows of the seeds in ``parts`` into ``best``."""
        if not sum(len(x[0]) for x in parts):
            return
        items, texts, places = (np.concatenate(x) for x in zip(*parts))
        # Pieces of one stretch name it once.
        order = np.lexsort((places, texts, items))
        items, texts, places = items[order], texts[order], places[order]
        new = np.r_[True, (np.diff(items) != 0) | (np.diff(texts) != 0) | (np.diff(places) != 0)]
        items, texts, places = items[new], texts[new], places[new]
        own = np.zeros(len(self.known) + 1, bool)
        for group in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
            item = self.items[items[group[0]]]
            k = edits_allowed(len(item), self.similarity)
            own[item] = True
            rows = max(1, CELLS // (len(item) + 2 * k))
            for i in range(0, len(group), rows):
                some = group[i : i + rows]
                text = texts[some]
                at, first, last = places[some], begin[text], end[text]
                start, edits = best_start(item, words, at, first, last, k)
                text, start, last = text[edits <= k], start[edits <= k], last[edits <= k]
                for t, s, e, n in zip(text, start, *edit_distance(item, words, start, last, k)):
                    key, found = (int(t), int(items[some[0]])), (int(e), int(s - begin[t]), int(n))
                    best[key] = min(best.get(key, found), found)
            own[item] = False


def stretches(n: int, words: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """From k words before each place to k words behind an item of n words; what is outside ``first`` and ``last`` is -2."""
    at = places[:, None] + np.arange(-k, n + k)
    return np.where((at >= first[:, None]) & (at < last[:, None]), words[np.clip(at, 0, len(words) - 1)], -2)


def shared_words(own: np.ndarray, n: int, words: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """How many words of each stretch are among the item's, which ``own`` marks."""
    stretch = stretches(n, words, places, first, last, k)
    return (own[np.maximum(stretch, LOST)] & (stretch > LOST)).sum(axis=1)


def last_row(item: np.ndarray, windows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The last row of the tables of edits between ``item`` and each of ``windows``, from the row for no words."""
    column = np.arange(windows.shape[1] + 1)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != word))
        # Insertions: the least of any cell to the left plus its distance.
        row = np.minimum.accumulate(new - column, axis=1) + column
    return row


def best_start(item: np.ndarray, words: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the best window of each stretch starts, the first of equals, and its edits."""
    n = len(item)
    # Backwards, so that a column is a start; a window may end anywhere.
    backwards = stretches(n, words, places, first, last, k)[:, ::-1]
    row = last_row(item[::-1], backwards, np.zeros((len(places), n + 2 * k + 1), np.int64))[:, ::-1]
    start = places[:, None] + np.arange(-k, n + k + 1)
    row = np.where(start >= first[:, None], row, n + k + 1)
    at = np.argmin(row, axis=1)
    return places - k + at, row[np.arange(len(places)), at]


def edit_distance(item: np.ndarray, words: np.ndarray, starts: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of ``item`` against the windows at ``starts`` (lengths n - k to n + k), and that length.

    Windows end at ``limits``; words behind match nothing and cost an edit each, so shorter ones win.
    """
    n = len(item)
    width = n + k
    at = starts[:, None] + np.arange(width)
    window = np.where(at < limits[:, None], words[np.minimum(at, len(words) - 1)], -2)
    row = last_row(item, window, np.broadcast_to(np.arange(width + 1), (len(starts), width + 1)).copy())
    size = np.argmin(row[:, n - k :], axis=1) + n - k
    return row[np.arange(len(starts)), size], size


SCHEMA = "doc_id long, item_id long, first_word long, words long, edits long"


def blocks(benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; one item at a time comes by."""
    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    block: list[tuple[int, str]] = []
    words = 0
    for row in items.orderBy("id", "text").toLocalIterator():
        n = len(row.text.split())
        if words + n > BLOCK_WORDS and block:
            yield block
            block, words = [], 0
        block.append((row.id, row.text))
        words += n
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, words, edits: the best window per document and item.

    Words are counted without those that are punctuation only.
    """
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block, similarity))
        found = source.mapInPandas(lambda batches, b=shared: scan(batches, b.value), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    out = docs
    for block in blocks(benchmark, item, item_text):
        out = out.filter(~holder(docs.sparkSession.sparkContext.broadcast(Benchmark(block, similarity)))(F.col(text)))
    return out


def holder(shared):
    """A function of texts: whether they hold an item of the block that was broadcast."""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = pd.DataFrame({"doc_id": range(len(batch)), "text": batch.to_numpy()})
            hit = np.zeros(len(batch), bool)
            hit[next(scan(iter([rows]), shared.value))["doc_id"].to_numpy(np.int64)] = True
            yield pd.Series(hit)

    return holds


def scan(batches: Iterator[pd.DataFrame], bench: Benchmark) -> Iterator[pd.DataFrame]:
    known = Words(bench.known)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        if bench.items:
            ids = batch["doc_id"].tolist()
            # Texts of some million words are matched at once.
            part: list[np.ndarray] = []
            size = begin = 0
            for i, text in enumerate([*batch["text"], None]):
                words = np.array(list(map(known.__getitem__, (text or "").split())), np.int64)
                part.append(words[words >= 0])
                size += len(words)
                if size > 2_000_000 or i == len(ids):
                    rows += [(ids[begin + t], bench.ids[item], *at) for t, item, *at in bench.matches(part)]
                    part, size, begin = [], 0, i + 1
        yield pd.DataFrame(rows, columns=names)
