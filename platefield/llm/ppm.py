"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts up to ORDER bytes is held as counted tables: a row for each
context and next byte, for each order. It is counted over all training texts; scores are
code lengths under the pretrained trie. A byte is predicted by the longest context that knows it;
with n its count and d its number of distinct next bytes, a byte counted c times has the
probability (2c - 1) / 2n there and the escape to the next shorter context d / 2n (method
D). The bytes a longer context knows are excluded below, which needs, per context, the
count its bytes have one order lower. Bytes that no order knows share the
last escape evenly. Every text starts from ORDER pads and ends in an end sign.

Neither the trie nor the words are broadcast, as both grow with the corpus. Documents are
dealt into blocks of bounded size by a hash; a block asks for the distinct contexts and words
it holds, the answers come back by one join, and the block's texts are scored with them.

The word model beside it: log10((c + 1) / (N + V + 1)) per token, words in lower case
(A to Z) and one end token per text. Words are told apart by a hash of 63 bits.

Defined results: a NULL or empty text is its end sign; repeated rows are scored each (and learned from
each); without training rows the trie is empty and every byte costs log10(257); an empty
table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import crc_mod

ORDER = 4
#: Bytes that no UTF-8 text has.
PAD, END = 0xFE, 0xFF
SYMBOLS = 257
BLOCK_BYTES = 24_000_000
#: Bytes that are coded at once inside a task.
PART_BYTES = 1_000_000
#: A key is a tag and the bytes of a context: pairs of order j, then n, d and the excluded count of contexts.
TAG = 44
PAIR, TOTAL, DISTINCT, EXCLUDED = 0, 5, 10, 15
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mask(n: int) -> int:
    return (1 << 8 * n) - 1


def word_key(word: bytes) -> int:
    """Negative keys of words."""
    return -1 - (xxhash.xxh3_64_intdigest(word) >> 1)


class WordKeys(dict):
    """Keys of words; those seen lately are looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = key = word_key(word)
        return key


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER + 1 bytes up to each byte and end sign, as numbers; and how many each text has."""
    joined = np.frombuffer(b"".join(bytes([PAD]) * ORDER + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    code = np.zeros(max(len(joined) - ORDER, 0), np.int64)
    for i in range(ORDER + 1):
        code = (code << 8) | joined[i : i + len(code)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # Windows that reach over a text's end into the next one's pads are none of either's.
    keep = np.ones(len(code), bool)
    stop = np.cumsum(sizes + ORDER)[:-1]
    keep[(stop[:, None] - ORDER + np.arange(ORDER)).ravel()] = False
    return code[keep], sizes


def in_parts(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that are coded at once; no more than one run is held in bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > PART_BYTES or i + 1 == len(texts):
            yield begin, i + 1
            begin, size = i + 1, 0


def add_counts(into: tuple[np.ndarray, np.ndarray], keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(np.r_[into[0], keys], return_inverse=True)
    return both, np.bincount(at, np.r_[into[1], n], len(both)).astype(np.int64)


def count_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, n of the grams and words of a part, in slices of bounded size."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    seen, words = none, Counter()

    def word_rows() -> pd.DataFrame:
        return pd.DataFrame({"key": np.fromiter(map(word_key, words), np.int64, len(words)), "n": np.fromiter(words.values(), np.int64, len(words))})

    for batch in batches:
        for a, b in in_parts(batch["text"]):
            texts = [encoded(t) for t in batch["text"].iloc[a:b]]
            seen = add_counts(seen, *np.unique(grams(texts)[0], return_counts=True))
            for t in texts:
                words.update(t.translate(LOWER).split())
                if len(words) > 150_000:
                    yield word_rows()
                    words.clear()
            if len(seen[0]) > 2_000_000:
                yield pd.DataFrame({"key": seen[0], "n": seen[1]})
                seen = none
    yield word_rows()
    yield pd.DataFrame({"key": seen[0], "n": seen[1]})


def trie(counted: DataFrame) -> DataFrame:
    """key, value of all contexts, from the counts of the longest grams (key, n)."""
    levels = [counted.select(F.col("key").alias("code"), F.col("n").alias("c"))]
    for j in reversed(range(ORDER)):
        levels.insert(0, levels[0].groupBy(F.col("code").bitwiseAND(mask(j + 1)).alias("code")).agg(F.sum("c").alias("c")))
    levels = [cut_lineage(t) for t in levels]
    key = lambda tag, code: (F.lit(tag << TAG).cast("long") + code).alias("key")
    rows = []
    for j, t in enumerate(levels):
        context = F.shiftright("code", 8).alias("context")
        rows.append(t.select(key(PAIR + j, F.col("code")), F.col("c").alias("value")))
        sums = t.groupBy(context).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
        pair = F.explode(F.array(F.struct(key(TOTAL + j, F.col("context")), F.col("n").alias("value")), F.struct(key(DISTINCT + j, F.col("context")), F.col("d").alias("value"))))
        rows.append(sums.select(pair.alias("x")).select("x.*"))
        if j:
            lower = levels[j - 1].select(F.col("code").alias("_low"), F.col("c").alias("_c"))
            met = t.withColumn("_low", F.col("code").bitwiseAND(mask(j))).join(lower, "_low")
            rows.append(met.groupBy(context).agg(F.sum("_c").alias("value")).select(key(EXCLUDED + j - 1, F.col("context")), "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def asked(codes: np.ndarray) -> np.ndarray:
    """The trie keys that the distinct grams of a block need."""
    out = []
    for j in range(ORDER + 1):
        pair = np.unique(codes & mask(j + 1))
        context = np.unique(pair >> 8)
        out.append(pair + (PAIR + j << TAG))
        out += [context + (tag + j << TAG) for tag in (TOTAL, DISTINCT)]
        if j:
            out.append(context + (EXCLUDED + j - 1 << TAG))
    return np.concatenate(out)


def log_probability(codes: np.ndarray, get) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others. ``get(tag, codes)`` reads the trie."""
    out = np.zeros(len(codes))
    done = np.zeros(len(codes), bool)
    known = np.zeros(len(codes))
    for j in reversed(range(ORDER + 1)):
        pair = codes & mask(j + 1)
        n, d, c = get(TOTAL + j, pair >> 8), get(DISTINCT + j, pair >> 8), get(PAIR + j, pair)
        if j < ORDER:
            upper = (codes & mask(j + 2)) >> 8
            n, new = n - get(EXCLUDED + j, upper), d - get(DISTINCT + j + 1, upper)
        else:
            new = d
        hit, leave = ~done & (c > 0), ~done & (c == 0) & (new > 0)
        out[hit] += np.log10((2 * c[hit] - 1) / (2 * n[hit]))
        out[leave] += np.log10(new[leave] / (2 * n[leave]))
        done |= hit
        known = d
    out[~done] -= np.log10(SYMBOLS - known[~done])
    return out


def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """block, key: what each block needs. Rows of a block come together."""
    block, codes, words = None, [], set()

    def out() -> Iterator[pd.DataFrame]:
        if codes:
            need = np.r_[asked(np.unique(np.concatenate(codes))), np.fromiter(map(word_key, words), np.int64, len(words))]
            yield pd.DataFrame({"block": block, "key": need})

    for batch in batches:
        for b, rows in batch.groupby("block", sort=False):
            if b != block:
                yield from out()
                block, codes, words = b, [], set()
            for lo, hi in in_parts(rows["text"]):
                texts = [encoded(t) for t in rows["text"].iloc[lo:hi]]
                codes.append(np.unique(grams(texts)[0]))
                if sum(map(len, codes)) > 1_000_000:
                    codes = [np.unique(np.concatenate(codes))]
                for t in texts:
                    words.update(t.translate(LOWER).split())
    yield from out()


class Answers:
    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, tag: int, codes: np.ndarray) -> np.ndarray:
        return self.of(codes + (tag << TAG))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, 0 where there is none."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0).astype(float)


def score_block(rows: pd.DataFrame, answers: pd.DataFrame, tokens: int, types: int, ends: int) -> pd.DataFrame:
    """Scores of the texts of one block."""
    known = Answers(answers["key"].to_numpy(np.int64), answers["value"].to_numpy(np.int64))
    keys = WordKeys()
    base = lambda c: np.log10((c + 1) / (tokens + types + 1))
    score, base_score = np.zeros(len(rows)), np.zeros(len(rows))
    n_tokens, n_known = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for a, b in in_parts(rows["text"]):
        texts = [encoded(t) for t in rows["text"].iloc[a:b]]
        codes, sizes = grams(texts)
        distinct, at = np.unique(codes, return_inverse=True)
        score[a:b] = np.add.reduceat(log_probability(distinct, known.get)[at], np.cumsum(sizes) - sizes)
        split = [t.translate(LOWER).split() for t in texts]
        of = np.array([len(s) for s in split], np.int64)
        flat = np.fromiter((keys[w] for s in split for w in s), np.int64, of.sum())
        distinct, at = np.unique(flat, return_inverse=True)
        c = known.of(distinct)
        first = np.cumsum(of) - of
        sums = lambda v: np.diff(np.r_[0, np.cumsum(v)][np.r_[first, of.sum()]])
        n_tokens[a:b] = of + 1
        n_known[a:b] = sums((c > 0)[at].astype(np.int64)) + (ends > 0)
        per_word = base(c)[at]
        base_score[a:b] = [per_word[i : i + n].sum() for i, n in zip(first, of)] + base(ends)
    return pd.DataFrame({
        "doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": n_tokens, "n_known": n_known,
        "train_tokens": tokens, "base_score": base_score, "score": score,
    })


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all texts under models learned from the rows that aren't held out."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    learned = rows.filter(~F.col("held_out"))
    counted = cut_lineage(
        learned.select("text").mapInPandas(count_texts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    )
    total = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held_out"), 1))).first()
    size, ends = total[0] or 0, total[1]
    words, types = counted.filter("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = words + ends, types + (ends > 0)
    model = cut_lineage(
        trie(counted.filter("key >= 0")).unionByName(counted.filter("key < 0").select("key", F.col("n").alias("value")))
    )
    blocks = max(2, -(-size // BLOCK_BYTES))
    # The same exchange serves the questions and the scoring.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64), F.octet_length("text")), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    questions = dealt.sortWithinPartitions("block").mapInPandas(ask, "block int, key long")
    answers = questions.join(model, "key").select("block", "key", "value").repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        lambda left, right: score_block(left, right, tokens, types, ends), RESULT
    )


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 7) == 2
