"""Near-duplicates by improved consistent weighted sampling of TF-IDF shingles.

Features are shingles of five words as they stand; the k-th occurrence of a shingle is a feature of its
own, so the sum of shared weights is the sum of least weights. A feature weighs the mean
of its words' weights, 1 + idf / greatest idf, where a word's document frequency over
all documents counts as a thousandth of the documents at least. So every frequency
that matters is that of a word in a thousandth of the documents; of those there are at most a
thousand times the mean number of distinct words of a document, which bounds the
broadcast. Frequencies are taken of words and not of shingles: inside a large group of near
copies the shared shingles are frequent and the changed ones rare, so idf of shingles
would tear apart what is alike.

Sampling: per hash and feature, r and c are Gamma(2, 1) and b uniform, all drawn from the
feature; t = floor(ln w / r + b), ln a = ln c - r (t - b) - r; the least ln a is the
sample, and two texts have the same with a probability of their weighted Jaccard
similarity. ln a depends on nothing but the feature and t, so it names the sample. BANDS
bands of ROWS samples find pairs of similarity 0.8 with a probability of 0.998.

Verification: exact copies are one content from the start. Buckets of the same members
are one. A bucket's members are dealt in blocks, and each pair of blocks is verified in
one task by exact weighted Jaccard similarity of all features; what comes out is a
spanning forest of the verified links, not the links. Classes are the connected components.

Defined results: texts of fewer than five words are one shingle; texts without words, NULL
among them, are classes of equal texts; repeated rows and documents of one id are rows
of their own; an empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import nested, unnested
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 16
#: A word in fewer than this share of the documents counts as in this share.
RARE = 1000
#: Members of one block; a task holds two.
BLOCK = 512
#: Features that are sampled at once, so that they stay in the processor's cache.
CHUNK = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX2
    return x ^ (x >> np.uint64(29))


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Hashes(dict):
    """Hash of a word; words seen before are looked up."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = h = word_hash(word)
        return h


def content(text: Column) -> Column:
    """The address of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n: in how many texts of this part a word is. Comes out in slices of bounded size."""
    counts: Counter = Counter()

    def out() -> pd.DataFrame:
        words = np.fromiter(map(word_hash, counts), np.uint64, len(counts)).view(np.int64)
        return pd.DataFrame({"word": words, "n": np.fromiter(counts.values(), np.int64, len(counts))})

    for batch in batches:
        for text in batch["text"]:
            if text:
                counts.update(set(text.split()))
            if len(counts) > 1_000_000:
                yield out()
                counts.clear()
    yield out()


def word_weights(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and weights of the words in a thousandth of the documents or more."""
    n = docs.count()
    counted = docs.select(F.col(text).alias("text")).mapInPandas(count_words, "word long, n long")
    common = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * RARE >= n)
    rows = common.toPandas()
    words = rows["word"].to_numpy(np.int64).view(np.uint64)
    weights = 1 + np.log1p(n / np.maximum(rows["n"].to_numpy(float), 1)) / np.log1p(RARE)
    order = np.argsort(words)
    return words[order], weights[order]


class Features:
    """Features and weights of texts."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        self.words, self.weights, self.hashes = words, weights, Hashes()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, weights and the number of features of each text."""
        coded = [np.fromiter(map(self.hashes.__getitem__, s := (t or "").split()), np.uint64, len(s)) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        words = np.concatenate([*coded, np.zeros(0, np.uint64)])
        weight = np.full(len(words), 2.0)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            weight = np.where(self.words[at] == words, self.weights[at], 2.0)
        lengths = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
        begin = np.cumsum(sizes) - sizes
        first = np.repeat(begin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        wide = np.repeat(np.minimum(sizes, SHINGLE), lengths)
        code, total = np.zeros(len(first), np.uint64), np.zeros(len(first))
        for i in range(SHINGLE):
            there = i < wide
            j = np.where(there, first + i, 0)
            if len(words):
                code = np.where(there, scramble((code + words[j]) * MIX), code)
                total += np.where(there, weight[j], 0.0)
        # The k-th occurrence in a text.
        own = scramble(code ^ (np.repeat(np.arange(len(texts)), lengths).astype(np.uint64) * MIX))
        order = np.argsort(own, kind="stable")
        run = np.r_[True, own[order][1:] != own[order][:-1]] if len(own) else np.zeros(0, bool)
        nth = np.empty(len(own), np.int64)
        nth[order] = np.arange(len(own)) - np.maximum.accumulate(np.where(run, np.arange(len(own)), 0))
        code = np.where(nth > 0, scramble(code + nth.astype(np.uint64) * MIX), code)
        return code, total / np.maximum(wide, 1), lengths


def gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2^16 equal steps (1 - (1 + x) e^-x, inverted by Newton's method)."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return x.astype(np.float32)


class Sampler:
    """Consistent weighted samples, banded."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 5):
        self.rows, self.bands = rows, bands
        rng = np.random.default_rng(seed)
        self.keys = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1)
        self.r = gamma_table()
        self.ln_c = np.log(self.r)

    def samples(self, features: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The least ln a per hash (row) and text (column); +inf for texts without features."""
        out = np.full((len(self.keys), len(lengths)), np.inf, np.float32)
        ln_w = np.log(weights).astype(np.float32)
        begin = np.cumsum(lengths) - lengths
        for lo in range(0, len(features), CHUNK):
            hi = min(lo + CHUNK, len(features))
            # Texts that have features in this chunk, and where theirs start in it.
            a = int(np.searchsorted(begin + lengths, lo, "right"))
            b = int(np.searchsorted(begin, hi, "left"))
            texts = np.arange(a, b)[lengths[a:b] > 0]
            cut = np.maximum(begin[texts] - lo, 0)
            x, w = features[lo:hi], ln_w[lo:hi]
            for i, key in enumerate(self.keys):
                z = x * key
                z ^= z >> np.uint64(32)
                z *= MIX
                f = z.view(np.uint16).reshape(-1, 4)
                r = self.r.take(f[:, 3])
                b_ = f[:, 2] * np.float32(1 / 65536)
                t = np.floor(w / r + b_)
                ln_a = self.ln_c.take(f[:, 1]) - r * (t - b_ + np.float32(1))
                out[i, texts] = np.minimum(out[i, texts], np.minimum.reduceat(ln_a, cut))
        return out

    def bands_of(self, samples: np.ndarray) -> np.ndarray:
        """A number per text (row) and band."""
        bits = samples.view(np.uint32).astype(np.uint64)
        out = np.zeros((samples.shape[1], self.bands), np.uint64)
        for i in range(self.rows * self.bands):
            out[:, i // self.rows] = scramble((out[:, i // self.rows] + bits[i]) * MIX)
        return out.view(np.int64)


def in_parts(texts: list[str], words: int = 400_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about so many words."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") // 6
        if size > words or i + 1 == len(texts):
            yield begin, i + 1
            begin, size = i + 1, 0


def signatures(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (address of the text) and bands per row; texts without words have no bands."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, sampler = Features(*shared.value), Sampler()
        for batch in batches:
            texts = batch["text"].tolist()
            bands: list = []
            for a, b in in_parts(texts):
                code, weight, lengths = features.of(texts[a:b])
                made = sampler.bands_of(sampler.samples(code, weight, lengths))
                bands += [m if n else m[:0] for m, n in zip(made, lengths)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": batch["node"], "bands": bands})

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), content(F.col(text)).alias("node"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, node binary, bands array<long>")


def similar(codes: list[np.ndarray], weights: list[np.ndarray], least: float) -> np.ndarray:
    """For each text the first one of its component of verified links."""
    m = len(codes)
    sizes = np.array([len(c) for c in codes])
    code, weight = np.concatenate(codes), np.concatenate(weights).astype(float)
    text = np.repeat(np.arange(m), sizes)
    totals = np.bincount(text, weight, m)
    order = np.argsort(code, kind="stable")
    code, weight, text = code[order], weight[order], text[order]
    new = np.r_[True, code[1:] != code[:-1]]
    column = np.cumsum(new) - 1
    # A feature that one text alone has is in no sum of shared weights.
    shared = np.bincount(column)[column] > 1
    column, weight, text = np.cumsum(new[shared]) - 1, weight[shared], text[shared]
    both = np.zeros((m, m))
    columns = int(column[-1]) + 1 if len(column) else 0
    # No wider than the columns there are: most groups are a few texts.
    width = min(max(256, 4_000_000 // m), columns)
    for lo in range(0, columns, max(width, 1)):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, width))
        part[text[a:b], column[a:b] - lo] = np.sqrt(weight[a:b])
        both += part @ part.T
    alike = both >= least * (totals[:, None] + totals[None, :] - both) - 1e-9
    np.fill_diagonal(alike, True)
    label = np.arange(m)
    while True:
        new_label = np.where(alike, label[None, :], m).min(1)
        new_label = np.minimum(new_label, new_label[new_label])
        if (new_label == label).all():
            return label
        label = new_label


def verify_group(group: pd.DataFrame, least: float) -> pd.DataFrame:
    a, b = [], []
    for _, one in group.groupby(["bucket", "lo", "hi"], sort=False):
        node = one["node"].tolist()
        if len(node) < 2:
            continue
        codes = [np.frombuffer(x, np.uint64) for x in one["codes"]]
        weights = [np.frombuffer(x, np.float32) for x in one["weights"]]
        for i, root in enumerate(similar(codes, weights, least)):
            if root != i:
                a.append(node[i])
                b.append(node[root])
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})


def links(docs: DataFrame, signed: DataFrame, weights: tuple[np.ndarray, np.ndarray], doc: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """a, b: a spanning forest of the verified links between different texts."""
    contents = signed.groupBy("node").agg(F.min(F.struct("doc_id")).alias("carrier"), F.first("bands").alias("bands"))
    contents = cut_lineage(contents.filter(F.size("bands") > 0))
    members = contents.select("node", F.posexplode("bands").alias("band", "value")).select(
        "node", F.xxhash64("band", "value").alias("bucket")
    )
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"f{i}") for i in (1, 2)]
    sets = members.groupBy("bucket").agg(F.count("*").alias("n"), *marks).filter("n > 1")
    sets = cut_lineage(sets.groupBy("n", "f1", "f2").agg(F.min("bucket").alias("bucket")))
    kept = cut_lineage(members.join(sets.select("bucket", "n"), "bucket"))
    involved = kept.select("node").distinct().join(contents.select("node", "carrier"), "node")
    # The id is in the key, so the copies of a text spread and one of them is read.
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), content(F.col(text)).alias("_node"), F.col(text).alias("text"))
    texts = rows.join(involved, (F.col("_node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("carrier.doc_id"))).select("node", "text")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(*shared.value)
        for batch in batches:
            all_texts, nodes = batch["text"].tolist(), batch["node"].tolist()
            for a, b in in_parts(all_texts):
                code, weight, lengths = features.of(all_texts[a:b])
                at = np.cumsum(lengths)[:-1]
                yield pd.DataFrame({
                    "node": nodes[a:b],
                    "codes": [x.tobytes() for x in np.split(code, at)],
                    "weights": [x.astype(np.float32).tobytes() for x in np.split(weight, at)],
                })

    featured = cut_lineage(texts.mapInPandas(run, "node binary, codes binary, weights binary").dropDuplicates(["node"]))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = kept.select("bucket", "n", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("bucket", "n", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    # Small sets share tasks; a pair of large blocks is a task of its own.
    tasks = max(1, kept.count() // 1024)
    task = F.when(F.col("n") <= BLOCK, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(F.xxhash64("bucket", "lo", "hi"))
    met = dealt.join(featured, "node").withColumn("task", task)
    return met.groupBy("task").applyInPandas(lambda g: verify_group(g, least), "a binary, b binary")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, node, root, class_id and class_size per row; the class id is the least document id."""
    weights = word_weights(docs, text)
    signed = cut_lineage(signatures(docs, weights, doc, text))
    forest = cut_lineage(links(docs, signed, weights, doc, text, least))
    roots = cut_lineage(components(forest))
    rows = signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    classes = cut_lineage(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return rows.join(classes, "root").select("doc_id", "node", "root", "class_id", "class_size")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates: the one with the least id, then the least text address."""
    classes = near_duplicates(docs, doc, text, least)
    kept = classes.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("_kept")).select("_kept")
    rows = nested(docs).withColumns({"node": content(F.col("_row").getField(text)), "id": F.col("_row").getField(doc).cast("long")})
    met = rows.join(kept, (F.col("node") == F.col("_kept.node")) & F.col("id").eqNullSafe(F.col("_kept.doc_id")))
    # A row may be there more than once; it is partitioned by this key already.
    first = Window.partitionBy("node", "id").orderBy(F.lit(1))
    return unnested(met.withColumn("n", F.row_number().over(first)).filter("n = 1"), docs.columns)
