"""Toxicity by a linear-chain conditional random field over words.

Labels come per document, the field needs them per word. Words are labelled by what sets
the toxic documents of the training sample apart: a word of a toxic document is a toxic
one if its contexts (the words beside it) lie significantly more often in toxic than in
other documents. Contexts and not occurrences are counted, so hundreds of copies of one
document prove nothing. The field sees the evidence class of a word and of its
neighbours, never the label, language, source or id of the document.

Forward and backward passes give each word its marginal probability of being toxic. A
logistic function of a document's largest marginal and its mass of marginals, fitted on
the training sample, is the score; runs of words with a marginal of 0.5 or more are the
offending spans (code points, exclusive end).

Training reads a bounded sample: labelled documents are kept with a probability that
gives about ``sample`` of them for the word evidence and about ``sequences`` for the
field, chosen by a hash of the id. Scoring reads every text, whole, in one pass without a
shuffle.

Defined results: a NULL or empty text has no words and gets the score of no evidence;
without labels of both kinds every score is 0; repeated rows are scored each; a document
with several labels is toxic if one says so; NULL ids or labels aren't learned from; other
columns are kept, but ``score`` replaces those of the names it adds (``drop_toxic`` adds none); an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import crc_mod, nested, shuffle_key, unnested

SAMPLE = 16384
SEQUENCES = 2048
#: Words of one training sequence; longer documents give several.
STRETCH = 256
#: Most words the evidence table may hold, by strength.
LEXICON = 65536
#: Lower bounds of the evidence classes 1.., in natural log odds.
CLASSES = (1.0, 2.5, 4.0)
LEAST_CONTEXTS, LEAST_Z = 4, 3.0
#: Steps after which messages over words without evidence no longer change.
SETTLED = 4096
PART = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"\S+")
FEATURES = 1 + 3 * len(CLASSES)


class Evidence(dict):
    """Evidence class of a word as written; words seen before are looked up once."""

    def __init__(self, lexicon: dict[str, int], limit: int = 1 << 20):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = max((self.lexicon.get(p, 0) for p in PART.findall(word.lower())), default=0)
        self[word] = found
        return found


@dataclass
class Field:
    """Weights of the label "toxic" against "clean", and of the four steps between labels."""

    emit: np.ndarray
    step: np.ndarray  # [from, to] with 0 = clean


def emissions(classes: np.ndarray, first: np.ndarray, last: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The field's local log odds of each word; ``first`` and ``last`` mark the ends of sequences."""
    k = len(CLASSES)
    own, before, after = (np.concatenate([[0.0], emit[1 + i * k : 1 + (i + 1) * k]]) for i in range(3))
    left = np.zeros(len(classes), np.int8)
    left[1:] = classes[:-1]
    left[first] = 0
    right = np.zeros(len(classes), np.int8)
    right[:-1] = classes[1:]
    right[last] = 0
    return emit[0] + own[classes] + before[left] + after[right]


def ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stop = np.cumsum(lengths)
    return stop - lengths, stop - 1


def passes(local: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the forward and the backward messages, for sequences laid end to end.

    All sequences take their t-th word at once; they are put in order of length, so those
    still going on are a prefix.
    """
    start, stop = ends(lengths)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left") if len(sizes) else np.zeros(0, int)
    e = np.exp(step)
    forward, backward = np.empty(len(local)), np.empty(len(local))
    at, tail = start[order], stop[order]
    forward[at] = local[at]
    backward[tail] = 0.0
    for t in range(1, sizes[0] if len(sizes) else 0):
        n = alive[t]
        i = at[:n] + t
        odds = np.exp(np.clip(forward[i - 1], -60, 60))
        forward[i] = local[i] + np.log((e[0, 1] + odds * e[1, 1]) / (e[0, 0] + odds * e[1, 0]))
        j = tail[:n] - t
        odds = np.exp(np.clip(local[j + 1] + backward[j + 1], -60, 60))
        backward[j] = np.log((e[1, 0] + odds * e[1, 1]) / (e[0, 0] + odds * e[0, 1]))
    return forward, backward


def marginals(classes: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """Probability of each word to be toxic."""
    if not len(classes):
        return np.zeros(0)
    local = emissions(classes, *ends(lengths), field.emit)
    forward, backward = passes(local, lengths, field.step)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))


def fit(classes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 0.02) -> Field:
    """Likelihood ascent (Adam) with weight decay over sequences laid end to end."""
    k = len(CLASSES)
    first, last = ends(lengths)
    inner = np.ones(len(classes), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    left, right = np.zeros(len(classes), np.int8), np.zeros(len(classes), np.int8)
    left[1:], right[:-1] = classes[:-1], classes[1:]
    left[first], right[last] = 0, 0
    by_class = lambda weights: np.concatenate([np.bincount(c, weights, k + 1)[1:] for c in (classes, left, right)])
    own = np.concatenate([[labels.sum()], by_class(labels.astype(float))])
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (labels[to - 1], labels[to]), 1)
    w, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for r in range(1, rounds + 1):
        field = Field(w[:FEATURES], w[FEATURES:].reshape(2, 2))
        local = emissions(classes, first, last, field.emit)
        forward, backward = passes(local, lengths, field.step)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
        expected = np.concatenate([[p.sum()], by_class(p)])
        a, b = np.clip(forward[to - 1], -60, 60), np.clip(local[to] + backward[to], -60, 60)
        joint = np.exp(np.array([[np.zeros_like(a), b], [a, a + b]]) + field.step[:, :, None])
        joint = (joint / joint.sum((0, 1))).sum(2)
        g = np.concatenate([own - expected, (pairs - joint).ravel()]) / len(lengths) - decay * w / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(w[:FEATURES], w[FEATURES:].reshape(2, 2))


def document_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: largest marginal, and the log of the summed squares (long texts of tiny marginals weigh nothing)."""
    out = np.zeros((len(lengths), 2))
    full = np.flatnonzero(lengths)
    if len(full):
        start = ends(lengths)[0][full]
        out[full, 0] = np.maximum.reduceat(p, start)
        out[full, 1] = np.log1p(np.add.reduceat(p * p, start))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Newton steps; returns bias and weights."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + decay * len(y) * np.eye(len(w))
        w = w + np.linalg.solve(h, x1.T @ (y - p) - decay * len(y) * w)
    return w


@dataclass
class Model:
    lexicon: dict[str, int]
    field: Field
    link: np.ndarray


def word_evidence(sample: DataFrame, text: str) -> DataFrame:
    """word, toxic, clean: in how many contexts the word stands in either kind of document."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    beside = lambda w, i: F.xxhash64(F.try_element_at("_w", i), F.try_element_at("_w", i + 2))
    listed = sample.select("toxic", words.alias("_w"))
    # Index 0 has no element, so a sentinel in front stands for the start.
    listed = listed.withColumn("_w", F.concat(F.array(F.lit("")), "_w"))
    placed = listed.select(
        "toxic",
        F.explode(F.transform(F.slice("_w", F.lit(2), F.size("_w")), lambda w, i: F.struct(w.alias("word"), beside(w, i + 1).alias("context")))).alias("x"),
    )
    contexts = placed.groupBy("x.word", "x.context").agg(F.max("toxic").alias("toxic"), F.max(1 - F.col("toxic")).alias("clean"))
    return contexts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE, sequences: int = SEQUENCES) -> Model | None:
    """A model from the labelled documents, or None if they aren't of both kinds.

    ``labels(doc_id, toxic)`` holds the rows to learn from and no others.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = marked.count()
    key = shuffle_key(F.col("doc_id"), seed="toxicity")
    share = lambda n: F.lit(int(min(1.0, n / max(total, 1)) * (2**60 - 1))).cast("long")
    # About SAMPLE rows of a few bytes: the bound of this broadcast.
    chosen = F.broadcast(marked.filter(key <= share(sample)))
    texts = cut_lineage(
        docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")
    )
    z = lambda a, b, na, nb: (
        (F.log((a + 0.5) / (na - a + 0.5)) - F.log((b + 0.5) / (nb - b + 0.5))) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    )
    words = cut_lineage(word_evidence(texts, "text").filter((F.col("toxic") >= LEAST_CONTEXTS) | (F.col("clean") >= LEAST_CONTEXTS)))
    na, nb = words.agg(F.sum("toxic").cast("double"), F.sum("clean").cast("double")).first()
    if not na or not nb:
        return None
    a, b = F.col("toxic"), F.col("clean")
    odds = F.log((a + 0.5) / (F.lit(na) - a + 0.5)) - F.log((b + 0.5) / (F.lit(nb) - b + 0.5))
    strong = words.filter(a >= LEAST_CONTEXTS).select("word", odds.alias("odds"), z(a, b, F.lit(na), F.lit(nb)).alias("z")).filter(
        (F.col("z") >= LEAST_Z) & (F.col("odds") >= CLASSES[0])
    )
    lexicon = {r.word: sum(r.odds >= c for c in CLASSES) for r in strong.orderBy(F.desc("z"), "word").limit(LEXICON).collect()}
    rows = encoded(texts.filter(key <= share(sequences)), lexicon).collect()
    classes = [np.frombuffer(bytes(r.classes), np.int8) for r in rows]
    toxic = np.array([r.toxic for r in rows], int)
    if not len(rows) or toxic.min() == toxic.max():
        return None
    lengths = np.array([len(c) for c in classes])
    flat = np.concatenate(classes)
    tags = ((flat >= 2) & np.repeat(toxic, lengths).astype(bool)).astype(int)
    # Long documents give several stretches.
    pieces = np.concatenate([np.r_[np.full(n // STRETCH, STRETCH), n % STRETCH] for n in lengths]).astype(int)
    field = fit(flat, pieces[pieces > 0], tags)
    link = fit_logistic(document_features(marginals(flat, lengths[lengths > 0], field), lengths), toxic)
    return Model(lexicon, field, link)


def encoded(texts: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """doc_id, toxic and the evidence classes of the words, a byte each."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(shared.value)
        for batch in batches:
            coded = [bytes(map(evidence.__getitem__, (t or "").split())) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "classes": coded})

    return texts.select("doc_id", "toxic", "text").mapInPandas(run, "doc_id long, toxic int, classes binary")


class Scorer:
    """Scores texts with one model. Texts without evidence share one pass per length."""

    def __init__(self, model: Model):
        self.model, self.evidence, self.plain = model, Evidence(model.lexicon), {}
        one = np.array([SETTLED])
        self.start, stop = passes(np.full(SETTLED, model.field.emit[0]), one, model.field.step)
        self.stop = stop[::-1]

    def plain_features(self, length: int) -> np.ndarray:
        """Features of a text of so many words without evidence.

        Its messages depend on the distance to the start and to the end alone and settle
        within SETTLED steps, so those of one long sequence serve all lengths.
        """
        if length not in self.plain:
            if len(self.plain) > 1 << 16:
                self.plain.clear()
            at = np.arange(length)
            p = self.start[np.minimum(at, SETTLED - 1)] + self.stop[np.minimum(at[::-1], SETTLED - 1)]
            self.plain[length] = document_features(1 / (1 + np.exp(-np.clip(p, -60, 60))), np.array([length]))[0]
        return self.plain[length]

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        coded = [bytes(map(self.evidence.__getitem__, t.split())) for t in texts]
        x = np.zeros((len(texts), 2))
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        marked = [i for i, c in enumerate(coded) if any(c)]
        for i, c in enumerate(coded):
            if c and not any(c):
                x[i] = self.plain_features(len(c))
        if marked:
            lengths = np.array([len(coded[i]) for i in marked])
            p = marginals(np.frombuffer(b"".join(coded[i] for i in marked), np.int8), lengths, self.model.field)
            x[marked] = document_features(p, lengths)
            for i, begin, n in zip(marked, ends(lengths)[0], lengths):
                own = p[begin : begin + n]
                if own.max() >= 0.5:
                    spans[i] = toxic_spans(texts[i], own)
        score = 1 / (1 + np.exp(-np.clip(self.model.link[0] + x @ self.model.link[1:], -30, 30)))
        return score, spans


def toxic_spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of words with a marginal of 0.5 or more: start, end, largest marginal."""
    out: list[tuple[int, int, float]] = []
    open_run = False
    for m, q in zip(TOKEN.finditer(text), p):
        if q >= 0.5:
            out.append((out.pop()[0] if open_run else m.start(), m.end(), float(max(q, best if open_run else 0.0))))
            best = out[-1][2]
        open_run = q >= 0.5
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def _scored(docs: DataFrame, model: Model | None, text: str) -> DataFrame:
    """The columns of ``docs`` as one, and ``toxic`` with score and spans."""
    rows = nested(docs)
    if model is None:
        none = F.array().cast("array<struct<start:int,end:int,probability:double>>")
        return rows.withColumn("toxic", F.struct(F.lit(0.0).alias("score"), none.alias("spans")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got, spans = scorer.score([t or "" for t in batch])
            out = [[{"start": a, "end": b, "probability": q} for a, b, q in s] for s in spans]
            yield pd.DataFrame({"score": got, "spans": out})

    return rows.withColumn("toxic", scored(F.col("_row").getField(text)))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with toxic_score, toxic_predicted and toxic_spans."""
    got = F.col("toxic.score")
    return unnested(
        _scored(docs, model, text), docs.columns, toxic_score=got, toxic_predicted=(got >= 0.5).cast("int"), toxic_spans=F.col("toxic.spans")
    )


def drop_toxic(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with all their columns as they are."""
    return unnested(_scored(docs, model, text).filter("toxic.score < 0.5"), docs.columns)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labels that aren't held out."""
    return train(docs, labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))))
