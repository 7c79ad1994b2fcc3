"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text: a naive Bayes model over byte trigrams of lower-cased text, hashed to 2^16 buckets
and counted over all labelled documents. As trigrams overlap, their log likelihoods
count a third.

Declared language, the address's suffix and its language-like path segment are values whose
likelihood given the language is estimated from the pages themselves: grouped sums of the
text posteriors per value, smoothed. So evidence that misleads weighs as little as it
deserves, and no table of what suffix means what is needed.

Host prior: grouped sums of the text posteriors per host, without the page's own, smoothed
by those of its domain, these by those of the suffix, these by the whole. The sums are
grouped with partial sums on the map side, so a hot host is a few rows per task.

Defined results: NULL or empty pages have no text evidence and are placed by the rest; a NULL or
odd address has no host and takes the overall prior; repeated rows are placed each; without
labelled documents there is no language and every page gets NULL; ties go to the first language by
code point; no pages give no rows; other columns are ignored. Pages are read whole.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BUCKETS = 1 << 16
OVERLAP = 3
#: Weight of the smoother distribution, in pages, at each level of the host hierarchy, and of the values.
SMOOTH_HOST, SMOOTH_VALUE = 4.0, 1.0
UNSEEN = re.compile(r"<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^<>]*>")
#: Text that is coded at once.
PART_BYTES = 1_000_000


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram, text after text, and how many each text has."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    code = (joined[:-2] | (joined[1:-1] << np.uint32(8)) | (joined[2:] << np.uint32(16))) * np.uint32(2654435761)
    sizes = np.array([len(r) for r in raw], np.int64)
    # The last two trigrams of a text reach into the next one.
    keep = np.ones(len(code), bool)
    stop = np.cumsum(sizes)
    for back in (1, 2):
        at = stop - back
        keep[at[sizes >= back]] = False
    return (code >> np.uint32(16))[keep].astype(np.int64), np.maximum(sizes - 2, 0)


def in_parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > PART_BYTES or i + 1 == len(texts):
            yield begin, i + 1
            begin, size = i + 1, 0


def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, bucket, n of a part."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            texts = rows["text"].tolist()
            into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for a, b in in_parts(texts):
                into += np.bincount(buckets(texts[a:b])[0], minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their log likelihoods (language, bucket)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # 2^16 rows per language at most
    langs = sorted(got["lang"].unique())
    n = np.full((len(langs), BUCKETS), 0.5)
    for i, one in enumerate(langs):
        own = got[got["lang"] == one]
        n[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(n) - np.log(n.sum(1, keepdims=True))


def visible(page: str) -> str:
    """The text of a page."""
    return html_.unescape(TAG.sub(" ", UNSEEN.sub(" ", page)))


def text_likelihoods(pages: DataFrame, html: str, model: np.ndarray) -> Column:
    """Log likelihood of each page's text under each language."""
    shared = pages.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def likelihoods(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for batch in batches:
            texts = [visible(p or "") for p in batch]
            out = np.zeros((len(texts), len(table)))
            for a, b in in_parts(texts):
                at, sizes = buckets(texts[a:b])
                full = np.flatnonzero(sizes)
                if len(full):
                    first = (np.cumsum(sizes) - sizes)[full]
                    for i, row in enumerate(table):
                        out[a + full, i] = np.add.reduceat(row[at].astype(float), first) / OVERLAP
            yield pd.Series(list(out))

    return likelihoods(F.col(html))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    return scaled(F.transform(logs, lambda x: F.exp(x - top)))


def scaled(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / total)


def address(url: Column) -> dict[str, Column]:
    """Host, domain, suffix and language-like path segment; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.when(F.length(host) > 0, F.regexp_replace(host, r"^www\.", ""))
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2,4})?(?:[/?#]|$)", 1))
    return {
        "host": host,
        "domain": F.substring_index(host, ".", -2),
        "suffix": F.substring_index(host, ".", -1),
        "path": F.when(F.length(path) > 0, path),
    }


def declared(html: Column) -> Column:
    """The primary language a page declares for itself: of its root element, else of its metadata."""
    root = F.regexp_extract(html, r"(?i)<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    meta = F.regexp_extract(html, r"(?i)<meta\b[^<>]*?content-language[\"']?\s+content\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.lower(F.when(F.length(root) > 0, root).when(F.length(meta) > 0, meta))


def sums(pages: DataFrame, key: str, k: int) -> DataFrame:
    """key and the summed text posteriors per language."""
    total = F.array(*[F.sum(F.col("posterior")[i]) for i in range(k)])
    return cut_lineage(pages.filter(F.col(key).isNotNull()).groupBy(key).agg(total.alias(f"{key}_sums")))


def identify(pages: DataFrame, docs: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, declared, text_lang, lang and probability per page."""
    langs, model = train(docs)
    k = len(langs)
    if not k:
        null = F.lit(None).cast("string")
        parts = address(F.col(url))
        return pages.select(
            F.col(page).alias("page_id"), parts["host"].alias("host"), declared(F.col(html)).alias("declared"),
            null.alias("text_lang"), null.alias("lang"), F.lit(None).cast("double").alias("probability"),
        )
    parts = address(F.col(url))
    rows = pages.select(
        F.col(page).alias("page_id"), *[c.alias(n) for n, c in parts.items()], declared(F.col(html)).alias("declared"),
        text_likelihoods(pages, html, model).alias("text"),
    )
    # The pages' texts are read once; all later steps work on this narrow table.
    rows = cut_lineage(rows)
    rows = rows.withColumn("posterior", softmax(F.col("text")))
    whole = rows.agg(*[F.sum(F.col("posterior")[i]) for i in range(k)]).first()
    whole = np.array([x or 0.0 for x in whole]) + SMOOTH_VALUE
    overall = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])
    none = F.array_repeat(F.lit(0.0), k)
    done = rows
    evidence = []
    for key in ("declared", "suffix", "path"):
        table = sums(rows, key, k)
        n = table.count()
        seen = table.agg(*[F.sum(F.col(f"{key}_sums")[i]) for i in range(k)]).first()
        seen = F.array(*[F.lit(float((x or 0.0) + SMOOTH_VALUE * (n + 1))) for x in seen])
        done = done.join(table, key, "left")
        own = F.coalesce(F.col(f"{key}_sums"), none)
        # Without the page's own vote; a page that doesn't say anything says nothing.
        likelihood = F.zip_with(
            F.zip_with(own, "posterior", lambda a, p: F.greatest(a - p, F.lit(0.0)) + SMOOTH_VALUE), seen, lambda a, s: F.log(a / s)
        )
        evidence.append(F.when(F.col(key).isNotNull(), likelihood).otherwise(none))
    prior = overall
    for key in ("suffix", "domain", "host"):
        if key != "suffix":
            done = done.join(sums(rows, key, k), key, "left")
        others = F.zip_with(F.coalesce(F.col(f"{key}_sums"), F.col("posterior")), "posterior", lambda a, p: F.greatest(a - p, F.lit(0.0)))
        prior = scaled(F.zip_with(others, prior, lambda a, q: a + SMOOTH_HOST * q))
        done = done.withColumn(f"{key}_prior", prior)
        prior = F.col(f"{key}_prior")
    logs = F.zip_with("text", F.transform(prior, lambda q: F.log(q)), lambda a, b: a + b)
    for e in evidence:
        logs = F.zip_with(logs, e, lambda a, b: a + b)
    done = done.withColumn("fused", softmax(logs))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return done.select(
        "page_id", "host", "declared", best(F.col("posterior")).alias("text_lang"), best(F.col("fused")).alias("lang"),
        F.array_max("fused").alias("probability"),
    )
