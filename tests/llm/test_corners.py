"""Empty tables, clashing names, ties and repeats over all operators; languages against plain loops."""

import collections
import math
import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from platefield.llm import components, graph_ann, language_id, pii, ppm, queries, reply_trees, secrets

from .test_text import prose

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn int, role string, text string",
}
#: Names that operators give to columns of their own.
CLASHES = "_row node root class_id bucket block n score spans toxic_score toxic_predicted size taken words item id chunk a b text_1".split()


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nothing")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("key", sorted({*queries.QUERIES, "pipeline"}))
def test_empty_tables(spark, nothing, key):
    got = entry.queries()[key](spark, nothing).collect()
    # One conversation is made up.
    assert len(got) == (key == "op6_chat")


def test_pipeline_with_clashing_names(spark, tmp_path):
    rng = random.Random(21)
    texts = [prose(rng, 40) for _ in range(40)]
    item = prose(rng, 25)
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[3], "en", "s0", 1), (51, f"{prose(rng, 9)} {item} {prose(rng, 9)}", "en", "s1", 1), (52, None, None, None, None), (None, prose(rng, 30), "en", "s0", 1)]
    rows += [rows[5], (53, prose(rng, 20) + " token=abcdefgh1", "en", "s1", 1)]
    plain = spark.createDataFrame(rows, TABLES["documents"])
    wide = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    spark.createDataFrame([(i, 1, 0) for i in range(40)], TABLES["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], TABLES["benchmark"]).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns, name
        want = stage(spark, plain, str(tmp_path))
        by = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
        mine, theirs = sorted(got.collect(), key=by), sorted(want.collect(), key=by)
        assert [tuple(r)[:5] for r in mine] == [tuple(r) for r in theirs], name
        assert {tuple(r)[5:] for r in mine} == {tuple(range(len(CLASHES)))}, name
        ids = [r.doc_id for r in mine]
        assert len(ids) == {"toxicity": 46, "near_dedup": 44, "decontamination": 45, "secrets": 46}[name]


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(3, 3), (1, 2), (2, 1), (None, 5), (6, None), (2, 9)], "a long, b long")
    assert sorted(tuple(r) for r in components.components(edges).collect()) == [(1, 1), (2, 1), (9, 1)]
    assert components.components(edges.limit(0)).collect() == []


def test_secrets_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, spans string")
    paths, known, ledger = secrets.scan(docs, "doc_id", "text")
    assert paths.count() == known.count() == ledger.count() == 0
    assert secrets.mask_secrets(docs).collect() == []


def test_chains_with_null_conversation_and_equal_turns(spark):
    turns = [(None, 1, "b", "y"), (None, 1, "b", "x"), (None, None, "a", None), (4, 2, "a", "z"), (4, 2, "a", "z")]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = sorted((r.tree or 0, r.node, r.parent, r.text) for r in reply_trees.chains(rows, "conv_id", "turn", "role", "text").collect())
    assert got == [(0, 0, None, None), (0, 1, 0, "x"), (0, 2, 1, "y"), (4, 0, None, "z"), (4, 1, 0, "z")]
    assert reply_trees.chains(rows.limit(0), "conv_id", "turn", "role", "text").collect() == []


def test_search_ties_at_the_last_rank_across_shards(spark):
    """Thirty points as near as each other, in several shards: the smallest ids are the ones found."""
    rows = [(0, [0.0] * 31 + [1e-9])] + [(k + 1, [1.0 if j == k else 0.0 for j in range(31)] + [0.0]) for k in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = graph_ann.nearest(vectors, vectors.where("vec_id = 0"), "vec_id", "embedding", shard=8).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.rank)] == list(range(1, 11))
    assert len({r.score for r in found}) == 1


def test_repeated_rows_are_scored_each(spark):
    rows = [(7, "one two")] * 50 + [(None, "one two")] * 50 + [(8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in ppm.score(docs, F.lit(False)).collect():
        got[r.doc_id].append((r.score, r.base_score, r.n_tokens))
    assert {k: (len(v), len(set(v))) for k, v in got.items()} == {7: (50, 1), None: (50, 1), 8: (2, 1)}
    assert got[7][0] == got[None][0]
    done = pii.pseudonymise(docs.withColumn("text", F.when(F.col("doc_id") == 7, "192.168.7.9 on 2001-02-03").otherwise(F.col("text"))))
    texts = [r.text for r in done.where("doc_id = 7").collect()]
    assert len(texts) == 50 and len(set(texts)) == 1 and done.count() == 102


# --- languages


def plain_languages(pages, docs):
    """(text_lang, lang, probability) of each page; pages are (url, visible text, declared language)."""

    def grams(text):
        raw = text.lower().encode()
        return [((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 2)]

    def scaled(values):
        return [v / sum(values) for v in values]

    def softmax(logs):
        return scaled([math.exp(x - max(logs)) for x in logs])

    counts = collections.defaultdict(collections.Counter)
    for text, lang in docs:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
    langs = sorted(counts)
    total = {g: sum(counts[g].values()) + 0.5 * 65536 for g in langs}
    logs = [[sum(math.log((counts[g][b] + 0.5) / total[g]) for b in grams(text)) / 3 for g in langs] for _, text, _ in pages]
    posterior = [softmax(x) for x in logs]
    facts = []
    for url, _, said in pages:
        host = urlsplit(url).hostname if url else None
        host = host[4:] if host and host.startswith("www.") else host
        first = urlsplit(url).path.split("/")[1].lower() if host else ""
        path = first[:2] if len(first) == 2 or len(first) in (5, 6, 7) and first[2] in "-_" else None
        dots = host.split(".") if host else []
        facts.append({"host": host, "domain": ".".join(dots[-2:]) or None, "suffix": dots[-1] if dots else None, "path": path, "declared": said})
    sums = {
        key: {
            value: [sum(p[i] for p, f in zip(posterior, facts) if f[key] == value) for i in range(len(langs))]
            for value in {f[key] for f in facts} - {None}
        }
        for key in facts[0]
    } if facts else {}
    overall = scaled([sum(p[i] for p in posterior) + 1 for i in range(len(langs))])
    out = []
    for text, own, fact in zip(logs, posterior, facts):
        fused, prior = list(text), overall
        for key in ("suffix", "domain", "host"):
            others = [max(a - p, 0) for a, p in zip(sums[key][fact[key]], own)] if fact[key] is not None else [0] * len(langs)
            prior = scaled([a + 4 * q for a, q in zip(others, prior)])
        fused = [x + math.log(q) for x, q in zip(fused, prior)]
        for key in ("declared", "suffix", "path"):
            if fact[key] is not None:
                every = [sum(v[i] for v in sums[key].values()) + len(sums[key]) + 1 for i in range(len(langs))]
                fused = [x + math.log((max(a - p, 0) + 1) / s) for x, a, p, s in zip(fused, sums[key][fact[key]], own, every)]
        fused = softmax(fused)
        out.append((langs[own.index(max(own))], langs[fused.index(max(fused))], max(fused)))
    return out


def test_languages_equal_plain_loops(spark):
    rng = random.Random(31)
    own = {"en": "the and of that with".split(), "fr": "les des une dans avec".split(), "de": "und der nicht mit ein".split()}
    text = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    docs = [(text(lang, 30), lang) for lang in own for _ in range(8)] + [(None, "en"), ("x", None), ("", "fr")]
    pages = []
    for i in range(120):
        lang = rng.choice(list(own))
        host = rng.choice([f"h{i % 4}.site.{lang}", "www.shop.com", "shop.com", "a.b.co.fr"])
        url = f"https://{host}/{rng.choice([lang, 'de-AT', 'page', ''])}/{i}"
        pages.append((url, text(rng.choice([lang, "en"]), rng.randrange(0, 5)), rng.choice([lang, "en", "xx", None])))
    pages += [(None, "", None), (None, "und der", "fr"), ("http://solo.org/", "", None), pages[0], pages[0]]
    page = lambda text, said: f"<html{f' lang={chr(34)}{said}{chr(34)}' if said else ''}><body><script>the and</script>{text}</body></html>"
    rows = [(i, url, page(t, said), "x") for i, (url, t, said) in enumerate(pages)]
    got = language_id.identify(
        spark.createDataFrame(rows, "page_id long, url string, html string, posterior string"),
        spark.createDataFrame(docs, "text string, lang string"),
    ).collect()
    # Tags become blanks, which are text.
    want = plain_languages([(u, f"   {t}  ", s) for u, t, s in pages], docs)
    assert len(got) == len(rows)
    for r in got:
        text_lang, lang, probability = want[r.page_id]
        assert r.probability == pytest.approx(probability, abs=1e-4)
        assert (r.text_lang, r.lang) == (text_lang, lang)
