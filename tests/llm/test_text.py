"""Toxicity, near-duplicates, decontamination, language models, search and languages against plain loops."""

import collections
import itertools
import math
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platefield.llm import components, decontaminate, graph_ann, language_id, near_dedup, ppm, toxicity

WORDS = [a + b for a in "the on sa ri mo ta lu ke".split() for b in "ing er a o us ".split(" ")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- toxicity


def brute_marginals(classes, field):
    e = toxicity.emissions(classes, np.array([0]), np.array([len(classes) - 1]), field.emit)
    total, out = 0.0, np.zeros(len(classes))
    for y in itertools.product((0, 1), repeat=len(classes)):
        w = math.exp(sum(e[i] for i in range(len(y)) if y[i]) + sum(field.step[y[i - 1], y[i]] for i in range(1, len(y))))
        total += w
        out += w * np.array(y)
    return out / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(rng.normal(size=toxicity.FEATURES), rng.normal(size=(2, 2)))
    lengths = np.array([1, 5, 3])
    classes = rng.integers(0, len(toxicity.CLASSES) + 1, 9).astype(np.int8)
    want = np.concatenate([brute_marginals(c, field) for c in np.split(classes, np.cumsum(lengths)[:-1])])
    assert np.allclose(toxicity.marginals(classes, lengths, field), want)


def test_toxicity_on_held_out_rows_and_hard_cases(spark):
    rng = random.Random(4)
    bad = ["vile", "rotten", "filth"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(20, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(toxic)))
    rows += [(9000, None, 0.0), (9001, "", 0.0), (9002, "word " * 30000 + "vile filth", 0.0), (None, "vile rotten filth", 0.0), (5, rows[5][1], 0.0)]
    labels += [(None, 1), (77777, None), (3, 0), (3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score double")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).select("doc_id", "text", "toxic_score", "toxic_predicted", "toxic_spans").collect()
    assert len(got) == len(rows)
    truth = dict(labels[:600])
    for r in got:
        assert 0 <= r.toxic_score <= 1
        if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            assert r.toxic_predicted == truth[r.doc_id]
            if truth[r.doc_id]:
                assert {w for s in r.toxic_spans for w in r.text[s.start : s.end].split()} <= set(bad)
    by = {r.doc_id: r for r in got}
    assert by[9000].toxic_predicted == 0 and by[9001].toxic_predicted == 0 and by[9002].toxic_spans and by[None].toxic_predicted == 1
    none = toxicity.learn(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert none is None and toxicity.score(docs, none).agg(F.max("toxic_score")).first()[0] == 0
    assert toxicity.score(docs.limit(0), model).collect() == []


# --- near-duplicates


def plain_classes(texts, weights, least):
    features = near_dedup.Features(*weights)
    sets = []
    for t in texts:
        code, w, _ = features.of([t])
        sets.append(dict(zip(code.tolist(), w.tolist())))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = sum(w for k, w in a.items() if k in b)
            if (texts[i] or "") == (texts[j] or "") or a and b and both >= least * (sum(a.values()) + sum(b.values()) - both) - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    base = prose(rng, 150)
    for _ in range(60):  # one large group of near copies
        words = base.split()
        for _ in range(rng.randrange(8)):
            words[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    line = "the same line over and over again\n"
    texts += [line * 40, line * 41, line * 4000, None, "", " ", "one", "one", "one two", texts[0], texts[0] + " tail", "a b c d e", "a b c d e f"]
    rows = [(i, t, b"x") for i, t in enumerate(texts)] + [(3, texts[3], b"x"), (None, texts[4], b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node binary").repartition(5)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = plain_classes([r[1] for r in rows], near_dedup.word_weights(docs), near_dedup.SIMILARITY)
    ids = [r[0] for r in rows]
    classes = collections.defaultdict(list)
    for i, root in enumerate(want):
        classes[root].append(ids[i])
    expected = sorted((str(d), str(min([x for x in c if x is not None], default=None)), len(c)) for c in classes.values() for d in c)
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == expected
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)
    # Blocks of few members find the same classes.
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    again = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in again) == expected
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == [] and near_dedup.keep_one(docs.limit(0)).collect() == []


def test_comparing_two_texts_takes_memory_by_their_features():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near, far = base.copy(), base.copy()
    near[:20], far[:150] = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20, 150))
    weights = [np.full(300, 1.5, np.float32)] * 3
    near_dedup.similar([base, near, far], weights, 0.8)
    tracemalloc.start()
    found = near_dedup.similar([base, near, far], weights, 0.8).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [0, 0, 2] and peak < 1_000_000
    # Nothing is shared.
    assert near_dedup.similar([base[:5], far[:5]], [w[:5] for w in weights[:2]], 0.8).tolist() == [0, 1]


def test_samples_agree_as_often_as_weights_do():
    rng = np.random.default_rng(6)
    sampler = near_dedup.Sampler(5, 120)
    f, w = rng.integers(0, 1 << 62, 400, dtype=np.uint64), rng.uniform(1, 2, 400)
    g = f.copy()
    g[:60] = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    x = sampler.samples(np.r_[f, g], np.r_[w, w], np.array([400, 400]))
    both = w[60:].sum()
    assert (x[:, 0] == x[:, 1]).mean() == pytest.approx(both / (2 * w.sum() - both), abs=0.06)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(9, 9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges[:-1] for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges[:-1]:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- decontamination


def plain_distance(item, words):
    row = [0] * (len(words) + 1)  # a window may start anywhere
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_walks_meet_edited_items_in_every_class_of_lengths():
    """Before the backstop: nine of ten copies with all edits that are allowed, wherever these lie, and every other one."""
    rng, edits = random.Random(21), np.random.default_rng(21)
    items = [(i, prose(rng, n)) for i, n in enumerate([12, 15, 20, 26, 33, 41, 52, 66, 83] * 12)]
    bench = decontaminate.Benchmark(items)
    texts, truth = [], []
    for i, x in enumerate(bench.items):
        k = decontaminate.edits_allowed(len(x))
        for place in ("head", "middle", "tail", "spread"):
            for n in (0, k // 2, k):
                filler = edits.integers(1, len(bench.known) + 1, (2, 40))
                texts.append(np.concatenate([filler[0], np.maximum(decontaminate.edited(x, n, place, edits), 0), filler[1]]))
                truth.append((i, n == k))
    exact = {(t, i) for t, i, *_ in bench.matches(texts, walks=False)}
    met = {(t, i) for t, i, *_ in bench.matches(texts, backstop=False)}
    whole = {(t, i): rest for t, i, *rest in bench.matches(texts)}
    assert met <= exact == set(whole) and whole == {(t, i): rest for t, i, *rest in bench.matches(texts, walks=False)}
    for size in {len(x) for x in bench.items}:
        for most in (False, True):
            own = [(t, i) for t, (i, full) in enumerate(truth) if len(bench.items[i]) == size and full == most and (t, i) in exact]
            share = np.mean([pair in met for pair in own])
            assert len(own) > 10 and share >= (0.9 if most else 0.97)


def test_decontamination_equals_exact_search(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 6, 12, 15, 16, 20, 31, 33, 40, 59])] + [(90, None), (91, ""), (92, "...")]
    rows, truth = [], {}
    for d in range(240):
        words = prose(rng, rng.randrange(5, 150)).split()
        if d % 2:
            i, text = items[rng.randrange(10)]
            x = text.split()
            for _ in range(rng.randrange(decontaminate.edits_allowed(len(x)) + 3)):
                p = rng.randrange(len(x))
                x[p : p + rng.randrange(2)] = ["zzz"] * rng.randrange(2)
                x = x or ["zzz"]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in x]
        rows.append((d, " ".join(words), 0))
    rows += [(900, None, 0), (901, "", 0), (902, ("filler " * 20000) + items[5][1], 0), (902, ("filler " * 20000) + items[5][1], 0), (None, items[6][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for d, text, _ in rows[:240]:
        words = [w for w in map(decontaminate.plain, text.split()) if w]
        for i, t in items[:10]:
            x = t.split()
            e = plain_distance(x, words)
            if e <= decontaminate.edits_allowed(len(x)):
                want[d, i] = e
    own = {k: v for k, v in got.items() if k[0] is not None and k[0] < 240}
    assert own == want
    assert (902, 5) in got and (None, 6) in got
    kept = [r.doc_id for r in decontaminate.clean(docs, bench).collect()]
    hit = {k[0] for k in got}
    assert sorted(map(str, kept)) == sorted(str(r[0]) for r in rows if r[0] not in hit)
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("length", [20, 40, 59, 100])
def test_decontamination_finds_edits_in_one_run_anywhere(length):
    rng = random.Random(length)
    items = [(i, " ".join(f"w{i}x{rng.randrange(10**6)}" for _ in range(length))) for i in range(3)]
    k = decontaminate.edits_allowed(length)
    rows, want = [], {}
    for i, text in items:
        x = text.split()
        for at in (0, k // 2, (length - k) // 2, length - k):  # head, near it, middle, tail
            for put in ([], ["zzz"] * k):  # dropped or replaced
                d = len(rows)
                before = rng.randrange(40)
                rows.append((d, " ".join(prose(rng, before).split() + x[:at] + put + x[at + k :] + prose(rng, 30).split())))
                want[d, i] = k
        for at in (0, length // 2, length):
            d = len(rows)
            rows.append((d, prose(rng, 25) + " " + " ".join(x[:at] + ["zzz"] * k + x[at:])))
            want[d, i] = k if 0 < at < length else 0  # a run outside the item is no edit
    found = next(decontaminate.scan(iter([pd.DataFrame(rows, columns=["doc_id", "text"])]), decontaminate.Benchmark(items)))
    assert {(r.doc_id, r.item_id): r.edits for r in found.itertuples()} == want


def test_decontamination_gives_the_best_of_all_windows():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 7, 10, 15, 23])]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    texts += [" ".join(x.split()[2:]) for _, x in items[5:]] + [" ".join(x.split()[:-2]) for _, x in items[5:]]
    want = []
    for d, text in enumerate(texts):
        words = text.split()
        for i, t in items:
            x, best = t.split(), None
            k = decontaminate.edits_allowed(len(x))
            for first in range(len(words)):
                row = list(range(len(words) - first + 1))
                for a, w in enumerate(x, 1):
                    new = [a]
                    for j, y in enumerate(words[first:], 1):
                        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != y)))
                    row = new
                for n, e in enumerate(row):
                    if e <= k and (best is None or (e, first, n) < best):
                        best = (e, first, n)
            if best:
                want.append((d, i, best[1], best[2], best[0]))
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    found = next(decontaminate.scan(iter([rows]), decontaminate.Benchmark(items)))
    assert len(want) > 100 and list(found.itertuples(index=False, name=None)) == want


def test_decontamination_tries_every_item_of_a_large_class():
    rng = random.Random(4)
    names = [f"n{i}" for i in range(40)]
    items = [(i, " ".join(["which", "of", "these", "is"] + [rng.choice(names) for _ in range(26)])) for i in range(1500)]
    k = decontaminate.edits_allowed(30)
    rows = []
    for i, text in items[::7]:
        x = text.split()
        at = sorted(rng.sample(range(30), k))  # spread, so that few words in a row are intact
        rows.append((i, "before " + " ".join("zzz" if p in at else w for p, w in enumerate(x)) + " behind"))
    found = next(decontaminate.scan(iter([pd.DataFrame(rows, columns=["doc_id", "text"])]), decontaminate.Benchmark(items)))
    own = {(r.doc_id, r.item_id): r.edits for r in found.itertuples()}
    assert all(own.get((i, i), k + 1) <= k for i, _ in rows)


# --- language model


def test_ppm_equals_a_plain_trie(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["", "é "]) + prose(rng, rng.randrange(0, 30)), 0.0) for i in range(60)] + [(100, None, 0.0), (101, "", 0.0), (102, "ab " * 5000, 0.0), (None, "the the", 0.0), (4, "the the", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = ppm.score(docs, ppm.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    contexts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    words, ends = collections.Counter(), 0
    signs = lambda t: [ppm.PAD] * ppm.ORDER + list((t or "").encode()) + [ppm.END]
    name = lambda d: str(d) if d is not None else ""
    for d, t, _ in rows:
        if zlib.crc32(name(d).encode()) % 7 != 2:
            s = signs(t)
            for p in range(ppm.ORDER, len(s)):
                for j in range(ppm.ORDER + 1):
                    contexts[j][tuple(s[p - j : p])][s[p]] += 1
            words.update((t or "").encode().translate(ppm.LOWER).split())
            ends += 1
    n, v = sum(words.values()) + ends, len(words) + 1

    def logp(before, s):
        out, gone = 0.0, set()
        for j in range(ppm.ORDER, -1, -1):
            table = contexts[j].get(before[ppm.ORDER - j :])
            left = {k: c for k, c in (table or {}).items() if k not in gone}
            if left:
                total = sum(left.values())
                if s in left:
                    return out + math.log10((2 * left[s] - 1) / (2 * total))
                out += math.log10(len(left) / (2 * total))
                gone |= set(table)
        return out - math.log10(ppm.SYMBOLS - len(contexts[0][()]))

    assert sum(10 ** logp(tuple(b"the "), s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)
    want = []
    for d, t, _ in rows:
        s = signs(t)
        score = sum(logp(tuple(s[p - ppm.ORDER : p]), s[p]) for p in range(ppm.ORDER, len(s)))
        ws = (t or "").encode().translate(ppm.LOWER).split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want.append((name(d), zlib.crc32(name(d).encode()) % 7 == 2, len(ws) + 1, sum(words[w] > 0 for w in ws) + 1, n, round(base, 6), round(score, 6)))
    rounded = [(name(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    for a, b in zip(sorted(rounded), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5) and a[6] == pytest.approx(b[6], abs=1e-4)
    assert ppm.score(docs.limit(0), ppm.held_out(F.col("doc_id"))).collect() == []


# --- nearest neighbours


def test_graph_search_recall_and_hard_vectors(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000 + i, v[7].tolist()) for i in range(200)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 2.0]), (3007, [1.0, 2.5]), (None, v[3].tolist()), (5, v[5].tolist())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string").repartition(4)
    queries = df.filter("vec_id % 50 = 0 OR vec_id = 7 OR vec_id >= 3000")
    got = collections.defaultdict(list)
    for r in graph_ann.nearest(df, queries, "vec_id", "embedding", shard=600).collect():
        got[r.query_id].append((r.rank, r.id, r.score))
    good = [(i, np.array(x, float)) for i, x in dict(rows[:1700]).items()]
    ids, m = np.array([i for i, _ in good]), np.array([x for _, x in good])
    hits = total = 0
    for q in got:
        if q >= 3000:
            continue
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and q not in [i for _, i, _ in mine]
        assert all(s == pytest.approx(d[ids == i][0], abs=1e-12) for _, i, s in mine)
        hits += len(set(best) & {i for _, i, _ in mine})
        total += 10
    assert hits >= 0.95 * total
    assert [i for _, i, _ in sorted(got[7])] == list(range(2000, 2010))
    assert [(i, s) for _, i, s in got[3006]] == [(3007, 0.5)] and not {3000, 3001, 3002, 3003, 3004, 3005} & set(got)
    assert graph_ann.nearest(df.limit(0), queries, "vec_id", "embedding").collect() == []
    assert graph_ann.nearest(df, queries.limit(0), "vec_id", "embedding").collect() == []


# --- languages


def test_languages_are_fused(spark):
    rng = random.Random(11)
    own = {"en": "the and of that with".split(), "fr": "les des une dans avec".split(), "de": "und der nicht mit ein".split()}
    text = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(lang, 50), lang) for i in range(20) for lang in own] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    page = lambda lang, n, said: f"<html lang='{said}'><script>var the = 1;</script><body><p>{text(lang, n)}</p></body></html>"
    rows = [(i, f"http://h{i % 5}.site.fr/fr/{i}", page("fr", 30, "fr"), "x") for i in range(40)]
    rows += [(100 + i, f"http://g{i % 5}.site.de/x/{i}", page("de", 30, "de-DE"), "x") for i in range(40)]
    rows += [
        (200, "http://h1.site.fr/fr/x", page("fr", 0, "fr"), "x"), (201, None, None, "x"), (202, "odd", "", "x"), (203, None, page("de", 40, "fr"), "x"),
        (0, rows[0][1], rows[0][2], "x"), (204, "http://h1.site.fr/", "<p>" + text("fr", 30000), "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, suffix string")
    got = language_id.identify(pages, docs).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == "fr" for i in range(40)) and all(by[100 + i].lang == "de" and by[100 + i].declared == "de" for i in range(40))
    assert by[200].lang == "fr" and by[203].lang == "de" and by[204].lang == "fr" and by[201].host is None and by[202].host is None
    assert all(0 < r.probability <= 1 for r in got)
    none = language_id.identify(pages, docs.limit(0)).collect()
    assert len(none) == len(rows) and {r.lang for r in none} == {None}
    assert language_id.identify(pages.limit(0), docs).collect() == []


# --- the pipeline


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, rng.randrange(30, 90)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "filth"]))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    item = prose(rng, 30)
    rows += [(400, rows[1][1], "en", "s1", 0), (401, rows[2][1] + " tail", "en", "s1", 0), (402, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "s2", 0), (403, prose(rng, 40) + " token=abcdefgh1", "en", None, 0), (404, None, None, None, None), (405, "", "en", "s0", 0), (1, rows[1][1], "en", "s1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    ids = {n: {r.doc_id for r in k} for n, k in kept.items()}
    clean = {i for i in range(300) if i % 6}
    assert clean | {400, 401, 402, 403, 404, 405} <= ids["toxicity"] and not {i for i in range(0, 300, 6)} & ids["toxicity"]
    assert ids["near_dedup"] == ids["toxicity"] - {400, 401, 405} or ids["near_dedup"] == ids["toxicity"] - {400, 401, 404} and len(kept["near_dedup"]) == len(ids["near_dedup"])
    assert ids["decontamination"] == ids["near_dedup"] - {402} and ids["secrets"] == ids["decontamination"] == ids["mixing"]
    masked = {r.doc_id: r for r in kept["secrets"]}[403]
    assert "[SECRET]" in masked.text and "abcdefgh1" not in masked.text and masked.n_chars == len(masked.text)
    assert set(kept["secrets"][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    assert pd.DataFrame([r.asDict() for r in kept["mixing"]]).groupby("source", dropna=False).taken.sum().sum() > 0
    assert corpus_pipeline.run(spark, folder).count() == len(kept["mixing"])
