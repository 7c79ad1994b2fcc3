"""License scans, conversation tries and periodic runs against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platefield.llm import license_scan, periodic_runs, prefix_trie, queries_words

DOC = "doc_id long, text string, _row string, runs int"


# --- periodic runs


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        j = q
        while j < len(words):
            if words[j] != words[j - q]:
                j += 1
                continue
            first = j - q
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            run = words[first:j]
            if len(run) >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((first, len(run), q))
    return sorted(out)


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_with_runs(rng):
    n = rng.randrange(60)
    words = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(n)]
    if n and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randrange(1, 10)
        words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
    return words


def test_runs_equal_plain_search(spark):
    rng = random.Random(3)
    texts = [" ".join(words_with_runs(rng)) for _ in range(400)]
    # Nothing, separators only, other white space within words, one word over and over, a long period.
    texts += [None, "", " \t\n", "a b ".replace(" ", " ") * 9, "x " * 500, ("p q r s t u v w " * 40).strip(), "a\x0bb\x0ca b a b a b"]
    rows = [(i % 350, t, "kept", 1) for i, t in enumerate(texts)] * 2
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = [w for w in (r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert runs == plain_runs(words) and r.collapsed == plain_collapsed(words, runs) and r._row == "kept"
    assert sum(len(r.runs) for r in got) > 300


def test_runs_at_every_place_and_period():
    # Each period at each offset against the blocks, with another text before and behind.
    for q in (*range(1, 18), 31, 32, 33):
        for shift in range(0, 40, 3):
            filler = [f"f{i}" for i in range(shift)]
            run = [f"w{i % q}" for i in range(max(6, 4 * q))]
            texts = [filler + run + ["end"], run[:-1] if q > 1 else run[:5], run]
            got = [[(r["start"], r["length"], r["period"]) for r in runs] for runs, _ in periodic_runs._search(texts)]
            assert got == [[(shift, len(run), q)], [], [(0, len(run), q)]]


def test_long_texts_take_few_steps():
    words = ["a"] * 400_000 + [f"b{i}" if i % 2 else "a" for i in range(100_000)]
    (runs, _), = periodic_runs._search([words])
    assert runs == [{"start": 0, "length": 400_001, "period": 1}]


def test_runs_of_nothing(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOC)).collect() == []


def test_tail_of_the_fixture(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 11}" for j in range(i % 37))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", F.split("text", " ").alias("words"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")
    ).withColumn("words", F.filter("words", lambda w: w != ""))
    changed = 0
    for r in df.withColumn("tail", periodic_runs.repeated_tail(F.col("words"), F.col("h"))).collect():
        h, words = zlib.crc32(str(r.doc_id).encode()), list(r.words)
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert list(r.tail) == words
    assert changed > 20


# --- license scans


def plain_spans(words, templates, threshold):
    out = []
    for label, text in templates:
        m, tokens = len(license_scan.words_of(text)), set(license_scan.words_of(text))
        if not m or not words:
            continue
        width = min(m, len(words))
        good = []
        for s in range(len(words) - width + 1):
            share = len(tokens & set(words[s : s + width])) / len(tokens)
            if share >= threshold:
                good.append((s, share))
        while good:
            n = 1
            while n < len(good) and good[n][0] - good[n - 1][0] <= width:
                n += 1
            out.append((good[0][0], good[n - 1][0] + width, label, max(c for _, c in good[:n])))
            good = good[n:]
    return sorted(out)


def test_blocks_equal_plain_search():
    rng, hits = random.Random(5), 0
    for _ in range(1500):
        some = "abcdefghij"[: rng.randrange(2, 11)]
        templates = [(f"t{i}", " ".join(rng.choice(some + "xyz") for _ in range(rng.randrange(9)))) for i in range(rng.randrange(1, 5))]
        words = [rng.choice(some + "qrstu") for _ in range(rng.randrange(60))]
        threshold = rng.choice([0.5, 0.75, 0.8, 1.0])
        # Any order of tokens gives the same blocks.
        counts = {w: rng.randrange(9) for w in some}
        index = license_scan.Index(templates, [], counts, threshold)
        got = index.spans(index.ids(words))
        assert got == plain_spans(words, templates, threshold)
        hits += len(got)
    assert hits > 1000


def test_license_scan_of_hard_texts(spark):
    notice = license_scan.TEMPLATES[1][1]
    wrapped = notice.replace(" ", "\n * ").upper()
    cut = " ".join(notice.split()[:20])
    far = "word " * 20_000
    texts = {
        1: None, 2: "", 3: "!?", 4: wrapped, 5: cut, 6: far + notice + " " + far, 7: "cc-by, CC BY; MIT License apache license",
        8: "the gnu general public licence", 9: "GNU General Public License GNU general PUBLIC license", 10: "École MIT License",
    }
    rows = [(i, t, "kept", 1) for i, t in texts.items()] * 2
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, n_words string, _row int")).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "n_words", "_row", "license_places", "license_spans"}
    for r in got:
        words = license_scan.words_of(r.text)
        assert r.n_words == len(words)
        want = plain_spans(words, license_scan.TEMPLATES, license_scan.THRESHOLD) if len(words) < 1000 else None
        spans = [(s.start, s.end, s.label, s.containment) for s in r.license_spans]
        if want is not None:
            assert spans == want
    found = {r.doc_id: r for r in got}
    labels = lambda i: {s.label for s in found[i].license_spans}
    assert "gpl-later" in labels(4) and "gpl-later" in labels(6) and not labels(5)
    (deep,) = [s for s in found[6].license_spans if s.label == "gpl-later"]
    assert 19_980 < deep.start <= 20_000 and deep.containment == 1.0
    assert [(p.label, p.at) for p in found[9].license_places] == [("gpl", 0), ("gpl", 4)]
    assert [(p.label, p.at) for p in found[7].license_places] == [("cc-by", 0), ("cc-by", 2), ("mit", 4), ("apache", 6)]
    assert not found[8].license_places and [p.at for p in found[10].license_places] == [1]


def test_license_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = license_scan.scan(some, templates=(), phrases=()).collect()
    assert (row.n_words, row.license_places, row.license_spans) == (2, [], [])
    with pytest.raises(ValueError):
        license_scan.scan(some, templates=[("x", "w " * (license_scan.MOST_TOKENS + 1))])


# --- tries


def plain_trie(conversations):
    """conversations: id -> list of (role, text)."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaf = lambda k: not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in members)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(conversations[c]) == len(key)))
        out.add((
            min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs),
            sum(len(k) == len(key) + 1 for k in below), sum(map(leaf, below)),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tries(spark, rows, **sizes):
    turns, lengths = queries_words.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, d int"))
    done = prefix_trie.trie(queries_words.cut_lineage(prefix_trie.paths(turns, lengths)), **sizes)
    got = [tuple(r[c] for c in TRIE) for r in done.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def plain_rebuilt(rows):
    own = {}
    name = lambda r, t: hashlib.md5(f"{len(r or '')}:{r or ''}{t or ''}".encode()).hexdigest()
    for c, turn, role, text, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, name(role, text), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c // 100 * 100 if c >= 0 else -(-c // 100 * 100), [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard": 8, "band": 3}, {"shard": 1, "band": 7}])
def test_trie_equals_plain_loops(spark, sizes):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(305, 320), -7, -250]:
        # A hot opening, copies, and turns of their own; some conversations are very short.
        turns = [("user", "hello")] * rng.randrange(3) + [(rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "é"])) for _ in range(rng.randrange(8))]
        for i, (role, text) in enumerate(turns):
            rows.append((c, rng.choice([i, i, None, i // 2 * 10_000 - 9]), role, text, 1))
    rows += [(None, 1, "user", "lost", 1), (77, 1, "user", "twice", 1), (77, 1, "user", "twice", 1)]
    rows += [(500, i, "user", f"deep {i // 9}", 1) for i in range(40)] + [(501, i, "user", f"deep {i // 9}", 1) for i in range(40)]
    assert tries(spark, rows, **sizes) == plain_trie(plain_rebuilt(rows))


def test_trie_of_nothing_and_of_turnless(spark):
    assert tries(spark, []) == set()
    # A conversation shorter than its h, without a first of its hundred, has no turns.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert tries(spark, [(c, 1, "user", "a", 1)]) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_parentheses_with_any_block(monkeypatch):
    rng = random.Random(1)
    for _ in range(150):
        monkeypatch.setattr(prefix_trie, "BLOCK", rng.choice([2, 3, 4, 8, 256]))
        n = rng.randrange(1, 300)
        up = [-1] + [rng.randrange(max(0, i - rng.choice([1, 3, 50])), i) for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[up[i]] + 1
        by_depth = sorted(range(n), key=lambda i: depth[i])
        place = {v: k for k, v in enumerate(by_depth)}
        up = np.array([-1 if up[i] < 0 else place[up[i]] for i in by_depth])
        depth = np.array([depth[i] for i in by_depth])
        order = prefix_trie.depth_first(up)
        own = np.array([rng.randrange(10) for _ in range(n)])
        (sums,) = prefix_trie.Parentheses(depth[order]).subtree_sums(own[order])
        want = own.copy()
        for i in range(n - 1, 0, -1):
            want[up[i]] += want[i]
        assert (sums == want[order]).all()
