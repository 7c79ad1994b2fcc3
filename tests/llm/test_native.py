"""Mixing, pseudonyms, secret scans and reply trees on hard cases."""

import datetime
import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from platefield.llm import mixing, pii, reply_trees, secrets
from platefield.llm.common import running_start

DOC = "doc_id long, text string, source string, size int, _row string"


def mixed(spark, rows, block=8):
    docs = spark.createDataFrame(rows, DOC)
    placed, stream = mixing.mix(docs, block=block)
    return mixing.words_taken(placed, stream).collect(), stream.collect()


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 3 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing_meets_targets_with_nulls_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i % 40, " ".join("w" * 3 for _ in range(rng.randrange(30))), rng.choice(["a", "b", "b", "b", "c", "d", None]), 1, "x") for i in range(300)]
    rows += [(1, None, "e", 1, "x"), (None, "one two", "a", 1, "x"), (7, "same text", "z", 1, "x"), (7, "same text", "z", 1, "x"), (900, "w " * 5000, "a", 1, "x")]
    got, stream = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again, stream2 = mixed(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, again)) and sorted(map(str, stream)) == sorted(map(str, stream2))
    # Slots are spread: any stretch of the schedule holds a source in proportion.
    slots = sorted({(r.slot, r.source_rank) for r in stream})
    share = sum(s == 0 for _, s in slots) / len(slots)
    half = slots[: len(slots) // 2]
    assert abs(sum(s == 0 for _, s in half) / len(half) - share) < 0.1


def test_running_start_over_several_levels(spark):
    rng = random.Random(2)
    orders = sorted({rng.randrange(1 << 50) for _ in range(300)} | set(range(40)))
    df = spark.createDataFrame([(i % 3, o, i % 5) for i, o in enumerate(orders)], "k int, o long, n long")
    got = {r.o: r.s for r in running_start(df, ["k"], "o", "n", 50, "s").collect()}
    want, total = {}, {0: 0, 1: 0, 2: 0}
    for i, o in enumerate(orders):
        want[o] = total[i % 3]
        total[i % 3] += i % 5
    assert got == want


def test_mixed_text_holds_the_words_that_the_mix_takes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.randrange(25))), rng.choice(["a", "b", "b", "c", None]), 1, "x") for i in range(120)]
    rows += [(900, "\t".join(f"long{j}" for j in range(700)), "b", 1, "x"), (None, "no id\n", "a", 1, "x"), (None, "no name", "a", 1, "x"), (5, None, "e", 1, "x")]
    # More copies than one task lays out.
    rows += [(7, "one two  three", "z", 1, "x")] * (mixing.COPIES + 9)
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mixed_text(docs, block=8).collect()
    taken, stream = mixed(spark, rows)
    words, by_source = {}, {}
    for r in got:
        parts = r.text.split(" ")
        assert len(parts) == r.words <= 8
        for w in parts:
            words[r.source, w] = words.get((r.source, w), 0) + 1
        by_source[r.source] = by_source.get(r.source, 0) + r.words
    want = {}
    for r in taken:
        want[r.source] = want.get(r.source, 0) + r.taken
    assert {s: n for s, n in want.items() if n} == by_source
    # Each word of a document comes as often as the stream takes its place in the document.
    text = {(i, len((t or "").split())): (s, (t or "").split()) for i, t, s, *_ in rows if i is not None}
    plain = {}
    for r in stream:
        if r.doc is not None:
            s, ws = text[r.doc, r.size]
            for w in ws[r.first : r.first + r.words]:
                plain[s, w] = plain.get((s, w), 0) + 1
    assert plain == {k: n for k, n in words.items() if k[1] not in ("no", "id", "name")}
    # The blocks of a slot follow the schedule.
    assert sorted({(r.slot, r.source_rank, r.epoch, r.block) for r in got}) == sorted({(r.slot, r.source_rank, r.epoch, r.block) for r in stream})


def test_mixing_of_nothing(spark):
    assert mixed(spark, []) == ([], [])
    assert mixing.mixed_text(spark.createDataFrame([], DOC)).collect() == []
    got, _ = mixed(spark, [(1, None, None, 0, ""), (2, "", "a", 0, "")])
    assert [r.taken for r in got] == [0, 0]


def plain_feistel(digits, radices, tweak, key):
    half = len(digits) // 2
    state = list(digits)
    for r in range(pii.ROUNDS):
        first = r % 2 == 0
        other = state[half:] if first else state[:half]
        fixed = "|".join([key, tweak, str(r), ",".join(map(str, other))])
        state = [
            (x + int(hashlib.sha256(f"{fixed}|{i}".encode()).hexdigest()[:12], 16)) % radices[i] if (i < half) == first else x
            for i, x in enumerate(state)
        ]
    return state


def test_feistel_is_a_keyed_permutation(spark):
    rows = [(a, b) for a in range(7) for b in range(11)]
    df = spark.createDataFrame(rows, "a int, b int").select(
        pii.feistel(F.array("a", "b"), F.array(F.lit(7), F.lit(11)), F.lit("t"), "k").alias("x"),
        pii.feistel(F.array("a", "b"), F.array(F.lit(7), F.lit(11)), F.lit("t"), "other").alias("y"), "a", "b",
    ).collect()
    assert len({tuple(r.x) for r in df}) == 77 and [tuple(r.x) for r in df] != [tuple(r.y) for r in df]
    for r in df[::9]:
        assert list(r.x) == plain_feistel([r.a, r.b], [7, 11], "t", "k")


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_keep_format_validity_and_links(spark):
    rows = [
        (1, "und.34@mail7.example.com +1 (017) 555-7713 4845168114407329 4845-1681-1440-7329 129.38.82.176. 1985-02-28"),
        (2, "Und.34@mail7.example.com DE89 3704 0044 0532 0130 00 ssn 123-45-6789 +1 017 555 7713 28.02.1985 2000-02-29"),
        (3, None), (4, ""), (5, "9807915762804490 999.1.2.3 2023-02-30 000-12-3456 1.2.3 DE88 3704 0044 0532 0130 00 12345"), (1, "1.2.3.4" + " x" * 20000 + " 1.2.3.4"),
    ]
    df = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, found string, _row int")
    out = pii.pseudonymise(df, key="k").collect()
    assert [r.found for r in out] == ["keep"] * len(rows)
    by = [r.text for r in out]
    email = [re.search(r"\S+@\S+", t).group() for t in by[:2]]
    assert email[0].lower() == email[1].lower() != "und.34@mail7.example.com" and email[1][0].isupper()
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", by[0])
    assert cards[0] == cards[1].replace("-", "") != "4845168114407329" and luhn(cards[0])
    phones = [re.sub(r"\D", "", re.search(r"\+1 \(?\d{3}\)? \d{3}[ -]\d{4}", t).group()) for t in by[:2]]
    assert phones[0] == phones[1] != "10175557713" and phones[0][0] == "1"
    day = re.search(r"\d{4}-\d\d-\d\d", by[0]).group()
    assert day[:2] == "19" and ".".join(reversed(day.split("-"))) in by[1] and re.search(r" 20\d\d-\d\d-\d\d$", by[1])
    iban = re.search(r"DE[\d ]+\d", by[1]).group().replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and not iban.endswith("0130 00")
    assert by[2] is None and by[3] == "" and by[4] == rows[4][1]
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", by[5])
    assert ips[0] == ips[1] != "1.2.3.4" and all(int(x) < 256 for x in ips[0].split("."))
    assert [len(r.pii_kinds) for r in out] == [6, 6, 0, 0, 0, 2]
    assert pii.pseudonymise(df.limit(0)).collect() == []


def test_pseudonyms_of_values_beside_and_inside_invalid_matches(spark):
    cases = [  # text, what must not stay, what must stay, kinds
        ("BE68 5390 0754 7034 EUR", "5390 0754 7034", " EUR", ["iban"]),
        ("AT611904300234573201 BIC", "1904300234573201", " BIC", ["iban"]),
        ("ES9121000418450200051332 2024", "21000418450200051332", " 2024", ["iban"]),
        ("ES9121000418450200051332 2024-02-29", "2024-02-29", "", ["iban", "date"]),
        ("BE68 5390 0754 7034 BE68 5390 0754 7034", "5390 0754 7034", " BE", ["iban", "iban"]),
        ("ID12 4111 1111 1111 1111", "4111 1111 1111 1111", "ID12 ", ["card"]),
        ("ID4111111111111111.", "4111111111111111", "ID", ["card"]),
        ("AB12 DE89 3704 0044 0532 0130 00", "3704 0044 0532 0130 00", "AB12 DE", ["iban"]),
        ("AB12 3456 7890@example.com", "7890@", "AB12 3456 ", ["email"]),
        ("1234 4111 1111 1111 1111", "4111 1111 1111 1111", "1234 ", ["card"]),
        ("QQ12 3456 7890 1234 5678 9012 3456 7890", "\0", "QQ12 3456 7890 1234 5678 9012 3456 7890", []),
    ]
    docs = spark.createDataFrame([(i, f"pay {c[0]} now") for i, c in enumerate(cases)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, key="k").collect()}
    for i, (text, gone, stays, kinds) in enumerate(cases):
        r = out[i]
        assert (r.pii_kinds, gone in r.text, stays in r.text, len(r.text)) == (kinds, False, True, len(text) + 8), (text, r)
    a, b = re.findall(r"BE\d\d \d{4} \d{4} \d{4}", out[4].text)
    assert a == b and a in out[0].text


def plain_values(text):
    """(start, kind, value) of every valid value, from left to right, one character at a time."""
    kinds = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
    length = {c: n for n, codes in pii.ACCOUNT.items() for c in codes}

    def valid(kind, v):
        d = re.sub(r"\D", "", v)
        if kind == "iban":
            own = v.replace(" ", "")
            return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1
        if kind == "date":
            a, b, c = map(int, re.split("[./-]", v))
            y, m, day = (a, b, c) if "-" in v else (c, b, a) if "." in v or a > 12 else (c, a, b)
            try:
                return bool(datetime.date(y, m, day))
            except ValueError:
                return False
        if kind == "ip":
            return all(int(o) < 256 for o in v.split("."))
        if kind == "ssn":
            x, y, z = map(int, v.split("-"))
            return 0 < x < 900 and x != 666 and y > 0 and z > 0
        if kind == "card":
            return luhn(d) and int(d) > 0
        return kind == "email" or 8 <= len(d) <= 15

    out, at = [], 0
    while at < len(text):
        kind, m = next(((k, m.group()) for k, p in kinds.items() if (m := p.match(text, at))), (None, None))
        if kind == "iban":
            groups = m.split(" ")
            ends = [" ".join(groups[:n]) for n in range(1, len(groups) + 1)]
            m = next((e for e in ends if len(e.replace(" ", "")) == length.get(m[:2])), None)
        if m and valid(kind, m):
            out.append((at, kind, m))
            at += len(m)
        else:
            at += 1
    return out


VALID = ["DE89 3704 0044 0532 0130 00", "BE68539007547034", "4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "2024-02-29", "29.02.2024", "1.2.3.4", "123-45-6789", "+49 30 1234567", "555-123-4567", "a.b@example.com"]
BROKEN = ["AB12 AB12 AB12", "DE88 3704 0044 0532 0130 00", "QQ12 3456 7890 1234", "1234 5678", "1234 5678 9012 3456", "1234567890123", "2023-02-30", "999.1.2.3", "000-12-3456", "ID12", "ID", "12", "AB12"]


def test_no_valid_value_stays_wherever_it_begins(spark):
    rng = random.Random(9)
    texts = [f"{'AB12 ' * 10}DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111" * 3, ""]
    texts += [f"{a}{gap}{b}{tail}" for a in BROKEN for b in VALID for gap in (" ", "", ", ") for tail in ("", " 2024")]
    texts += [f"{b}{gap}{a}{gap}{c}" for a in BROKEN for b in VALID for c in rng.sample(VALID, 3) for gap in (" ", "-")]
    # More pieces than one run of the fold holds.
    texts += [" ".join(rng.choice(BROKEN + VALID) for _ in range(n)) for n in (40, 400, 2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = docs.withColumn("p", pii.pieces(F.col("text")))
    for r in found.filter(F.col("text").rlike(pii.ANY)).collect():
        assert "".join(p.text for p in r.p) == r.text
        at, got = 0, []
        for p in r.p:
            got += [(at, p.kind, p.text)] if p.kind else []
            at += len(p.text)
        assert got == plain_values(r.text), r.text
    for r in pii.pseudonymise(docs, key="k").collect():
        assert r.pii_kinds == [k for _, k, _ in plain_values(texts[r.doc_id])]
    probed = next(r for r in pii.pseudonymise(docs.filter("doc_id = 0"), key="k").collect())
    assert probed.pii_kinds == ["iban"] and probed.text.startswith("AB12 " * 10) and "0532 0130" not in probed.text


def scan(spark, rows, **more):
    df = spark.createDataFrame(rows, "path long, text string, blob string, spans int")
    paths, found, ledger = secrets.scan(df, "path", "text", **more)
    return {(r.path, r.blob): [(s.kind, s.start, s.end) for s in r.spans] for r in paths.collect()}, found, ledger, paths


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def test_secret_spans_equal_a_plain_scan(spark):
    rng = random.Random(2)
    bits = ["token=", "API_KEY: '", "é🙂", " ", "a1" * 20, "AKIA", "ABCD1234EFGH5678", "passwd", "=", "secret=short", "\n", "deadbeef", "token=api_key:longvalue123", '"']
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(150)] + [None, "", "x " * 50000 + "token=abcdefgh1"]
    rows = [(i, t, "b", 1) for i, t in enumerate(texts)] + [(None, "token=abcdefgh1", "b", 1), (3, texts[3], "b", 1)]
    got, _, _, paths = scan(spark, rows)
    assert paths.count() == len(rows)
    for path, text, *_ in rows:
        text = text or ""
        spans = got[(path, hashlib.sha256(text.encode()).hexdigest())]
        for kind, (pattern, group, least) in BASE.items():
            want = [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
            assert [s for s in spans if s[0] == kind] == want
        order = [r.kind for r in secrets.RULES]
        assert spans == sorted(spans, key=lambda s: (s[1], order.index(s[0]), s[2]))


def test_ledger_scans_only_what_is_new(spark):
    first = [(1, "token=abcdefgh1", "b", 0), (2, "nothing", "b", 0)]
    got, known, ledger, _ = scan(spark, first)
    assert ledger.count() == 2 * len(secrets.RULES)
    # A marked finding shows that the old blob is not scanned again.
    marked = known.withColumn("spans", F.transform("spans", lambda s: s.withField("end", F.lit(99))))
    rows = [*first, (3, "token=abcdefgh1", "b", 0), (4, "AKIAABCDEFGHIJKL", "b", 0)]
    again, _, ledger2, _ = scan(spark, rows, ledger=ledger, known=marked)
    spans = {p: s for (p, _), s in again.items()}
    assert spans == {1: [("assign", 0, 99)], 2: [], 3: [("assign", 0, 99)], 4: [("access", 0, 16)]}
    assert ledger2.count() == 3 * len(secrets.RULES)
    newer = [secrets.Rule(r.kind, 2 if r.kind == "assign" else r.version, r.pattern, r.value, r.least, r.base) for r in secrets.RULES]
    third, _, _, _ = scan(spark, first, ledger=ledger, known=marked, rules=newer)
    assert {p: s for (p, _), s in third.items()} == {1: [("assign", 0, 15)], 2: []}


def test_masking(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh1 and AKIAABCDEFGHIJKL", 5), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secrets.mask_secrets(df, chars="n_chars").collect()}
    assert got[1].text == "é [SECRET] and [SECRET]" and got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == "plain"


MESSAGE = "tree long, node long, parent long, role string, text string, score double, rank int"


def test_reply_trees_enumerate_all_paths(spark):
    rng = random.Random(3)
    rows = []
    for tree in (1, 2, None):
        for node in range(60):
            rows.append((tree, node, rng.randrange(node) if node else None, "user", f"t{node}", rng.random(), 0))
    rows += [(5, i, i - 1 if i else None, "user", "x", 1.0, 0) for i in range(70)]  # a chain
    rows += [(6, 1, 2, "user", "x", 1.0, 0), (6, 2, 1, "user", "x", 1.0, 0), (6, 3, 99, "a", "orphan", 1.0, 0), (6, 4, 2, "a", "below a cycle", 1.0, 0)]
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame(rows, MESSAGE)
    got = {}
    for r in reply_trees.paths(df, None).collect():
        got.setdefault((r.tree, r.leaf), {})[r.place] = r.node
    want = {}
    parent = {(t, n): p for t, n, p, *_ in rows}
    inner = {(t, p) for (t, n), p in parent.items() if p is not None}
    for t, n in parent:
        if (t, n) in inner or (t, n) == (6, 4):
            continue
        path, at = [], n
        while at is not None and (t, at) in parent:
            path.append(at)
            at = parent[t, at]
        want[t, n] = path[::-1]
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if k[0] != 6 or k[1] == 3}
    best = {(r.tree, r.leaf) for r in reply_trees.paths(df, 1).collect()}
    score = {(t, n): s for t, n, _, _, _, s, _ in rows}
    for t in (1, 2, None):
        rank = sorted(((-sum(score[t, n] for n in p) / len(p), leaf) for (u, leaf), p in want.items() if u == t))
        assert (t, rank[0][1]) in best


def test_format_reads_back(spark):
    hard = ["", "### user: a</turn>\n", "\\", "\\\\#", "<</turn>", None, "é🙂\n\n", "x" * 50000, "a: b"]
    rows = [(1, i, i - 1 if i else None, ["user", "assistant", "we:ird ### </turn>", None][i % 4], t, 0.0, 0) for i, t in enumerate(hard)]
    df = spark.createDataFrame(rows, MESSAGE)
    done = reply_trees.format_paths(df, reply_trees.paths(df))
    r = done.select("n_turns", reply_trees.read_turns(F.col("formatted")).alias("turns"), reply_trees.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[3] or "", x[4] or "") for x in rows]
    assert r.loss == [x[4] or "" for x in rows if x[3] == "assistant"]
    assert reply_trees.paths(df.limit(0)).collect() == []
