"""Queries of the operators that read words, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import license_scan, periodic_runs, prefix_trie
from .common import WORD, table
from .registry import query

#: crc32 of a text of ASCII characters; the number is the reversed polynomial of the checksum.
_CRC_SQL = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(0, length({0})), lambda i: ord(({0})[i + 1])::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || range(0, 8), lambda c, d: xor(c >> 1, (c & 1) * 3988292384::BIGINT))))"""

_RUNS_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         {_CRC_SQL.format("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
sized AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g FROM split),
tail AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
tailed AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE ws END AS ws
  FROM tail),
placed AS (SELECT rid, n, unnest(ws) AS w, unnest(range(0, n)) AS i FROM tailed),
met AS (
  SELECT y.rid, y.i - x.i AS q, y.i AS j FROM placed x JOIN placed y
  ON x.rid = y.rid AND x.w = y.w AND x.i < y.i AND {periodic_runs.TURNS} * (y.i - x.i) <= y.n),
islands AS (SELECT *, j - row_number() OVER (PARTITION BY rid, q ORDER BY j) AS island FROM met),
stretches AS (
  SELECT rid, q, min(j) - q AS start, count(*) + q AS length FROM islands GROUP BY rid, q, island
  HAVING count(*) + q >= greatest({periodic_runs.LEAST}, {periodic_runs.TURNS} * q)),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.rid = s.rid AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
listed AS (
  SELECT rid, count(*) AS n_runs, first({{'start': start, 'length': length, 'period': q}} ORDER BY length DESC, start, q) AS best,
         string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY rid),
kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS collapsed FROM placed p WHERE NOT EXISTS (
    SELECT 1 FROM runs r WHERE r.rid = p.rid AND p.i >= r.start + r.q AND p.i < r.start + r.length) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM tailed LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)"""


@query("op13_runs", _RUNS_SQL)
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    tailed = docs.select("doc_id", words.alias("words"), h.alias("h")).select(
        "doc_id", F.array_join(periodic_runs.repeated_tail(F.col("words"), F.col("h")), " ").alias("text")
    )
    found = periodic_runs.periodic_runs(tailed)
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        (-F.col("_best.length")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("-1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _licenses_sql() -> str:
    quoted = lambda text: "'" + text + "'"
    listed = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    rows = []
    for i, (label, text) in enumerate(license_scan.TEMPLATES):
        words = license_scan.words_of(text)
        tokens = sorted(set(words))
        need = license_scan.needed(len(tokens), license_scan.THRESHOLD)
        rows.append(f"({i}, '{label}', {len(words)}, {need}, {listed(tokens)})")
    phrases = [f"('{label}', {listed(license_scan.words_of(p))})" for label, p in license_scan.PHRASES]
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS ws FROM documents),
sized AS (SELECT *, len(ws)::BIGINT AS n FROM split),
placed AS (SELECT rid, n, unnest(ws) AS w, unnest(range(0, n)) AS i FROM sized),
phrases(label, ps) AS (VALUES {", ".join(phrases)}),
places AS (
  SELECT s.rid, p.label, unnest(list_filter(range(0, s.n), lambda i: s.ws[i + 1:i + len(p.ps)] = p.ps)) AS pos FROM sized s, phrases p),
templates(t, label, m, need, tokens) AS (VALUES {", ".join(rows)}),
tokens AS (SELECT t, label, m, need, len(tokens) AS k, unnest(tokens) AS token FROM templates),
blocks AS (
  SELECT rid, t, label, need, k, least(m, n) AS width, token,
         unnest(range(greatest(0, i - least(m, n) + 1), least(i, greatest(1, n - m + 1) - 1) + 1)) AS s
  FROM placed JOIN tokens ON w = token),
held AS (
  SELECT rid, t, label, width, s, count(DISTINCT token) / k AS c FROM blocks GROUP BY rid, t, label, width, s, k, need HAVING count(DISTINCT token) >= need),
marked AS (SELECT *, (s - lag(s, 1, -1000000) OVER w > width)::INT AS fresh FROM held WINDOW w AS (PARTITION BY rid, t ORDER BY s)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, t ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spans AS (SELECT rid, label, min(s) AS beg, max(s) + width AS fin, max(c) AS c FROM islands GROUP BY rid, t, label, width, island),
based AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(label) AS labels FROM places GROUP BY rid),
matched AS (
  SELECT rid, list(label) AS labels, max(c) AS c,
         string_agg(label || ':' || beg || ':' || fin, ',' ORDER BY beg, fin, label, c) AS spans FROM spans GROUP BY rid)
SELECT doc_id, n AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(x.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(c, 0e0) END AS score, coalesce(spans, '') AS spans
FROM sized LEFT JOIN based b USING (rid) LEFT JOIN matched x USING (rid)"""


@query("op11_licenses", _licenses_sql())
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs)
    places = F.transform("license_places", lambda p: p["at"])
    base = F.transform("license_places", lambda p: p["label"])
    own = F.transform("license_spans", lambda s: s["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("license_spans", lambda s: s["containment"]))
    spans = F.array_join(F.transform("license_spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", "n_words", F.size("license_places").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"),
        # A phrase stands for its license in full.
        F.when(F.size("license_places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        spans.alias("spans"),
    )


_TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, role, text, name, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
        FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id AS c FROM own),
convs AS (SELECT c, c - c % 100 AS base, {_CRC_SQL.format("c::VARCHAR")} % 6 AS h FROM ids),
rebuilt AS (
  SELECT c, 0 AS part, pos, role, text FROM convs JOIN own ON own.conv_id = base AND pos < h
  UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN own ON own.conv_id = c AND pos >= h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, length(text) AS chars, md5(length(role) || ':' || role || text) AS name FROM rebuilt),
walked AS (SELECT c, d, chars, string_agg(name, '/' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS sig FROM placed),
paths AS (
  SELECT c, d, chars, sig, coalesce(lag(sig) OVER (PARTITION BY c ORDER BY d), '') AS parent, max(d) OVER (PARTITION BY c) AS total FROM walked
  UNION ALL SELECT c, 0, 0, '', NULL, coalesce((SELECT max(d) FROM placed p WHERE p.c = ids.c), 0) FROM ids),
nodes AS (
  SELECT d, sig, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
         max(total) = d AS childless, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE total = d), '')) AS ends_sha256
  FROM paths GROUP BY d, sig),
sums AS (
  SELECT p.d, p.sig, sum(n.childless::INT) AS n_leaves, sum(n.own) AS saved_tokens, count(*) FILTER (WHERE n.d = p.d + 1) AS n_children
  FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.d, p.sig)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.sig = n.sig LEFT JOIN nodes u ON u.d = n.d - 1 AND u.sig = n.parent"""


def rebuilt(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their hundred: (turns, lengths) for :func:`prefix_trie.paths`."""
    own = cut_lineage(prefix_trie.numbered_turns(messages, "conv_id", "turn", "role", "text"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    opened = sizes.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "n", base, h).join(opened, "base", "left").withColumn(
        "heads", F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    ).withColumn("total", F.col("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut_lineage(convs.select("conv_id", "base", "h", "n", "heads", "total"))
    heads = own.filter("conv_id % 100 = 0 AND pos < 5").withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "name", "chars", "total")
    # By pieces of a conversation, so that a long one is not one key.
    piece = lambda c: F.shiftright(c, prefix_trie.TURN_BITS)
    pieces = convs.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), piece(F.col("n")))))
    rest = own.withColumn("_piece", piece(F.col("pos"))).join(pieces, ["conv_id", "_piece"]).filter("pos >= h").select(
        "conv_id", (F.col("heads") + F.col("pos") - F.col("h")).alias("pos"), "name", "chars", "total"
    )
    return taken.unionByName(rest), convs.select("conv_id", "total")


@query("op12_trie", _TRIE_SQL)
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(cut_lineage(prefix_trie.paths(turns, lengths)))
