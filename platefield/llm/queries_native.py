"""Queries of the operators that run on DataFrame functions alone, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import mixing, pii, reply_trees, secrets
from .common import WORD, table
from .registry import query

_MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_rank
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(source_rank % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM sources),
filled AS (
  SELECT *, cap / weight AS ratio,
         (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::BIGINT AS open_weight,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::BIGINT AS remaining
  FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * open_weight <= weight * remaining AS capped FROM filled),
level AS (SELECT remaining AS lr, open_weight AS lw FROM marked WHERE NOT capped ORDER BY ratio, source_rank LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE weight * lr / lw END AS target
  FROM marked LEFT JOIN level ON true),
keyed AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS give,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 15))::BIGINT AS key
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM keyed)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE
         (give // source_size) * size + greatest(0, least(start + size, give % source_size) - start) END::BIGINT AS taken
FROM placed"""


@query("op1_mixing", _MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, stream = mixing.mix(table(spark, sf_dir, "documents"))
    rows = mixing.words_taken(placed, stream)
    return rows.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def _spans_sql(name: str, pattern: str, value: int, least: int, rank: int) -> str:
    pattern = pattern.replace("'", "''")
    # A text behind the last match has no match of its own, hence one gap per match.
    return f"""
  list_filter(list_transform(range(1, len({name}_m) + 1), lambda i: {{
      'start': (list_sum(list_transform({name}_g[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({name}_m[1:i-1], lambda m: length(m))), 0))::INT,
      'rank': {rank},
      'end': (list_sum(list_transform({name}_g[1:i], lambda g: length(g))) + list_sum(list_transform({name}_m[1:i], lambda m: length(m))))::INT,
      'kind': '{name}',
      'long': length(regexp_extract({name}_m[i], '{pattern}', {value})) >= {least}}}), lambda s: s.long)"""


def _secrets_sql() -> str:
    rules = list(secrets.RULES)
    lists = ",\n".join(
        f"regexp_extract_all(t, '{q}') AS {r.kind}_m, regexp_split_to_array(t, '{q}') AS {r.kind}_g"
        for r in rules
        for q in [r.pattern.replace("'", "''")]
    )
    each = {r.kind: _spans_sql(r.kind, r.pattern, r.value, r.least, i) for i, r in enumerate(rules)}
    texts = "list_transform(list_sort({0}), lambda s: s.kind || ':' || s.start || ':' || s.end)"
    base = [r.kind for r in rules if r.base]
    return f"""
WITH found AS (SELECT doc_id, {lists} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
spans AS (SELECT doc_id, {", ".join(f"{e} AS {k}" for k, e in each.items())} FROM found)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex,
       sha256(coalesce(array_to_string({texts.format("list_concat(" + ", ".join(base) + ")")}, ','), '')) AS base_sha256,
       coalesce(array_to_string({texts.format("list_concat(" + ", ".join(each) + ")")}, ','), '') AS spans
FROM spans"""


@query("op8_secrets", _secrets_sql())
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _, _ = secrets.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < sum(r.base for r in secrets.RULES))
    return paths.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", "text", *[count(k) for k in pii.KINDS])


#: A conversation whose texts hold the template's own marks.
_MARKED = r"\### Assistant: </turn> ok"



def _escaped(name: str) -> str:
    for plain, put in reply_trees.SIGNS.items():
        name = f"replace({name}, '{plain}', '{put}')"
    return name


_CHAT_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{_MARKED}'),
escaped AS (
  SELECT *, '### ' || {_escaped("role")} || ': ' || {_escaped("text")} || '</turn>' || chr(10) AS shown
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


@query("op6_chat", _CHAT_SQL)
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_MARKED).alias("text"),
    )
    # The chain of turns is cut from its plan: row numbers must be the same wherever they are used.
    messages = cut_lineage(reply_trees.chains(own.unionByName(marked), "conv_id", "turn", "role", "text"))
    done = reply_trees.format_paths(messages, reply_trees.paths(messages))
    turns, loss = reply_trees.read_turns(F.col("formatted")), F.array_join(reply_trees.read_loss(F.col("formatted"), F.col("loss")), "")
    read = done.select("tree", "formatted", turns.alias("turns"), loss.alias("loss_text"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
