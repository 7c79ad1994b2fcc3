"""Secret scans over an incremental, content-addressed ledger.

Every version of every file is addressed by the SHA-256 of its text (its blob). The
ledger holds the (blob, rule, rule version) triples that were scanned before. A scan
works on unseen triples only: one carrier row per blob brings the text, each rule that
is new for the blob runs over it once, and the findings are joined back to all paths.

DataFrame functions only. Matches come from ``regexp_extract_all`` and their places
from the lengths of what lies between them (``split`` by the same pattern), so offsets
are code points, with an exclusive end.

Defined results: a NULL text is the empty text; NULL paths are a path of their own;
repeated rows give one finding list each; an empty table gives an empty result; further
columns of ``versions`` are ignored. Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import nested, unnested


@dataclass(frozen=True)
class Rule:
    """``value`` is the group of ``pattern`` that must have ``least`` characters."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 0
    base: bool = True


#: In the order in which spans of one start are listed.
RULES = (
    Rule(
        "assign", 1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    # Runs of 32 or more are the same as the long ones among all runs.
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", base=False),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
)

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule in ``text``, in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.zip_with(
        found, F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + piece["g"]
        end = begin + F.length(piece["m"])
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        value = F.regexp_extract(piece["m"], rule.pattern, rule.value)
        keep = F.length(value) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPAN))


def new_triples(blobs: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Per blob the rules that have not seen it in their version: blob, todo(array of kinds)."""
    wanted = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
    if ledger is None:
        return blobs.select("*", F.array(*[F.lit(r.kind) for r in rules]).alias("todo"))
    seen = ledger.select("blob", "kind", "version").distinct()
    pairs = blobs.select("*", wanted.alias("rule")).select(*blobs.columns, "rule.kind", "rule.version")
    left = pairs.join(seen, ["blob", "kind", "version"], "left_anti")
    return left.groupBy(*blobs.columns).agg(F.sort_array(F.collect_set("kind")).alias("todo"))


def scan(
    versions: DataFrame, path: str, text: str, rules=RULES, ledger: DataFrame | None = None, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what is new: (paths, findings, ledger).

    ``versions`` has a row per historical version of a path. ``ledger(blob, kind,
    version)`` says what was scanned before and ``known(blob, spans)`` what was found
    then. ``paths(path, blob, spans)`` has a row per row of ``versions``; spans of an
    older version of a rule are replaced by those of the newer.
    """
    addressed = versions.select(
        F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("blob", F.sha2("text", 256))
    carriers = addressed.groupBy("blob").agg(F.min(F.struct("path")).alias("carrier"))
    todo = new_triples(carriers, rules, ledger).withColumnRenamed("blob", "_blob")
    # One text per unseen blob. The path is in the key, so copies of a hot blob spread.
    texts = addressed.join(
        todo, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("carrier.path"))
    ).select("blob", "text", "todo")
    per_rule = [
        F.when(F.array_contains("todo", r.kind), rule_spans(F.col("text"), r, i)).otherwise(F.array().cast(SPAN))
        for i, r in enumerate(rules)
    ]
    scanned = texts.select("blob", "todo", F.array_sort(F.concat(*per_rule)).alias("spans"))
    found = scanned.filter(F.size("spans") > 0).dropDuplicates(["blob"])
    if known is not None:
        older = known.select("blob", F.col("spans").alias("_old")).join(
            todo.select(F.col("_blob").alias("blob"), "todo"), "blob", "left"
        )
        kept = older.select(
            "blob",
            F.filter("_old", lambda s: ~F.array_contains(F.coalesce(F.col("todo"), F.array().cast("array<string>")), s["kind"])).alias("_old"),
        )
        found = kept.join(found.drop("todo"), "blob", "full").select(
            "blob",
            F.array_sort(
                F.concat(F.coalesce("spans", F.array().cast(SPAN)), F.coalesce("_old", F.array().cast(SPAN)))
            ).alias("spans"),
        ).filter(F.size("spans") > 0)
    else:
        found = found.drop("todo")
    # Findings are few; as a table, Spark knows their size when it chooses the join.
    found = cut_lineage(found)
    paths = addressed.select("path", "blob").join(found, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")
    )
    versions_of = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    added = todo.select(F.col("_blob").alias("blob"), F.explode("todo").alias("kind")).select(
        "blob", "kind", versions_of[F.col("kind")].alias("version")
    )
    return paths, found, added if ledger is None else ledger.select("blob", "kind", "version").unionByName(added)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: Column, spans: Column, sign: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans become one sign."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.when(fresh, F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        put = F.when(fresh, F.lit(sign)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, put).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask_secrets(docs: DataFrame, path: str = "doc_id", text: str = "text", chars: str | None = None, rules=RULES) -> DataFrame:
    """``docs`` with every finding masked; ``chars`` names a column of text lengths to keep right."""
    _, found, _ = scan(docs, path, text, rules)
    own = F.col("_row").getField(text)
    met = nested(docs).join(found, F.sha2(F.coalesce(own, F.lit("")), 256) == F.col("blob"), "left")
    masked = F.when(F.col("spans").isNotNull(), mask(own, F.col("spans"))).otherwise(own)
    changed = {text: masked}
    if chars is not None:
        changed[chars] = F.when(F.col("spans").isNotNull(), F.length(masked).cast(docs.schema[chars].dataType)).otherwise(F.col("_row").getField(chars))
    return unnested(met, docs.columns, **changed)
