"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source has a weight; targets share the words of all sources by weight, and
no target exceeds ``epochs`` times its source (the excess is reshared by weight).

Schedule: the j-th slot draws the point j * golden mod 1 (a golden-ratio lattice of 2^31
points), whose place among the cumulative targets names the source; a slot's rank among
the slots of its source names the block of words it takes. The words of a source, in a
keyed random order of its documents, are cut into blocks of ``block`` words, which are
taken again from the start when they run out. The last slot of a source is cut so that
the source gives its target to the word; slots the sequence leaves short follow at the end.
:func:`mix` says what each slot takes, :func:`mixed_text` joins the blocks of text to the slots.

DataFrame functions only. No window runs over a source: ranks and word offsets are sums
over chunks (``running_start``). Only the table of sources, which is the list of weights,
is ranked in one window.

Defined results: a NULL text has no words; a NULL source is a source of its own and comes
last; repeated rows are rows of their own, counted first and laid one behind the other by
arithmetic; of rows with one id and size the order is that of a digest of the text; a long text
is cut into blocks like any other; documents without words take nothing; an empty
table gives an empty mix; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import WORD, running_start, shuffle_key, word_count

#: 2^31 points; the multiplier is 2^31 / golden ratio, made odd.
POINT_BITS = 31
GOLDEN = 1327217885
#: The unit interval is cut into 2^CELL_BITS cells, on which points meet sources.
CELL_BITS = 12
WEIGHTS = (5, 2, 1)
#: Copies of a row that one task lays out.
COPIES = 256


def cyclic_weight(rank: Column, weights=WEIGHTS) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, weight=cyclic_weight, epochs: int = 3) -> DataFrame:
    """source_rank, source, source_size, weight, target from ``sizes(source, size)``.

    Filling by weight: with the sources in order of epochs * size / weight, the ones whose cap
    lies under what the rest would get by weight are the first ones, so running sums give
    the level.
    """
    every = Window.partitionBy()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("source_rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", weight(F.col("source_rank")).cast("long")).withColumn(
        "_cap", F.col("source_size") * epochs
    )
    by_cap = every.orderBy(F.col("_cap") / F.col("weight"), "source_rank")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("_words"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("_open_weight"),
        F.coalesce(F.sum("_cap").over(earlier), F.lit(0)).alias("_given"),
    ).withColumn("_left", F.col("_words") - F.col("_given"))
    capped = F.col("_cap") * F.col("_open_weight") <= F.col("weight") * F.col("_left")
    # The first source that isn't capped sets the level for itself and all behind it.
    filled = filled.withColumn("_capped", capped).withColumn(
        "_level", F.min(F.when(~capped, F.struct(F.col("_cap") / F.col("weight"), "source_rank", "_left", "_open_weight"))).over(every)
    )
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
        F.col("weight") * F.col("_level._left") / F.col("_level._open_weight")
    )
    return filled.select("source_rank", "source", "source_size", "weight", target.alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots in order: slot, source_rank, epoch, block, words.

    ``sources(source_rank, source_size, target)``. The first ``words`` words of the block count.
    """
    give = F.floor(F.col("target") + 0.5).cast("long")
    plan = sources.filter("source_size > 0").select("source_rank", "source_size", give.alias("_give"))
    per_round = F.ceil(F.col("source_size") / block).cast("long")
    rounds = F.floor(F.col("_give") / F.col("source_size")).cast("long")
    rest = F.col("_give") - rounds * F.col("source_size")
    plan = plan.withColumns({"_blocks": per_round, "_slots": rounds * per_round + F.ceil(rest / block).cast("long")})
    order = Window.partitionBy().orderBy("source_rank")
    edge = lambda c: F.floor(F.col(c) / F.sum("_give").over(Window.partitionBy()) * 2**POINT_BITS).cast("long")
    plan = plan.withColumn("_sum", F.sum("_give").over(order)).withColumn("_past", F.col("_sum") - F.col("_give"))
    plan = cut_lineage(plan.select("*", edge("_past").alias("_lo"), edge("_sum").alias("_hi")))
    n = plan.agg(F.sum("_slots")).first()[0] or 0
    spark = sources.sparkSession
    shift = POINT_BITS - CELL_BITS
    point = (F.col("id") % 2**POINT_BITS * GOLDEN) % 2**POINT_BITS
    draws = spark.range(n).select(F.col("id").alias("slot"), point.alias("_x")).withColumn("_cell", F.shiftright("_x", shift))
    cells = plan.filter("_hi > _lo").select(
        "source_rank", "_lo", "_hi", F.explode(F.sequence(F.shiftright("_lo", shift), F.shiftright(F.col("_hi") - 1, shift))).alias("_cell")
    )
    drawn = draws.join(cells, "_cell").filter("_x >= _lo AND _x < _hi").select("slot", "source_rank", F.lit(1).cast("long").alias("_one"))
    ranked = cut_lineage(running_start(drawn, ["source_rank"], "slot", "_one", max(1, int(n).bit_length()), "_rank"))
    slots = ranked.select("slot", "source_rank", "_rank")
    made = ranked.groupBy("source_rank").agg(F.count("*").alias("_made"))
    short = plan.join(made, "source_rank", "left").select("source_rank", "_slots", F.coalesce("_made", F.lit(0)).alias("_made")).filter("_slots > _made")
    late = short.select(F.lit(n).cast("long").alias("slot"), "source_rank", F.explode(F.sequence(F.col("_made"), F.col("_slots") - 1)).alias("_rank"))
    used = slots.unionByName(late).join(plan.drop("_lo", "_hi", "_sum", "_past"), "source_rank").filter("_rank < _slots")
    epoch, at = F.floor(F.col("_rank") / F.col("_blocks")).cast("long"), F.col("_rank") % F.col("_blocks")
    begin = epoch * F.col("source_size") + at * block
    words = F.least(F.lit(block).cast("long"), F.col("source_size") - at * block, F.col("_give") - begin)
    return used.select("slot", "source_rank", epoch.alias("epoch"), at.alias("block"), words.alias("words"))


def _digest(*parts: Column) -> Column:
    """One key for rows that are equal in all parts; NULL is a value of its own."""
    held = [F.coalesce(F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("|", *held))


def _each_copy(placed: DataFrame) -> DataFrame:
    """A row per copy with ``copy`` and its own start; rows with many copies are dealt out."""
    at = lambda first, end: F.explode(F.sequence(first, end - 1)).alias("copy")
    few = placed.filter(F.col("copies") <= COPIES).select("*", at(F.lit(0).cast("long"), F.col("copies")))
    steps = placed.filter(F.col("copies") > COPIES).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("_step")
    )
    begin = F.col("_step") * COPIES
    many = steps.repartition("digest", "_step").select("*", at(begin, F.least(F.col("copies"), begin + COPIES))).drop("_step")
    return few.unionByName(many).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))


def _keyed(docs: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    columns = {"doc": F.col(doc), "source": F.col(source), "text": F.col(text)}
    return docs.select(*[c.alias(n) for n, c in columns.items()], _digest(*columns.values()).alias("digest"))


def _place(docs: DataFrame, doc: str, text: str, source: str, weight, epochs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): each different row of ``docs`` once, with its copies and the start of the first."""
    sizes = cut_lineage(
        _keyed(docs, doc, text, source)
        .select("doc", "source", "digest", word_count(F.col("text")).alias("size"))
        .groupBy("digest", "doc", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("_words", F.col("size") * F.col("copies"))
    )
    sources = cut_lineage(source_targets(sizes.select("source", F.col("_words").alias("size")), weight, epochs))
    placed = sizes.join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    placed = placed.withColumn("_key", shuffle_key(F.col("doc"), F.col("size"), seed=seed))
    # The key's upper bits are the order; enough of them that a chunk has some thousand rows.
    rows = sizes.count()
    bits = max(1, (rows // 256).bit_length())
    placed = placed.withColumn("_order", F.shiftright("_key", 60 - bits - 8))
    placed = running_start(placed, ["source_rank"], "_order", "_words", bits + 8, "start", ties=["_key", "doc", "size", "digest"])
    return cut_lineage(placed.select("doc", "size", "source", "source_rank", "source_size", "target", "start", "copies", "digest")), sources


def mix(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    weight=cyclic_weight, epochs: int = 3, block: int = 1024, seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """(documents, mix).

    ``documents``: a row per row of ``docs`` with doc, size, source, source_rank, source_size, target and
    start, its first word in the shuffled words of its source. ``mix``: slot, epoch,
    source_rank, block, doc, start, size, first (word of the document) and words, the training
    stream in order of slot and (epoch, block, start) inside it.
    """
    rows, sources = _place(docs, doc, text, source, weight, epochs, seed)
    placed = _each_copy(rows).drop("copies", "copy", "digest")
    slots = schedule(sources, block)
    last = F.col("start") + F.col("size") - 1
    pieces = placed.filter("size > 0").select(
        "doc", "source_rank", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))).alias("block"),
    )
    met = pieces.join(slots, ["source_rank", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    stream = met.select(
        "slot", "epoch", "source_rank", "block", "doc", "start", "size", (begin - F.col("start")).alias("first"), (end - begin).alias("words")
    ).filter("words > 0")
    return placed, stream


def text_blocks(docs: DataFrame, rows: DataFrame, doc: str, text: str, source: str, block: int) -> DataFrame:
    """source_rank, block, text: the shuffled words of each source in blocks, one space between words.

    A text meets its row of ``rows`` once, is split once for each copy and cut where a block ends.
    """
    texts = _keyed(docs, doc, text, source).select("digest", "text").dropDuplicates(["digest"])
    held = _each_copy(rows.filter("size > 0").join(texts, "digest"))
    start, size = F.col("start"), F.col("size")
    numbers = F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))

    def cut(words: Column) -> Column:
        def piece(b: Column) -> Column:
            first = F.greatest(start, b * block)
            n = F.least(start + size, (b + 1) * block) - first
            part = F.slice(words, (first - start + 1).cast("int"), n.cast("int"))
            return F.struct(b.alias("block"), F.array_join(part, " ").alias("text"))

        return F.transform(numbers, piece)

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    pieces = held.select("source_rank", "start", F.explode(F.flatten(F.transform(F.array(words), cut))).alias("_p"))
    return (
        pieces.select("source_rank", "start", "_p.block", "_p.text")
        .groupBy("source_rank", "block")
        .agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("_parts"))
        .select("source_rank", "block", F.array_join(F.col("_parts.text"), " ").alias("text"))
    )


def mixed_text(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    weight=cyclic_weight, epochs: int = 3, block: int = 1024, seed: str = "mix",
) -> DataFrame:
    """The mix as text: slot, epoch, source_rank, source, block, words, text.

    The training stream is the rows in order of (slot, source_rank, epoch, block); slots past the
    drawn ones share one number. A block is read again in every epoch, and cut where its source's target ends.
    """
    rows, sources = _place(docs, doc, text, source, weight, epochs, seed)
    slots = schedule(sources, block).join(sources.select("source_rank", "source"), "source_rank")
    met = slots.join(text_blocks(docs, rows, doc, text, source, block), ["source_rank", "block"])
    taken = F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("words").cast("int")), " ")
    return met.select("slot", "epoch", "source_rank", "source", "block", "words", taken.alias("text"))


def words_taken(placed: DataFrame, stream: DataFrame) -> DataFrame:
    """``placed`` with ``taken``, the words the mix takes of each document, repeats counted."""
    # A document with words is known by its source and start.
    taken = stream.groupBy("source_rank", "start").agg(F.sum("words").alias("taken"))
    full = placed.filter("size > 0").join(taken, ["source_rank", "start"], "left")
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).unionByName(none)
