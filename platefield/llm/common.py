"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SEPARATORS = " \t\n\x0b\x0c\r"

#: Rows of one window in :func:`running_start`, as a power of two.
CHUNK_BITS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of ``text``; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(*parts: Column, seed: str = "") -> Column:
    """60 uniform bits from the parts, the same in every run and engine."""
    joined = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def running_start(
    df: DataFrame, keys: Sequence[str], order: str, value: str, bits: int, out: str, ties: Sequence[str] = ()
) -> DataFrame:
    """The sum of ``value`` over the rows before each row of its group.

    ``order`` is a BIGINT in 0..2^bits-1. No window runs over a group: rows are
    summed in chunks of 2^CHUNK_BITS order values, the chunks one level up, and so on,
    so a group may hold any share of all rows. Rows that share an order value must be
    few; ``ties`` puts them in order.
    """
    keys = list(keys)
    before = [Window.unboundedPreceding, -1]
    own = lambda w: F.coalesce(F.sum(value).over(w.orderBy(order, *ties).rowsBetween(*before)), F.lit(0))
    if bits <= CHUNK_BITS:
        return df.withColumn(out, own(Window.partitionBy(*keys)))
    # Names of their own per level, as the level above is ordered by its chunk.
    chunk, upper, inside = f"_chunk{bits}", f"_upper{bits}", f"_inside{bits}"
    df = df.withColumn(chunk, F.shiftright(order, CHUNK_BITS))
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    above = running_start(sums, keys, chunk, "_sum", bits - CHUNK_BITS, upper).drop("_sum")
    within = df.withColumn(inside, own(Window.partitionBy(*keys, chunk)))
    joined = within.join(above, [*keys, chunk])
    return joined.withColumn(out, F.col(upper) + F.col(inside)).drop(chunk, upper, inside)


def nested(docs: DataFrame) -> DataFrame:
    """All columns as one, so that no name clashes with those an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unnested(df: DataFrame, columns: Sequence[str], **changed: Column) -> DataFrame:
    """The columns of ``nested`` again, with some replaced or added."""
    kept = [changed.get(c, F.col("_row").getField(c)).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(c) for c, v in changed.items() if c not in columns])
