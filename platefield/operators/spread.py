"""Heavy keys of a join, cut into parts.

A key with more than 1/``share`` of the rows is heavy. There are fewer than ``share`` such keys, whatever
the rows are, so their list may be broadcast; each is cut into parts of about that many rows, and the other
side of the join is copied to the parts of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: No key and part holds much more than this part of all rows.
SHARE = 1024


def spread(rows: DataFrame, keys: list[str], share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_part``, and the heavy keys with their number of ``_parts``. Reads ``rows`` twice."""
    counts = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    most = max(1, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // share))
    heavy = counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    # Dealt by place and not by content, as rows may be equal.
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    return dealt.drop("_parts"), heavy


def copied(rows: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``rows`` once for each ``_part`` of their key."""
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return rows.join(F.broadcast(heavy), keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
