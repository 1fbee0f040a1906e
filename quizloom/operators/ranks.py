"""Dense numbers over any order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.sources.scratch import staged

#: monotonically_increasing_id() has the partition's number above these bits and the row's place in it below.
_PLACE_BITS = 33


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3, .. in the given order (names or columns).

    Sampled splitters deal the rows out by ranges of the order, each range is sorted and written to the shared folder in a
    task of its own; then a row's number is its place in its range behind the rows of all ranges before, whose counts
    are one row a range. Rows that tie are ordered by a hash of the whole row, which is the last part of the range key, so
    that a key with a third of all rows spreads over many ranges; only rows that are equal throughout stay together.
    Nulls come first unless a column of the order says otherwise. An empty table gives none.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.withColumn("_tie", tie).repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie")
    held = staged(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _PLACE_BITS)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many rows as there were ranges, so small whatever the input.
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return held.join(sizes, part == F.col("_part")).withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")
