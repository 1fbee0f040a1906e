"""Exact duplicates by a content sort.

Sampled splitters deal the normalised texts out by range (of their first 16 characters, then of a hash of the text), each task
sorts its range externally, with whole texts as the last key; equal texts stand next to each other there and are told apart by
comparing them whole. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A text with more than this part of all rows is hot; so there are fewer than 1,000 hot texts, whatever the input.
HOT_PART = 0.001
#: Ranges over which the copies of a hot text are spread.
HOT_SALTS = 64


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, hot_part: float = HOT_PART, keep: str = "largest") -> DataFrame:
    """One row per row of ``df``: id, keep_id (id of the row that stays), group_size, kept, text_sha256.

    ``normalise`` maps the text column to what is compared (nothing is changed if None). ``keep`` says which id stays,
    ``largest`` or ``smallest``. A null text is an empty one. Null ids never stay while their group has another; rows
    that repeat an id and its text form one group of which one row is kept. An empty table gives an empty result.
    Other columns of ``df`` play no part.

    Copies of one text may be a third of all rows. So texts with more than ``hot_part`` of the rows are found first (by
    counts of a 64-bit hash, which only steers the dealing: a collision costs balance, never correctness); their rows go
    to HOT_SALTS ranges by a hash of the id, and the totals of those ranges (under HOT_SALTS / hot_part rows) are
    merged by whole texts.
    """
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), (normalise(text) if normalise else text).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    floor = max(64, int(df.count() * hot_part))
    hot = rows.groupBy("_hash").count().where(F.col("count") > floor).select("_hash", F.lit(True).alias("_hot"))
    rows = rows.join(F.broadcast(hot), "_hash", "left").select("_id", "_text", "_hash", F.substring("_text", 1, 16).alias("_begin"), F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(HOT_SALTS)) + 1).otherwise(0).alias("_salt"))

    first = F.desc_nulls_last if keep == "largest" else F.asc_nulls_last
    best = F.max if keep == "largest" else F.min
    # Ranges begin at a text's first characters; a 64-bit hash parts texts that share them, so that the sampled splitters that come to
    # the driver stay short. Whole texts are sorted and compared behind both.
    order = ["_begin", "_hash", "_salt", "_text"]
    dealt = rows.repartitionByRange("_begin", "_hash", "_salt").sortWithinPartitions(*order, first("_id"))
    # The windows need what the sort has made: rows of one text and salt together, the best id first.
    same = Window.partitionBy(*order)
    found = dealt.select(
        "_id", "_salt", F.sha2("_text", 256).alias("text_sha256"),
        F.row_number().over(same.orderBy(first("_id"))).alias("_nth"),
        best("_id").over(same).alias("_best"), F.count(F.lit(1)).over(same).alias("_n"),
    )
    spread = dealt.where("_salt > 0").groupBy("_text").agg(best("_id").alias("_hot_best"), F.count(F.lit(1)).alias("_hot_n"))
    spread = spread.select(F.sha2("_text", 256).alias("_sha"), "_hot_best", "_hot_n")
    out = found.join(F.broadcast(spread), (F.col("_salt") > 0) & F.col("text_sha256").eqNullSafe(F.col("_sha")), "left")
    keep_id = F.when(F.col("_salt") > 0, F.col("_hot_best")).otherwise(F.col("_best"))
    return out.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("_hot_n", "_n").alias("group_size"),
        ((F.col("_nth") == 1) & F.col("_id").eqNullSafe(keep_id)).alias("kept"), "text_sha256",
    )
