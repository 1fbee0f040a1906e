"""Which short strings stand in which texts, by an equi-join on rare runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a run. Needles below it are met by runs of their own length.
RUN = 3


def _runs(text: Column, length: int) -> Column:
    """The distinct runs of so many characters."""
    last = F.length(text) - (length - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, needles: DataFrame, text_col: str, needle_col: str) -> DataFrame:
    """``texts`` with ``needle_col``: a row for each text and each distinct needle that it contains, in any case.

    A needle is keyed by the run of RUN characters in it that fewest texts have, so a frequent word costs nothing unless all its
    runs are frequent; texts give their runs that are keys, equal ones meet, and what meets is verified whole. No text is held
    against all needles. Null texts and needles, and empty needles, match nothing. Needles may be as many as they like.
    """
    needle = needles.select(F.col(needle_col).alias("_needle")).distinct().withColumn("_low", F.lower("_needle")).where("_low != ''")
    held = texts.withColumn("_text", F.lower(text_col)).where(F.col("_text").isNotNull())
    long_ = needle.where(F.length("_low") >= RUN)
    asked = long_.select("_needle", "_low", F.explode(_runs(F.col("_low"), RUN)).alias("_run"))
    wanted = asked.select("_run").distinct()
    counts = held.select(F.explode(_runs(F.col("_text"), RUN)).alias("_run")).groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).join(wanted, "_run", "left_semi")
    # A run that no text has rules its needle out.
    key = asked.join(counts, "_run", "left").groupBy("_needle", "_low").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), F.col("_run"))).alias("_run"), F.min(F.coalesce("_n", F.lit(0))).alias("_n")).where("_n > 0").drop("_n")
    met = held.withColumn("_run", F.explode(_runs(F.col("_text"), RUN))).join(key, "_run").where(F.contains("_text", "_low"))
    out = met.drop("_run")
    for length in range(1, RUN):
        short = needle.where(F.length("_low") == length)
        out = out.unionByName(held.withColumn("_low", F.explode(_runs(F.col("_text"), length))).join(short, "_low").select(*out.columns))
    return out.drop("_text", "_low").withColumnRenamed("_needle", needle_col)
