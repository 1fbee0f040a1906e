"""Fingerprints of documents: bottom-k sketches of their word shingles. DataFrame functions only.

A sketch is the rising array of the k smallest hashes (12 hexadecimal digits of MD5, so text order is number order) of a text's
distinct five-word shingles. Sketches of parts merge into the sketch of the whole, and from two of them the resemblance, the
containment and the number of distinct shingles are estimated; below k shingles all of that is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Hashes of a sketch: a resemblance of a half is estimated with a standard error of 0.044.
K = 128
#: Hexadecimal digits of a hash: 48 bits.
DIGITS = 12
#: Rows of one ordered run, the most runs (their splitters stand in the plan), and rows drawn for each splitter.
RUN_ROWS, MOST_RUNS, DRAWN = 2048, 4096, 16
_SPACE = "\t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z as a-z; of a null text none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _SPACE, _LOWER + " " * len(_SPACE))
    return F.array_remove(F.split(plain, " "), "")


def sketch_of_words(found: Column, k: int = K, width: int = 5) -> Column:
    """The sketch of an array of words: its distinct shingles of ``width`` words, or the whole sequence where there are fewer; of no words none."""
    n = F.size(found)
    places = F.when(n > width, F.sequence(F.lit(1), n - (width - 1))).when(n > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.substring(F.md5(F.array_join(F.slice(found, i, width), " ").cast("binary")), 1, DIGITS))
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The number of distinct shingles that a sketch stands for: (k - 1) over the part of the hash range below its k-th hash, or its size below k."""
    part = (F.conv(F.element_at(sketch, k), 16, 10).cast("double") + 1) / F.lit(float(16**DIGITS))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / part)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard likeness: the part of the k smallest of both that both have. Two empty sketches are alike, an empty and another not."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(shared / F.size(least))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The part of a's shingles that b has, at most 1; of an empty a all."""
    likeness, n = resemblance(a, b, k), distinct_shingles(a, k)
    shared = likeness / (1 + likeness) * (n + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / n))


def packed(sketch: Column) -> Column:
    """A sketch as one string; equal sketches give equal strings."""
    return F.array_join(sketch, "")


def unpacked(fingerprint: Column) -> Column:
    return F.filter(F.split(fingerprint, f"(?<=\\G.{{{DIGITS}}})"), lambda x: x != "")


def fingerprints(df: DataFrame, text_col: str = "text", k: int = K, width: int = 5) -> DataFrame:
    """``df`` with ``_words`` (how many) and ``_sketch`` of each whole text. A null text is empty and has no hash. One pass, no shuffle.

    A text's words and shingles stand in its task's memory, some 150 bytes a word.
    """
    return df.withColumn("_found", words(F.col(text_col))).withColumn("_words", F.size("_found")).withColumn("_sketch", sketch_of_words(F.col("_found"), k, width)).drop("_found")


def merged(parts: DataFrame, by: str, sketch_col: str = "_sketch", k: int = K) -> DataFrame:
    """(``by``, ``_sketch``): the sketch of all parts with the same key (null is a key), as if their shingles had been sketched at once.

    Hashes are made distinct before the shuffle, and each task passes on the k smallest of a key only, so a key with a third of
    all parts costs no task more than k hashes from each other.
    """
    least = Window.partitionBy(by).orderBy("_hash")
    hashes = parts.select(by, F.explode(sketch_col).alias("_hash")).distinct().withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") <= k)
    found = hashes.groupBy(by).agg(F.array_sort(F.collect_list("_hash")).alias("_sketch"))
    keys = parts.select(F.col(by).alias("_by")).distinct()
    none = F.array().cast("array<string>")
    return keys.join(found, F.col("_by").eqNullSafe(F.col(by)), "left").select(F.col("_by").alias(by), F.coalesce("_sketch", none).alias("_sketch"))


def _run(keys: DataFrame, rows: int, run_rows: int) -> Column:
    """The number of the run that a row's (_id, _tie) falls in: how many of the splitters, drawn as a bounded sample, are at or below it."""
    n = max(1, min(MOST_RUNS, rows // run_rows))
    drawn = keys.sample(min(1.0, n * DRAWN / rows), seed=7).orderBy("_id", "_tie").collect() if n > 1 else []
    cuts = list(dict.fromkeys((r["_id"], r["_tie"]) for r in drawn[DRAWN // 2 :: max(1, len(drawn) // n)]))
    if not cuts:
        return F.lit(0)
    kind = keys.schema["_id"].dataType
    splitters = [F.struct(F.lit(i).cast(kind).alias("i"), F.lit(t).cast("long").alias("t")) for i, t in cuts]
    # Two levels, so that a key meets some 2 * sqrt(n) splitters and not all.
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [F.array(*splitters[at : at + step]) for at in range(0, len(splitters), step)]
    key = F.struct(F.col("_id").alias("i"), F.col("_tie").alias("t"))
    above = F.size(F.filter(F.array(*[F.element_at(b, 1) for b in blocks]), lambda c: c <= key))
    inside = F.size(F.filter(F.element_at(F.array(*blocks), F.greatest(above, F.lit(1))), lambda c: c <= key))
    return F.when(above == 0, F.lit(0)).otherwise((above - 1) * step + inside)


def ordered_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS) -> tuple[DataFrame, WindowSpec]:
    """Rows (_id, _text, _guest) and the window in which the row behind each, by descending id, is its lead(); the last row is followed by the first.

    Nulls come last; rows of one id are ordered by a hash of their text, then the text, descending. A single row follows itself.
    Sampled splitters part the order into runs, each sorted in a task of its own, so texts are shuffled once. The first row
    of each run also stands, as a guest, behind the end of the run before it; guests are to be dropped after lead().
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    rows = rows.withColumn("_run", _run(rows.select("_id", "_tie"), df.count(), run_rows).cast("int"))
    # At most MOST_RUNS rows: each run's first key, and the run that it closes (the one of the next greater ids; the last run for the first of all).
    firsts = sorted((r["_run"], *r["top"]) for r in rows.groupBy("_run").agg(F.max(F.struct("_id", "_tie")).alias("top")).collect())
    hosts = [(run, i, t, firsts[(k + 1) % len(firsts)][0]) for k, (run, i, t) in enumerate(firsts)]
    kind = rows.schema["_id"].dataType.simpleString()
    hosts = spark.createDataFrame(hosts, f"_first int, _first_id {kind}, _first_tie long, _host int")
    first = (F.col("_run") == F.col("_first")) & F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_tie") == F.col("_first_tie"))
    own = F.struct(F.col("_run").alias("run"), F.lit(0).alias("guest"))
    places = F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_host").alias("run"), F.lit(1).alias("guest"))))
    placed = rows.join(F.broadcast(hosts), first, "left").select("_id", "_text", "_tie", F.explode(places).alias("_at"))
    placed = placed.select("_id", "_text", "_tie", F.col("_at.run").alias("_run"), F.col("_at.guest").alias("_guest")).repartition("_run")
    return placed, Window.partitionBy("_run").orderBy(F.asc("_guest"), F.desc_nulls_last("_id"), F.desc("_tie"), F.desc("_text"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = 5) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the row's own but for its last floor(n_chars / 2) characters, which give way to as many first ones (or all)
    of the next text in descending order of ids. ``near_edited`` and ``near_next`` are the resemblances of the row's sketch to
    that of its edited text and to the next row's. A null text is empty; an empty text's fingerprint is ''. Rows that repeat
    give a row each, see ordered_runs() for ties; an empty table gives none. Other columns of ``df`` play no part.
    """
    placed, order = ordered_runs(df, id_col, text_col)
    rows = fingerprints(placed, "_text", k, width)
    rows = rows.withColumn("_next", F.lead("_text").over(order)).withColumn("_next_sketch", F.lead("_sketch").over(order)).where("_guest = 0")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("_id", n.cast("long").alias("n_chars"), "_sketch", "_next_sketch", F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)).alias("_text"))
    rows = fingerprints(rows.withColumnRenamed("_sketch", "_own"), "_text", k, width)
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_text", 256).alias("edited_sha256"), packed(F.col("_own")).alias("fingerprint"), packed(F.col("_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_sketch"), k).alias("near_edited"), resemblance(F.col("_own"), F.col("_next_sketch"), k).alias("near_next"),
    )
