"""The intake queue: an append-only log of what became of each item, and the job that drains it.

Items (files and links) are never changed: each state that one passes through (pending, processing, done, error) is a row of the log, and the
latest row of an item is its state. A run first writes its claims, then does the work, then writes the results; claims carry the run's
name. So of a run that died between the two, the next one finds items that are claimed but not settled, and takes them up again, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.functions.web import url_host
from quizloom.sources.bank import MOST_BYTES, extract_uploads
from quizloom.sources.scratch import staged

LOG = "item_id string, kind string, path_or_url string, title string, status string, detail string, run string, step int"
#: Order of the rows that one run writes about an item.
STEPS = {"pending": 0, "processing": 1, "done": 2, "error": 2}
#: Endings that an upload may have.
ENDINGS = ("pdf", "docx", "txt", "html", "htm")


def enqueue(items: DataFrame, log: str, run: str) -> None:
    """Add items(kind file or url, path_or_url, title, bytes) to the queue. What can't be taken is in the log at once, as an error with its reason.

    An item is its kind and path or URL; one that is queued or settled already is not queued again.
    """
    spark = items.sparkSession
    item = F.sha2(F.concat_ws("|", "kind", "path_or_url"), 256).substr(1, 32)
    ending = F.lower(F.regexp_extract("path_or_url", r"\.([A-Za-z0-9]+)$", 1))
    reason = (
        F.when(F.col("kind") == "url", F.when(~F.coalesce(F.col("path_or_url").rlike("(?i)^https?://"), F.lit(False)), "not an http(s) URL"))
        .when(F.col("kind") == "file", F.when(~ending.isin(*ENDINGS), F.concat(F.lit("unsupported file type "), ending)).when(F.col("bytes") > MOST_BYTES, "file larger than 64 MB"))
        .otherwise("neither file nor url")
    )
    rows = items.select(item.alias("item_id"), "kind", "path_or_url", "title", F.when(reason.isNull(), "pending").otherwise("error").alias("status"), reason.alias("detail"), F.lit(run).alias("run"))
    rows = rows.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("kind", "path_or_url", "title", "status", "detail", "run")).alias("_r")).select("item_id", "_r.*")
    rows = rows.join(states(spark, log).select("item_id"), "item_id", "left_anti")
    _append(rows, log)


def _append(rows: DataFrame, log: str) -> None:
    step = F.element_at(F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair]), F.col("status"))
    rows.withColumn("step", step).select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").parquet(log)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LOG).parquet(log) if there else spark.createDataFrame([], LOG)


def states(spark: SparkSession, log: str) -> DataFrame:
    """The latest row of each item: settled states before claims before pending ones, of claims the last run's."""
    last = Window.partitionBy("item_id").orderBy(F.desc("step"), F.desc("run"))
    return read_log(spark, log).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "step")


def link_contents(links: DataFrame, pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """links(item_id, path_or_url) with content and refusal: what pages(url, html) holds for them, fetched elsewhere; hosts must be in allowed(host)."""
    hosts = allowed.select(F.lower("host").alias("_host")).distinct().withColumn("_ok", F.lit(True))
    found = pages.groupBy(F.col("url").alias("_url")).agg(F.max("html").alias("_html"))
    rows = links.withColumn("_of", F.lower(url_host(F.col("path_or_url")))).join(hosts, F.col("_of") == F.col("_host"), "left").join(found, F.col("path_or_url") == F.col("_url"), "left")
    refusal = F.when(F.col("_ok").isNull(), F.concat(F.lit("host not allowed: "), F.coalesce("_of", F.lit("")))).when(F.col("_html").isNull(), "not fetched")
    return rows.select("item_id", "path_or_url", F.col("_html").cast("binary").alias("content"), refusal.alias("refusal"))


def drain_inbox(spark: SparkSession, log: str, run: str, files: DataFrame, pages: DataFrame, allowed: DataFrame, sink: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """Settle all items that are pending, or claimed by a run that ended before it settled them; returns (item_id, status, detail) of this run.

    files(path, content) and pages(url, html) hold the bodies. Each item's text is extracted by itself, and what can't be read is an error of that
    item only. ``sink`` is given (item_id, path, kind, title, text) of those that can, and must be such that the same item twice is
    as once (written by item or run); it may return (item_id, detail). Only then the results are written. The order of runs is that of their names.
    """
    now = states(spark, log)
    # A run that has the same name as one that died is that run again.
    _append(now.where(F.col("status").isin("pending", "processing")).withColumns({"status": F.lit("processing"), "run": F.lit(run), "detail": F.lit(None).cast("string")}), log)
    mine = staged(states(spark, log).where((F.col("status") == "processing") & (F.col("run") == run)), "claims")
    bodies = mine.where("kind = 'file'").join(files.groupBy(F.col("path").alias("path_or_url")).agg(F.max("content").alias("content")), "path_or_url", "left")
    bodies = bodies.select("item_id", "path_or_url", "content", F.when(F.col("content").isNull(), "file is missing").alias("refusal"))
    bodies = bodies.unionByName(link_contents(mine.where("kind = 'url'"), pages, allowed))
    read = extract_uploads(bodies.where("refusal is null").select(F.concat_ws("|", "item_id", "path_or_url").alias("path"), "content", F.length("content").cast("long").alias("bytes")))
    read = staged(read.select(F.substring("path", 1, 32).alias("item_id"), F.substr("path", F.lit(34)).alias("path"), "kind", "title", "text", "status", "detail"), "extracted")
    told = sink(read.where("status = 'done'").select("item_id", "path", "kind", "title", "text"))
    results = read.select("item_id", "status", "detail").unionByName(bodies.where("refusal is not null").select("item_id", F.lit("error").alias("status"), F.col("refusal").alias("detail")))
    if told is not None:
        results = results.join(told.select("item_id", F.col("detail").alias("_told")), "item_id", "left").withColumn("detail", F.coalesce("detail", "_told")).drop("_told")
    results = staged(results, "results")
    _append(mine.drop("status", "detail").join(results, "item_id"), log)
    return results


def inbox_counts(spark: SparkSession, log: str) -> DataFrame:
    """How many items are in each state."""
    return states(spark, log).groupBy("status").agg(F.count(F.lit(1)).alias("items"))
