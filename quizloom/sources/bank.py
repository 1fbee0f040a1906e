"""Reading and writing the bank: raw documents, sources, texts, snapshots, and the intake of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.functions.web import detect_kind, page_title, with_html_text

MOST_BYTES = 64 * 1024 * 1024
#: The tables of a bank, and their schemas where they are fixed.
SCHEMAS = {
    "sources": "source_id long, url string, host string, kind string, content_type string, title string, sha256 string, bytes long, fetched_at timestamp, status string, status_detail string, depth int, discovered_from long, ai_train_ok boolean, license_note string",
    "source_texts": "source_id long, text string, char_count long",
    "questions": "question_id long, type string, origin string, source_id long, difficulty string, stem string, answer string, answer_alternates array<string>, explanation string, fingerprint string, enriched boolean",
    "clues": "question_id long, ordinal int, tier string, text string",
    "options": "question_id long, label string, text string, is_correct boolean",
    "question_tags": "question_id long, tag string",
    "question_sources": "question_id long, source_id long",
    "source_tags": "source_id long, tag string",
    "users": "user_id long, name string",
    "sessions": "session_id long, user_id long, started_at string, format string, filters_json string, ended_at string",
    "attempts": "attempt_id long, session_id long, question_id long, user_id long, buzz_ordinal int, clue_count int, response string, verdict string, judged_by string, latency_ms long, created_at string",
    "review_queue": "user_id long, question_id long, interval_days double, ease double, lapses int, due_at timestamp",
    "quarantine": "quarantine_id long, source_id long, reason string, raw_text string",
    "generation_jobs": "job_id long, tag string, format string, wanted int, status string",
}
ACCOUNT_TABLES, TEXT_TABLES = ("users", "sessions", "attempts", "review_queue"), ("source_texts", "quarantine")
PRIVATE_TABLES = ("login_sessions", "login_tokens", "login_attempts", "inbox")


def read_bank(spark: SparkSession, path: str, names: list[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The tables under ``path``, with their schemas given, so that no file is read to infer one."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in names}


def read_raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, bytes) of the files under a path; those over 64 MB are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MOST_BYTES)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def register_sources(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``existing`` and the sources of ``new`` (order, url, ...) whose URL it lacks; of equal URLs in ``new`` the first."""
    first = new.groupBy("url").agg(F.min_by(F.struct(*new.columns), "order").alias("_r")).select("_r.*").drop("order")
    return existing.unionByName(first.join(existing.select("url"), "url", "left_anti"), allowMissingColumns=True)


def record_fetch(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """Sources with what was fetched (url, content_type, sha256, bytes, fetched_at, title, kind): status fetched; title and kind only where they say something."""
    got = fetches.select("url", *[F.col(c).alias(f"_{c}") for c in ("content_type", "sha256", "bytes", "fetched_at", "title", "kind")], F.lit(True).alias("_hit"))
    rows = sources.join(got, "url", "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("content_type", "sha256", "bytes", "fetched_at")}
    new |= {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in ("title", "kind")}
    return rows.withColumns(new | {"status": F.when(F.col("_hit"), "fetched").otherwise(F.col("status"))}).select(*sources.columns)


def save_text(source_texts: DataFrame, new: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_texts, sources) with the latest new text (source_id, text, at) of each source, its length, and status extracted."""
    last = new.groupBy("source_id").agg(F.max_by("text", "at").alias("text")).withColumn("char_count", F.length("text").cast("long"))
    texts = source_texts.join(last.select("source_id"), "source_id", "left_anti").unionByName(last)
    done = last.select("source_id", F.lit(True).alias("_done"))
    return texts, sources.join(done, "source_id", "left").withColumn("status", F.when(F.col("_done"), "extracted").otherwise(F.col("status"))).drop("_done")


def extract_uploads(files: DataFrame, min_chars: int = 100) -> DataFrame:
    """files(path, content, bytes) with kind, title, text, status (done or error) and detail: what can't be read is an error of its row only."""
    kind = detect_kind(F.col("path"), F.lit(None).cast("string"), F.col("content"))
    body = F.decode("content", "UTF-8")
    rows = files.withColumns({"kind": kind, "_body": F.when(kind.isin("html", "text"), body)})
    rows = rows.withColumns({"title": F.when(F.col("kind") == "html", page_title(F.col("_body"))), "_page": F.when(F.col("kind") == "html", F.col("_body"))})
    rows = with_html_text(rows.withColumnRenamed("_body", "_plain"), "_page", "_read")
    rows = rows.withColumn("text", F.when(F.col("kind") == "html", F.col("_read")).when(F.col("kind") == "text", F.col("_plain")))
    detail = (
        F.when(F.col("bytes") > MOST_BYTES, "file too large")
        .when(F.col("text").isNull(), F.concat(F.lit("unsupported kind "), "kind"))
        .when(F.length(F.trim("text")) < min_chars, "extracted text too short")
    )
    return rows.select("path", "kind", "title", "text", detail.alias("detail")).withColumn("status", F.when(F.col("detail").isNull(), "done").otherwise("error"))


def publish_snapshot(tables: dict[str, DataFrame], path: str, accounts: bool = True, texts: bool = True, mode: str = "overwrite") -> dict[str, int]:
    """Write a copy of the bank, without private tables, and without accounts or texts if so asked; returns the rows of each table."""
    gone = set(PRIVATE_TABLES) | (set() if accounts else set(ACCOUNT_TABLES)) | (set() if texts else set(TEXT_TABLES))
    counts = {}
    for name, table in tables.items():
        if name not in gone:
            table.write.mode(mode).parquet(f"{path}/{name}")
            counts[name] = table.sparkSession.read.parquet(f"{path}/{name}").count()
    return counts


def install_snapshot(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Copy a published bank to a place that holds none yet; a table that is there already raises."""
    names = list(SCHEMAS)
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{source}/{name}")
        except Exception as e:  # a snapshot may lack accounts or texts
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return publish_snapshot(found, target, mode="errorifexists")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
