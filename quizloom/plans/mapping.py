"""The roles of the library's tables, played by the driver's generic tables; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The SQL twins, as common table expressions; each query takes those that it needs.
SQL = {
    "attempts": """attempts AS (SELECT event_id AS attempt_id, user_id, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, CAST(json_extract(props, '$.k') AS BIGINT) AS question_id,
        CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'correct' WHEN event_type = 'error' THEN 'incorrect' ELSE 'timeout' END AS verdict,
        CAST(event_id % 5 AS INT) AS buzz_ordinal, 5 AS clue_count, value AS latency, ts AS created_at FROM events)""",
    "sessions": "sessions AS (SELECT DISTINCT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, user_id, date_trunc('day', ts)::TIMESTAMP AS started_at FROM events)",
    "questions": """questions AS (SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 THEN 'mcq' ELSE 'tossup' END AS type, CASE WHEN p_partkey % 2 = 0 THEN 'official' ELSE 'generated' END AS origin,
        CASE WHEN p_size <= 12 THEN 'elementary' WHEN p_size <= 25 THEN 'middle' WHEN p_size <= 38 THEN 'high' ELSE 'open' END AS difficulty, p_name AS answer, p_name || ' of ' || p_brand AS stem, p_partkey % 4 = 0 AS enriched,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey END AS source_id FROM part)""",
    "question_tags": "question_tags AS (SELECT p_partkey AS question_id, p_type AS tag FROM part UNION SELECT p_partkey, p_brand FROM part)",
    "sources": """sources AS (SELECT d.doc_id AS source_id, d.source AS host, coalesce(l.quality, 1) = 1 AS ai_train_ok, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'error' ELSE 'extracted' END AS status,
        CASE d.doc_id % 4 WHEN 0 THEN 'studyguide' WHEN 1 THEN 'index' WHEN 2 THEN 'packet' ELSE 'exam' END AS kind, 'https://' || d.source || '.example.org/' || d.lang || '/' || d.doc_id || '.pdf' AS url,
        CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.lang || ' set ' || d.doc_id END AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "question_sources": "question_sources AS (SELECT DISTINCT doc_id % 100 AS question_id, doc_id AS source_id FROM documents)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_id() -> F.Column:
    return F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_type").isin("purchase", "click", "signup"), "correct").when(F.col("event_type") == "error", "incorrect").otherwise("timeout")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), "user_id", session_id().alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("question_id"), verdict.alias("verdict"),
        (F.col("event_id") % 5).cast("int").alias("buzz_ordinal"), F.lit(5).alias("clue_count"), F.col("value").alias("latency"), F.col("ts").alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(session_id().alias("session_id"), "user_id", F.date_trunc("day", "ts").alias("started_at")).distinct()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("question_id"), F.when(k % 3 == 0, "mcq").otherwise("tossup").alias("type"), F.when(k % 2 == 0, "official").otherwise("generated").alias("origin"),
        F.when(size <= 12, "elementary").when(size <= 25, "middle").when(size <= 38, "high").otherwise("open").alias("difficulty"), F.col("p_name").alias("answer"),
        F.concat("p_name", F.lit(" of "), "p_brand").alias("stem"), (k % 4 == 0).alias("enriched"), F.when(k % 7 != 0, k).alias("source_id"),
    )


def question_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("tag")).union(part.select("p_partkey", "p_brand")).distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    return d.select(
        n.alias("source_id"), F.col("source").alias("host"), (F.coalesce("quality", F.lit(1)) == 1).alias("ai_train_ok"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "error").otherwise("extracted").alias("status"),
        F.when(n % 4 == 0, "studyguide").when(n % 4 == 1, "index").when(n % 4 == 2, "packet").otherwise("exam").alias("kind"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), n.cast("string"), F.lit(".pdf")).alias("url"), F.when(n % 5 != 0, F.concat("lang", F.lit(" set "), n.cast("string"))).alias("title"),
    )


def question_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("question_id"), F.col("doc_id").alias("source_id")).distinct()


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()
