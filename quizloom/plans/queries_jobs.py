"""Registered queries over the journal, the bank's upkeep and the streaming jobs, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.functions.web import url_host
from quizloom.operators import grading, journal, parse
from quizloom.plans.mapping import attempts, question_tags, questions, sessions, sources, table, with_
from quizloom.plans.queries_corpus import _html_sql
from quizloom.plans.queries_practice import _FOLD, _RECURSIVE
from quizloom.sources import bank
from quizloom.sources.scratch import scratch_folder, staged
from quizloom.streaming import inbox, jobs
from quizloom.streaming.state import lockouts, state_on_disk

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Journal ----------------------------------------------------------------------------------------------------------------


def journal_events(spark, d):
    """The practice of ``events`` as journal lines: a session line per user and day, an attempt line per event, and a malformed line per user; sign-ups are attempts at questions that the bank has no longer."""
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyyMMdd").cast("long")
    session = F.col("user_id") * 100_000_000 + day
    opened = e.select(session.alias("sessionId"), F.col("user_id").alias("userId"), F.concat(F.lit("user "), (F.col("user_id") % 120).cast("string")).alias("userName"), F.date_format("ts", "yyyy-MM-dd").alias("startedAt")).distinct()
    # What explode() gives is not written out again in filters on it, below a shuffle too: each line is written once.
    line = lambda event: F.explode(F.array(F.to_json(event))).alias("value")
    opened = opened.select(line(F.struct(F.lit("session").alias("kind"), "sessionId", "userId", "userName", F.lit("tossup").alias("format"), F.lit("official").alias("origin"), F.struct(F.array(F.lit("t")).alias("tags"), F.lit("mixed").alias("mode")).alias("filters"), "startedAt")))
    verdict = F.when(F.col("event_type").isin("purchase", "click", "signup"), "correct").otherwise("incorrect")
    # One task may read the whole file; lines are written and parsed by all of them.
    done = e.select("event_id", "user_id", "ts", "event_type", "props").repartition("event_id").select(line(F.struct(F.lit("attempt").alias("kind"), F.col("event_id").alias("attemptId"), session.alias("sessionId"), F.col("user_id").alias("userId"), (F.get_json_object("props", "$.k").cast("long") + F.when(F.col("event_type") == "signup", 1_000_000_000).otherwise(0)).alias("questionId"), verdict.alias("verdict"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("createdAt"))))
    broken = e.select("user_id").distinct().select(F.concat(F.lit('{"kind":"attempt","attemptId":'), F.col("user_id").cast("string")).alias("value"))
    blank = broken.select(F.lit("  ").alias("value"))
    return journal.parse_journal(opened.union(done).union(broken).union(blank))


def empty_tables(spark):
    held = {n: spark.createDataFrame([], bank.SCHEMAS[n]) for n in ("users", "sessions", "attempts")}
    return held["users"], held["sessions"], held["attempts"]


@query("SELECT 'session' AS kind, count(DISTINCT (user_id, ts::DATE)) AS events FROM events UNION ALL SELECT 'attempt', count(*) FROM events UNION ALL SELECT 'malformed', count(DISTINCT user_id) FROM events")
def journal_stats(spark, d):
    return journal.journal_stats(journal_events(spark, d))


@query("SELECT user_id AS journal_user, CAST(dense_rank() OVER (ORDER BY 'user ' || (user_id % 120)) AS BIGINT) AS user_id, 'user ' || (user_id % 120) AS name, true AS created FROM (SELECT DISTINCT user_id FROM events)")
def resolve_users(spark, d):
    return journal.resolve_users(journal_events(spark, d), empty_tables(spark)[0])


_REPLAY = """WITH a AS (SELECT 'user ' || (user_id % 120) AS u, ts::DATE AS day, CAST(json_extract(props, '$.k') AS BIGINT) + CASE WHEN event_type = 'signup' THEN 1000000000 ELSE 0 END AS q, date_trunc('second', ts) AS t FROM events)"""


@query(
    _REPLAY
    + """ SELECT (SELECT count(*) FROM (SELECT DISTINCT u, day, q, t FROM a WHERE q IN (SELECT p_partkey FROM part))) AS attempts_added, (SELECT count(*) FROM a WHERE q IN (SELECT p_partkey FROM part)) - (SELECT count(*) FROM (SELECT DISTINCT u, day, q, t FROM a WHERE q IN (SELECT p_partkey FROM part))) AS attempts_skipped,
    (SELECT count(*) FROM a WHERE q NOT IN (SELECT p_partkey FROM part)) AS attempts_orphan, (SELECT count(DISTINCT (u, day)) FROM a) AS sessions_added, 0 AS sessions_skipped, (SELECT count(DISTINCT u) FROM a) AS users_added, (SELECT count(DISTINCT user_id) FROM events) AS malformed, 0 AS ended,
    (SELECT count(*) FROM (SELECT arg_max(v, t) AS last FROM (SELECT u, q, t, arg_min(event_type IN ('purchase', 'click', 'signup'), event_id) AS v FROM (SELECT *, 'user ' || (user_id % 120) AS u, CAST(json_extract(props, '$.k') AS BIGINT) + CASE WHEN event_type = 'signup' THEN 1000000000 ELSE 0 END AS q, date_trunc('second', ts) AS t FROM events)
      WHERE q IN (SELECT p_partkey FROM part) GROUP BY u, q, t) GROUP BY u, q) WHERE NOT last) AS queued"""
)
def restore_report(spark, d):
    return journal.restore(journal_events(spark, d), *empty_tables(spark), questions(spark, d))["report"]


@query(
    _REPLAY
    + """ SELECT 0 AS attempts_added, (SELECT count(*) FROM a WHERE q IN (SELECT p_partkey FROM part)) AS attempts_skipped, (SELECT count(*) FROM a WHERE q NOT IN (SELECT p_partkey FROM part)) AS attempts_orphan, 0 AS sessions_added, (SELECT count(DISTINCT (u, day)) FROM a) AS sessions_skipped, 0 AS users_added,
    (SELECT count(DISTINCT user_id) FROM events) AS malformed, 0 AS ended, 0 AS queued"""
)
def restore_again(spark, d):
    """A second replay into the tables that a first one made: it adds nothing."""
    events, q = staged(journal_events(spark, d).drop("line"), "journal"), questions(spark, d)
    first = journal.restore(events, *empty_tables(spark), q)
    held = [staged(first[n], n) for n in ("users", "sessions", "attempts")]
    return journal.restore(events, *held, q, staged(first["review_queue"], "review_queue"))["report"]


@query("SELECT 'sessions' AS name, count(DISTINCT (user_id, ts::DATE)) AS journal, count(DISTINCT (user_id, ts::DATE)) AS tables FROM events UNION ALL SELECT 'attempts', count(*), count(*) FROM events")
def history_diff(spark, d):
    return journal.history_diff(journal_events(spark, d), sessions(spark, d), attempts(spark, d))


@query("SELECT user_id, count(DISTINCT ts::DATE) AS sessions, count(*) AS attempts FROM events GROUP BY 1")
def history_by_profile(spark, d):
    held = sessions(spark, d)
    return journal.history_by_profile(held.select("user_id").distinct(), held, attempts(spark, d).drop("user_id"))


@query("SELECT 'user ' || (user_id % 120) AS profile, strftime(ts, '%Y-%m-%d') AS started_at, count(DISTINCT user_id) AS journal_sessions FROM events GROUP BY 1, 2")
def resolve_sessions(spark, d):
    """How many of the journal's sessions come to be one: same profile, day, format and filters."""
    events, (users, held, _) = staged(journal_events(spark, d).where("kind = 'session'").drop("line"), "sessions"), empty_tables(spark)
    people = staged(journal.resolve_users(events, users), "people")
    mapped = journal.resolve_sessions(events, held, people)
    names = people.select("user_id", F.col("name").alias("profile")).distinct()
    return mapped.join(names, "user_id").groupBy("profile", "started_at", "session_id").agg(F.count(F.lit(1)).alias("journal_sessions")).drop("session_id")


@query(
    _REPLAY
    + """, k AS (SELECT *, q NOT IN (SELECT p_partkey FROM part) AS lost FROM a), n AS (SELECT u, day, q, t, count(*) AS n FROM k WHERE NOT lost GROUP BY ALL)
    SELECT 'added' AS outcome, count(*) AS attempts FROM n UNION ALL SELECT 'skipped', sum(n - 1)::BIGINT FROM n HAVING sum(n - 1) > 0 UNION ALL SELECT 'orphan', count(*) FROM k WHERE lost HAVING count(*) > 0"""
)
def restore_attempts(spark, d):
    events, (users, held, done) = staged(journal_events(spark, d).drop("line"), "journal"), empty_tables(spark)
    people = staged(journal.resolve_users(events, users), "people")
    mapped = staged(journal.resolve_sessions(events, held, people), "mapped")
    out = journal.restore_attempts(events, done, mapped, questions(spark, d))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("attempts"))


@query("SELECT DISTINCT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, CASE WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') || ' 23:00:00' ELSE 'open' END AS ended_at FROM events")
def apply_session_ends(spark, d):
    """Sessions of even users get an end from the journal; the others have one already, which stays."""
    held = sessions(spark, d).withColumn("ended_at", F.when(F.col("user_id") % 2 == 1, "open"))
    ids = held.select(F.xxhash64("session_id").alias("journal_session"), "session_id", "started_at")
    ends = ids.select(F.lit("session_end").alias("kind"), F.col("journal_session").alias("sessionId"), F.concat(F.date_format("started_at", "yyyy-MM-dd"), F.lit(" 23:00:00")).alias("endedAt"))
    return journal.apply_session_ends(held, ends, ids.select("journal_session", "session_id")).select("session_id", "ended_at")


@query("SELECT 'sessions' AS name, count(DISTINCT ts::DATE) AS rows FROM events WHERE user_id = 5 UNION ALL SELECT 'attempts', count(*) FROM events WHERE user_id = 5")
def clear_user_history(spark, d):
    return journal.clear_user_history({"sessions": sessions(spark, d), "attempts": attempts(spark, d)}, 5)[1]


# Grading and parsing upkeep ---------------------------------------------------------------------------------------------


@query(
    """SELECT event_id AS attempt_id, CASE WHEN user_id % 10 = 3 THEN NULL WHEN event_type = 'view' THEN 'timeout' WHEN k % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'correct' ELSE 'incorrect' END ELSE 'correct' END AS verdict,
    CASE WHEN user_id % 10 = 3 THEN 'not this user''s session' WHEN event_type = 'view' THEN 'no buzz' WHEN k % 3 = 0 THEN 'option label' ELSE 'exact match' END AS reason FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def grade_attempts(spark, d):
    q = questions(spark, d).withColumns({"answer_alternates": F.array().cast("array<string>"), "correct_label": F.lit("A")})
    a = attempts(spark, d).join(q.select("question_id", "type", "answer"), "question_id")
    said = F.when(F.col("type") == "mcq", F.when(F.col("attempt_id") % 2 == 0, " a ").otherwise("B")).otherwise(F.concat(F.lit("The "), F.upper("answer"), F.lit("!")))
    a = a.select("attempt_id", "user_id", "session_id", "question_id", said.alias("response"), (F.col("verdict") == "timeout").alias("timed_out"))
    owned = sessions(spark, d).withColumn("user_id", F.when(F.col("user_id") % 10 == 3, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return grading.grade_attempts(a, q, owned).select("attempt_id", "verdict", "reason")


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS reason FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def quarantine_replace(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("raw_text"))
    old = docs.where("source_id % 2 = 0").withColumn("reason", F.lit("old"))
    new = docs.where("source_id % 3 = 0").select("source_id", F.lit("new").alias("reason"), F.col("raw_text").alias("raw"))
    return parse.quarantine_replace(old, new, new).select("source_id", "reason")


@query(with_("sources") + "SELECT d.doc_id AS quarantine_id, s.source_id, s.url FROM documents d LEFT JOIN sources s ON s.source_id = d.doc_id AND d.doc_id % 2 = 0 ORDER BY d.doc_id DESC LIMIT 20")
def quarantine_report(spark, d):
    entries = table(spark, d, "documents").select(F.col("doc_id").alias("quarantine_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("source_id"))
    return parse.quarantine_report(entries, sources(spark, d)).select("quarantine_id", "source_id", "url")


# Bank -------------------------------------------------------------------------------------------------------------------


@query("SELECT url, min(page_id) AS source_id FROM pages GROUP BY 1")
def register_sources(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("order"), F.col("page_id").alias("source_id"), "url")
    early = pages.where("source_id < 100").drop("order").groupBy("url").agg(F.min("source_id").alias("source_id"))
    return bank.register_sources(pages.unionByName(pages), early).select("url", "source_id")


@query(with_("sources") + "SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'fetched' ELSE status END AS status, CASE WHEN source_id % 4 = 0 THEN 'fresh' ELSE title END AS title, CASE WHEN source_id % 2 = 0 THEN source_id END AS bytes FROM sources")
def record_fetch(spark, d):
    rows = sources(spark, d).withColumns({"content_type": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string"), "bytes": F.lit(None).cast("long"), "fetched_at": F.lit(None).cast("timestamp")})
    got = rows.where("source_id % 2 = 0").select("url", F.lit("text/html").alias("content_type"), F.md5("url").alias("sha256"), F.col("source_id").alias("bytes"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.when(F.col("source_id") % 4 == 0, "fresh").otherwise("").alias("title"), F.lit("").alias("kind"))
    return bank.record_fetch(rows, got).select("source_id", "status", "title", "bytes")


@query("SELECT doc_id AS source_id, md5(CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE text END) AS text_md5, length(text) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS char_count FROM documents")
def save_text(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    old = docs.withColumn("char_count", F.length("text").cast("long"))
    even = docs.where("source_id % 2 = 0")
    new = even.select("source_id", F.lit("x").alias("text"), F.lit(1).alias("at")).union(even.select("source_id", F.concat("text", F.lit("!")), F.lit(2)))
    return bank.save_text(old, new, sources(spark, d))[0].select("source_id", F.md5("text").alias("text_md5"), "char_count")


@query("SELECT page_id, 'html' AS kind, 'done' AS status FROM pages")
def extract_uploads(spark, d):
    """Pages as uploaded files."""
    files = table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"), F.length("html").cast("long").alias("bytes"))
    return bank.extract_uploads(files, 0).select(F.regexp_extract("path", "^([0-9]+)", 1).cast("long").alias("page_id"), "kind", "status")


_HOSTS = "regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"


@query(
    f"""WITH t AS ({_html_sql()}), items AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'file' ELSE 'url' END AS kind, CASE WHEN page_id % 10 = 0 THEN page_id || '.exe' WHEN page_id % 2 = 0 THEN page_id || '.html' ELSE url END AS path_or_url FROM pages),
    bodies AS (SELECT CASE WHEN page_id % 10 = 0 THEN page_id || '.exe' ELSE page_id || '.html' END AS path_or_url, text FROM t WHERE page_id % 2 = 0 UNION ALL SELECT url, text FROM (SELECT url, arg_max(page_id, html) AS page_id FROM pages GROUP BY 1) JOIN t USING (page_id)),
    r AS (SELECT kind, path_or_url, CASE WHEN path_or_url LIKE '%.exe' AND kind = 'file' THEN 'unsupported file type exe' WHEN kind = 'url' AND length({_HOSTS.format("path_or_url")}) % 2 = 1 THEN 'host not allowed: ' || {_HOSTS.format("path_or_url")} WHEN length(trim(text)) < 100 THEN 'extracted text too short' END AS detail
      FROM items JOIN bodies USING (path_or_url))
    SELECT kind, path_or_url, CASE WHEN detail IS NULL THEN 'done' ELSE 'error' END AS status, detail FROM r"""
)
def drain_inbox(spark, d):
    """Pages in the intake queue: those with even ids as files, the others as links, of which hosts with names of even length are allowed."""
    pages = table(spark, d, "pages")
    even, name = F.col("page_id") % 2 == 0, F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 10 == 0, F.concat(name, F.lit(".exe"))).when(even, F.concat(name, F.lit(".html"))).otherwise(F.col("url"))
    log = scratch_folder(spark, "inbox")
    inbox.enqueue(pages.select(F.when(even, "file").otherwise("url").alias("kind"), path.alias("path_or_url"), F.lit(None).cast("string").alias("title"), F.octet_length("html").cast("long").alias("bytes")), log, "0")
    hosts = pages.select(url_host(F.col("url")).alias("host")).distinct().where(F.length("host") % 2 == 0)
    inbox.drain_inbox(spark, log, "1", pages.where(even).select(path.alias("path"), F.col("html").cast("binary").alias("content")), pages.select("url", "html"), hosts, lambda texts: None)
    return inbox.states(spark, log).select("kind", "path_or_url", "status", "detail")


# Streams ----------------------------------------------------------------------------------------------------------------


def event_stream(spark, d):
    """The event files as a stream; their zoneless times are UTC."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("basePath", d).parquet(f"{d}/events.parque[t]")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query(_RECURSIVE + _FOLD + "SELECT * FROM queue")
def stream_review_queue(spark, d):
    """The schedules of sm2_schedule, kept by a stream of attempts."""
    e = event_stream(spark, d)
    verdict = F.when(F.col("event_type").isin("purchase", "click", "signup"), "correct").when(F.col("event_type") == "error", "incorrect").otherwise("timeout")
    stream = e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("question_id"), F.col("event_id").alias("attempt_id"), verdict.alias("verdict"), F.col("ts").alias("created_at"))
    folder = scratch_folder(spark, "review")
    jobs.stream_review_queue(stream, folder, f"{folder}-checkpoint").awaitTermination()
    return jobs.read_review_queue(spark, folder).withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


@query(
    """WITH f AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), w AS (SELECT user_id, unnest(range(15)) AS k, date_trunc('minute', ts) AS m FROM f),
    c AS (SELECT user_id, m - to_minutes(k) AS "from", count(*) AS failures FROM w GROUP BY ALL HAVING count(*) >= 2)
    SELECT user_id, "from", "from" + INTERVAL 15 MINUTE AS "to", failures FROM c WHERE "from" + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM f) - INTERVAL 1 HOUR"""
)
def stream_lockouts(spark, d):
    """Sliding windows with two failures or more that the watermark has closed."""
    found = jobs.stream_lockouts(event_stream(spark, d).withColumn("failed", F.col("event_type") == "error"), threshold=2)
    folder = scratch_folder(spark, "lockouts")
    found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(found.schema).parquet(folder)
    return closed.withColumns({"from": F.col("from").cast("timestamp_ntz"), "to": F.col("to").cast("timestamp_ntz")})


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
    SELECT a.event_id, a.user_id, a.ts, count(*) AS failures FROM e a JOIN e b ON a.user_id = b.user_id AND a.r = b.r AND b.failed AND b.s BETWEEN a.s - 899 AND a.s WHERE a.failed AND a.s + 1 <= epoch((SELECT max(ts) FROM events) - INTERVAL 1 HOUR) GROUP BY ALL HAVING count(*) >= 2"""
)
def stream_cleared_lockouts(spark, d):
    """The lock-outs of failed_attempt_lockouts, successes clearing them, as a stream gives them once the watermark has passed."""
    found = lockouts(event_stream(spark, d).withColumn("failed", F.col("event_type") == "error"), threshold=2)
    folder = scratch_folder(spark, "cleared")
    with state_on_disk(spark):
        running = found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(folder).select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "failures")


@query(
    """SELECT event_id AS attempt_id, user_id * 100000000 + CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS session_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) + CASE WHEN event_type = 'signup' THEN 1000000000 ELSE 0 END AS question_id,
    CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'correct' ELSE 'incorrect' END AS verdict, NULL::INT AS buzz_ordinal, NULL::INT AS clue_count, date_trunc('second', ts) AS created_at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('second', ts), CAST(json_extract(props, '$.k') AS BIGINT) + CASE WHEN event_type = 'signup' THEN 1000000000 ELSE 0 END ORDER BY event_id) = 1"""
)
def stream_journal(spark, d):
    """The journal of ``events``, written as text and read back as a stream: each attempt once, a session's attempts at one question in one second being one, that with the smallest id."""
    folder = scratch_folder(spark, "journal")
    lines = journal.journal_lines(journal_events(spark, d).where("kind is not null"))
    lines.write.mode("append").text(folder)
    lines.limit(500).write.mode("append").text(folder)  # some of it again, as a replay would
    found = jobs.stream_journal(spark, folder, "60 days")
    out = f"{folder}-out"
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return jobs.settled_attempts(spark.read.schema(found.schema).parquet(out)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("SELECT user_id * 100000000 + CAST(strftime(day, '%Y%m%d') AS BIGINT) AS session_id, user_id, CAST(day AS TIMESTAMP) AS started_at, CASE WHEN user_id % 3 <> 0 THEN max(date_trunc('second', ts)) END AS ended_at FROM (SELECT user_id, ts, ts::DATE AS day FROM events) GROUP BY user_id, day")
def stream_sessions(spark, d):
    """Sessions of the journal joined with their ends as two streams; users whose id three divides never end theirs. A beat of a later time lets the watermark pass them all."""
    day = F.date_format("ts", "yyyyMMdd").cast("long")
    last = table(spark, d, "events").groupBy((F.col("user_id") * 100_000_000 + day).alias("sessionId"), "user_id").agg(F.max("ts").alias("ts")).where("user_id % 3 != 0")
    ends = last.select(F.to_json(F.struct(F.lit("session_end").alias("kind"), "sessionId", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("endedAt"))).alias("value"))
    begun = journal.journal_lines(journal_events(spark, d).where("kind = 'session'"))
    beat = spark.createDataFrame([('{"kind":"session","sessionId":-1,"userId":0,"startedAt":"2200-01-01"}',), ('{"kind":"session_end","sessionId":-1,"endedAt":"2200-01-01 00:00:00"}',)], "value string")
    folder = scratch_folder(spark, "sessions")
    for lines in (ends, begun, begun.limit(100), beat):  # ends come first, and some sessions twice
        lines.write.mode("append").text(folder)
    for running in jobs.stream_history(spark, folder, f"{folder}-out", f"{folder}-checkpoint", "60 days"):
        running.awaitTermination()
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")]
    return spark.read.schema("session_id long, user_id long, user_name string, format string, filters_json string, started_at timestamp, ended_at timestamp").parquet(f"{folder}-out/sessions").where("session_id > 0").select("session_id", "user_id", *times)


@query("SELECT 'questions' AS name, count(*) AS rows FROM part UNION ALL SELECT 'question_tags', count(*) FROM (SELECT p_partkey, p_type FROM part UNION SELECT p_partkey, p_brand FROM part)")
def publish_snapshot(spark, d):
    """A snapshot without accounts: what of the tables is published, and how many rows."""
    folder = scratch_folder(spark, "snapshot")
    counts = bank.publish_snapshot({"questions": questions(spark, d), "question_tags": question_tags(spark, d), "attempts": attempts(spark, d)}, folder, accounts=False)
    return spark.createDataFrame(list(counts.items()), "name string, rows long")
