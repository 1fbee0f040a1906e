"""Registered queries over practice, reviews and the library, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.operators import library, practice, review
from quizloom.plans.mapping import attempts, question_sources, question_tags, questions, sessions, sources, table, users, with_

AS_OF = "2024-01-20 00:00:00"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


_TAG = "accuracy AS (SELECT a.user_id, t.tag, count(*) AS attempts, count(*) FILTER (WHERE verdict = 'correct') AS correct FROM attempts a JOIN question_tags t USING (question_id) GROUP BY ALL)"


@query(with_("attempts", "question_tags") + ", " + _TAG + " SELECT user_id, tag, attempts, correct, round(correct / attempts, 6) AS accuracy FROM accuracy")
def accuracy_by_tag(spark, d):
    return practice.accuracy_by_tag(attempts(spark, d), question_tags(spark, d))


@query(
    with_("attempts", "sessions", "questions")
    + """, done AS (SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE verdict = 'correct') AS correct, round(avg(buzz_ordinal / 4), 6) AS mean_buzz FROM attempts GROUP BY 1)
    SELECT s.user_id, s.sessions, d.attempts, d.correct, d.mean_buzz, round(d.correct / d.attempts, 6) AS accuracy, (SELECT count(*) FROM questions) AS bank_questions, (SELECT count(*) FROM questions WHERE origin = 'official') AS bank_official
    FROM (SELECT user_id, count(*) AS sessions FROM sessions GROUP BY 1) s JOIN done d USING (user_id)"""
)
def overview(spark, d):
    return practice.overview(attempts(spark, d), sessions(spark, d), questions(spark, d))


@query(
    with_("attempts", "sessions")
    + """SELECT * FROM (SELECT s.session_id, s.user_id, s.started_at, a.attempts, a.correct, CAST(row_number() OVER (PARTITION BY s.user_id ORDER BY s.started_at DESC, s.session_id DESC) AS INT) AS rank
    FROM sessions s JOIN (SELECT session_id, count(*) AS attempts, count(*) FILTER (WHERE verdict = 'correct') AS correct FROM attempts GROUP BY 1) a USING (session_id)) WHERE rank <= 12"""
)
def recent_sessions(spark, d):
    return practice.recent_sessions(attempts(spark, d), sessions(spark, d))


@query(
    with_("attempts", "question_tags") + ", " + _TAG
    + """, own AS (SELECT user_id, round(count(*) FILTER (WHERE verdict = 'correct') / count(*), 6) AS overall FROM attempts GROUP BY 1),
    weak AS (SELECT a.user_id, a.tag, a.attempts, a.correct, round(a.correct / a.attempts, 6) AS accuracy, o.overall FROM accuracy a JOIN own o USING (user_id) WHERE a.attempts >= 4),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY accuracy, attempts DESC, tag) AS INT) AS rank FROM weak WHERE accuracy < overall)
    SELECT r.*, (SELECT count(*) FROM question_tags t WHERE t.tag = r.tag AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.user_id = r.user_id AND a.question_id = t.question_id)) AS unseen FROM ranked r WHERE rank <= 6"""
)
def weak_areas(spark, d):
    return practice.weak_areas(attempts(spark, d), question_tags(spark, d))


@query(
    with_("attempts")
    + """SELECT * FROM (SELECT user_id, question_id, attempts, misses, CAST(row_number() OVER (PARTITION BY user_id ORDER BY misses DESC, attempts DESC, question_id) AS INT) AS rank FROM
    (SELECT user_id, question_id, count(*) AS attempts, count(*) FILTER (WHERE verdict <> 'correct') AS misses FROM attempts GROUP BY ALL) WHERE misses > 0) WHERE rank <= 10"""
)
def most_missed(spark, d):
    return practice.most_missed(attempts(spark, d))


@query(with_("attempts", "sessions") + "SELECT user_id, (SELECT count(*) FROM sessions s WHERE s.user_id = u.user_id) AS sessions, (SELECT count(*) FROM attempts a WHERE a.user_id = u.user_id) AS attempts FROM (SELECT DISTINCT user_id FROM events) u")
def attempt_counts_by_user(spark, d):
    return practice.attempt_counts_by_user(users(spark, d), sessions(spark, d), attempts(spark, d))


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
    SELECT a.event_id, a.user_id, a.ts, count(*) AS failures FROM e a JOIN e b ON a.user_id = b.user_id AND a.r = b.r AND b.failed AND b.s BETWEEN a.s - 899 AND a.s WHERE a.failed GROUP BY ALL HAVING count(*) >= 2"""
)
def failed_attempt_lockouts(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return practice.failed_attempt_lockouts(events, threshold=2).select("event_id", "user_id", "ts", "failures")


@query(
    with_("sources", "question_tags")
    + """, st AS (SELECT source_id, lang AS tag FROM sources JOIN documents ON doc_id = source_id), v AS (SELECT DISTINCT lang AS tag FROM documents),
    hits AS (SELECT DISTINCT * FROM (SELECT st.tag, s.source_id, s.title, s.url FROM sources s JOIN st USING (source_id) WHERE kind IN ('studyguide', 'index', 'rules') AND status IN ('fetched', 'extracted', 'parsed')
    UNION ALL SELECT v.tag, s.source_id, s.title, s.url FROM sources s JOIN v ON contains(lower(s.title), lower(v.tag)) WHERE kind IN ('studyguide', 'index', 'rules') AND status IN ('fetched', 'extracted', 'parsed')))
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tag ORDER BY url, source_id) AS INT) AS rank FROM hits) WHERE rank <= 3"""
)
def tag_resources(spark, d):
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("tag"))
    return practice.tag_resources(langs.select("tag").distinct(), sources(spark, d), langs)


@query(
    f"""WITH areas AS ({ORACLE["weak_areas"]}),
    named AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('Guide to ', p_type[1], lower(p_type[2:]), ' and ', p_brand) END AS title, 'https://' || source || '.example.org/' || doc_id AS url FROM documents JOIN part ON p_partkey = doc_id % (SELECT count(*) FROM part) WHERE doc_id % 4 < 2),
    v AS (SELECT DISTINCT p_type AS tag FROM part UNION SELECT DISTINCT p_brand FROM part),
    found AS (SELECT v.tag, n.url, row_number() OVER (PARTITION BY v.tag ORDER BY n.url, n.source_id) AS rank FROM named n JOIN v ON contains(lower(n.title), lower(v.tag))),
    listed AS (SELECT tag, string_agg(url, '|' ORDER BY rank) AS resources FROM found WHERE rank <= 3 GROUP BY 1)
    SELECT areas.*, coalesce(resources, '') AS resources FROM areas LEFT JOIN listed USING (tag)"""
)
def weak_area_resources(spark, d):
    """Weak areas with what to read: sources whose title names the type or brand of a part."""
    part = table(spark, d, "part")
    docs = table(spark, d, "documents").select("doc_id", "source").crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("n")))).where("doc_id % 4 < 2").withColumn("p_partkey", F.col("doc_id") % F.col("n")).join(part, "p_partkey")
    title = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Guide to "), F.substring("p_type", 1, 1), F.lower(F.substring(F.col("p_type"), F.lit(2), F.length("p_type"))), F.lit(" and "), "p_brand"))
    named = docs.select(F.col("doc_id").alias("source_id"), title.alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"), F.lit("studyguide").alias("kind"), F.lit("parsed").alias("status"))
    tags = question_tags(spark, d)
    out = practice.weak_areas_with_resources(attempts(spark, d), tags, named, tags.select(F.col("question_id").alias("source_id"), "tag").limit(0))
    return out.withColumn("resources", F.array_join(F.transform("resources", lambda r: r["url"]), "|"))


_FOLD = """, h AS (SELECT user_id, question_id, verdict, created_at, row_number() OVER (PARTITION BY user_id, question_id ORDER BY created_at, attempt_id) AS n FROM attempts),
f AS (SELECT user_id, question_id, n, verdict <> 'correct' AS active, CASE WHEN verdict <> 'correct' THEN 1.0 ELSE 0.0 END::DOUBLE AS i, 2.5::DOUBLE AS e, CASE WHEN verdict <> 'correct' THEN 1 ELSE 0 END AS l,
  CASE WHEN verdict <> 'correct' THEN created_at + INTERVAL 1 DAY END AS due FROM h WHERE n = 1
  UNION ALL SELECT h.user_id, h.question_id, h.n,
  CASE WHEN h.verdict <> 'correct' THEN true WHEN f.active THEN least(180, greatest(1, floor(f.i * f.e + 0.5))) < 180 ELSE false END,
  CASE WHEN h.verdict <> 'correct' THEN 1.0 WHEN f.active THEN least(180, greatest(1, floor(f.i * f.e + 0.5))) ELSE f.i END,
  CASE WHEN h.verdict <> 'correct' AND NOT f.active THEN 2.5 WHEN h.verdict <> 'correct' THEN greatest(1.3, f.e - 0.2) WHEN f.active THEN least(3.0, f.e + 0.05) ELSE f.e END,
  CASE WHEN h.verdict <> 'correct' AND NOT f.active THEN 1 WHEN h.verdict <> 'correct' THEN f.l + 1 ELSE f.l END,
  CASE WHEN h.verdict <> 'correct' THEN h.created_at + INTERVAL 1 DAY WHEN f.active THEN h.created_at + to_days(CAST(least(180, greatest(1, floor(f.i * f.e + 0.5))) AS INT)) ELSE f.due END
  FROM f JOIN h ON h.user_id = f.user_id AND h.question_id = f.question_id AND h.n = f.n + 1),
queue AS (SELECT user_id, question_id, i AS interval_days, round(e, 6) AS ease, CAST(l AS INT) AS lapses, due AS due_at FROM (SELECT *, max(n) OVER (PARTITION BY user_id, question_id) AS last FROM f) WHERE n = last AND active) """
_RECURSIVE = with_("attempts", "sessions", "questions", "question_tags").replace("WITH", "WITH RECURSIVE", 1)


@query(_RECURSIVE + _FOLD + "SELECT * FROM queue")
def sm2_schedule(spark, d):
    return review.sm2_schedule(attempts(spark, d))


@query(
    with_("attempts")
    + """, p AS (SELECT user_id, question_id, arg_max(verdict, (created_at, attempt_id)) AS last, count(*) FILTER (WHERE verdict IN ('incorrect', 'timeout')) AS m, max(created_at) AS latest FROM attempts GROUP BY ALL)
    SELECT user_id, question_id, 1.0::DOUBLE AS interval_days, round(greatest(1.3, 2.5 - 0.2 * greatest(0, m - 1))::DOUBLE, 6) AS ease, CAST(m AS INT) AS lapses, latest + INTERVAL 1 DAY AS due_at FROM p WHERE last IN ('incorrect', 'timeout')"""
)
def rebuild_review_queue(spark, d):
    return review.rebuild_review_queue(attempts(spark, d))


@query(_RECURSIVE + _FOLD + f"SELECT user_id, count(*) AS total, count(*) FILTER (WHERE due_at <= TIMESTAMP '{AS_OF}') AS due FROM queue GROUP BY 1")
def review_counts(spark, d):
    return review.review_counts(review.sm2_schedule(attempts(spark, d)), as_of())


@query(
    _RECURSIVE + _FOLD
    + f"""SELECT r.*, q.stem AS prompt, q.answer, r.due_at <= TIMESTAMP '{AS_OF}' AS overdue FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY due_at, question_id) AS INT) AS rank FROM queue) r
    JOIN questions q USING (question_id) WHERE rank <= 12"""
)
def review_list(spark, d):
    return review.review_list(review.sm2_schedule(attempts(spark, d)), questions(spark, d), as_of())


@query(
    _RECURSIVE + _FOLD
    + f"""SELECT user_id, question_id, due_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY due_at, question_id) AS INT) AS rank FROM queue WHERE due_at <= TIMESTAMP '{AS_OF}' AND question_id IN (SELECT question_id FROM questions WHERE origin = 'official')"""
)
def due_questions(spark, d):
    return review.due_questions(review.sm2_schedule(attempts(spark, d)), review.filter_questions(questions(spark, d), origin="official"), as_of())


@query(with_("questions", "question_tags") + "SELECT q.question_id, q.type, q.difficulty, q.answer FROM questions q WHERE type = 'tossup' AND origin = 'official' AND EXISTS (SELECT 1 FROM question_tags t WHERE t.question_id = q.question_id AND lower(t.tag) IN ('economy', 'brand#3'))")
def filter_questions(spark, d):
    return review.filter_questions(questions(spark, d), question_tags(spark, d), qtype="tossup", origin="official", tags=["Economy", "brand#3"]).select("question_id", "type", "difficulty", "answer")


@query(with_("attempts", "questions") + "SELECT count(*) AS total, greatest(count(*) - 7, 0) AS remaining FROM questions WHERE difficulty = 'middle'")
def count_available(spark, d):
    return review.count_available(review.filter_questions(questions(spark, d), difficulty="middle"), 7)


@query(
    with_("questions", "question_tags")
    + """SELECT tag, count(DISTINCT question_id) AS questions FROM questions JOIN question_tags USING (question_id) WHERE origin = 'official' GROUP BY 1
    UNION ALL SELECT NULL, count(*) FROM questions WHERE origin = 'official' AND question_id IN (SELECT question_id FROM question_tags WHERE lower(tag) = 'economy')"""
)
def count_by_tag(spark, d):
    return review.count_by_tag(review.filter_questions(questions(spark, d), origin="official"), question_tags(spark, d), ["ECONOMY"])


def _draw_sql(*columns: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '0', {', '.join(columns)})), 1, 15))::BIGINT"


_FRESH = f"""total AS (SELECT count(*) AS size FROM questions), listed AS (SELECT question_id, row_number() OVER (ORDER BY {_draw_sql("question_id")}, question_id) - 1 AS place FROM questions),
known AS (SELECT user_id, question_id, count(*) AS n, max(created_at) AS last_at FROM attempts WHERE question_id IN (SELECT question_id FROM questions) GROUP BY ALL),
want AS (SELECT user_id, {_draw_sql("user_id")} % size AS start, least(size, 10 + (SELECT count(*) FROM known k WHERE k.user_id = u.user_id)) AS want FROM (SELECT DISTINCT user_id FROM events) u, total),
offered AS (SELECT user_id, question_id, (place - start + size) % size AS k FROM want, listed, total WHERE (place - start + size) % size < want),
pool AS (SELECT user_id, question_id, 0 AS n, NULL::TIMESTAMP AS last_at, k FROM offered ANTI JOIN known USING (user_id, question_id) UNION ALL SELECT user_id, question_id, n, last_at, {_draw_sql("user_id", "question_id")} % 1099511627776 FROM known),
fresh AS (SELECT * FROM (SELECT user_id, question_id, n AS attempts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n, last_at NULLS FIRST, k, question_id) AS INT) AS rank FROM pool) WHERE rank <= 10)"""


@query(with_("attempts", "questions") + ", " + _FRESH + " SELECT * FROM fresh")
def fresh_questions(spark, d):
    return review.fresh_questions(users(spark, d), questions(spark, d), attempts(spark, d), 10)


@query(
    _RECURSIVE + _FOLD + ", " + _FRESH
    + f""", due AS (SELECT user_id, question_id, row_number() OVER (PARTITION BY user_id ORDER BY due_at, question_id) AS rank FROM queue WHERE due_at <= TIMESTAMP '{AS_OF}' AND question_id IN (SELECT question_id FROM questions)),
    once AS (SELECT user_id, question_id, min((part, rank)) AS o FROM (SELECT user_id, question_id, 0 AS part, rank FROM due UNION ALL SELECT user_id, question_id, 1, rank FROM fresh) GROUP BY ALL)
    SELECT * FROM (SELECT user_id, question_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY o, question_id) AS INT) AS rank FROM once) WHERE rank <= 10"""
)
def next_questions(spark, d):
    q, a = questions(spark, d), attempts(spark, d)
    return review.next_questions("mixed", review.due_questions(review.sm2_schedule(a), q, as_of()), review.fresh_questions(users(spark, d), q, a, 10), 10)


@query(
    with_("questions", "question_tags", "sources")
    + """SELECT q.question_id, q.answer, (SELECT string_agg(tag, '|' ORDER BY tag) FROM question_tags t WHERE t.question_id = q.question_id) AS tags, p.p_type || '>' || p.p_name AS clues, 'A=' || p.p_brand || '|B=' || p.p_type AS options, s.title AS source_title, s.url AS source_url
    FROM questions q JOIN part p ON p.p_partkey = q.question_id LEFT JOIN sources s ON s.source_id = q.source_id"""
)
def hydrate(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "question_id")
    clues = part.select("question_id", F.posexplode(F.array("p_type", "p_name")).alias("ordinal", "text")).withColumn("tier", F.lit("middle"))
    options = part.select("question_id", F.inline(F.array(F.struct(F.lit("A").alias("label"), F.col("p_brand").alias("text")), F.struct(F.lit("B").alias("label"), F.col("p_type").alias("text")))))
    full = review.hydrate(questions(spark, d), question_tags(spark, d), clues, options, sources(spark, d))
    return full.select("question_id", "answer", F.concat_ws("|", "tags").alias("tags"), F.concat_ws(">", F.transform("clues", lambda c: c["text"])).alias("clues"), F.concat_ws("|", F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["text"]))).alias("options"), "source_title", "source_url")


@query("SELECT p_partkey AS question_id, p_name AS answer, 'AB'[CAST(p_partkey % 2 AS INT) + 1] AS correct_label FROM part")
def reveal(spark, d):
    q = questions(spark, d).withColumns({"answer_alternates": F.array(F.col("answer")), "explanation": F.col("stem")})
    options = q.select("question_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("label")).withColumn("is_correct", F.col("label") == F.when(F.col("question_id") % 2 == 0, "A").otherwise("B"))
    return review.reveal(q, options).select("question_id", "answer", "correct_label")


@query(
    with_("sources", "questions", "question_sources")
    + """, f AS (SELECT s.*, coalesce(c.n, 0) AS coverage, coalesce(g.n, 0) AS contributed FROM sources s LEFT JOIN (SELECT source_id, count(DISTINCT question_id) AS n FROM question_sources GROUP BY 1) c USING (source_id)
    LEFT JOIN (SELECT source_id, count(*) AS n FROM questions GROUP BY 1) g USING (source_id) WHERE kind = 'packet' AND (contains(lower(coalesce(title, '')), 'en') OR contains(lower(url), 'en')))
    SELECT source_id, url, coverage, contributed, 2 AS page, (SELECT count(*) FROM f) AS total FROM f ORDER BY coverage DESC, source_id LIMIT 25 OFFSET 25"""
)
def list_sources(spark, d):
    return library.list_sources(sources(spark, d), question_sources(spark, d), questions(spark, d), kind="packet", search="EN", page=2).select("source_id", "url", "coverage", "contributed", "page", "total")


@query(with_("sources") + "SELECT CASE WHEN grouping(host) = 0 THEN 'host' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'status' END AS facet, coalesce(host, kind, status) AS name, count(*) AS sources FROM sources GROUP BY GROUPING SETS ((host), (kind), (status))")
def facets(spark, d):
    return library.facets(sources(spark, d))


@query(with_("sources") + "SELECT DISTINCT host FROM sources WHERE NOT ai_train_ok")
def restricted_hosts(spark, d):
    return library.restricted_hosts(sources(spark, d))


@query(with_("sources") + "SELECT source_id, host, bool_or(NOT ai_train_ok) OVER (PARTITION BY host) AS host_restricted FROM sources")
def restricted_propagation(spark, d):
    return library.restricted_propagation(sources(spark, d)).select("source_id", "host", "host_restricted")


@query(
    with_("sources", "questions", "question_sources")
    + """SELECT (SELECT count(*) FROM sources) AS total, (SELECT count(DISTINCT host) FROM sources) AS hosts, (SELECT count(DISTINCT source_id) FROM question_sources) AS with_questions, (SELECT count(source_id) FROM questions) AS questions_with_source,
    (SELECT count(*) FROM sources WHERE host IN (SELECT host FROM sources WHERE NOT ai_train_ok)) AS restricted"""
)
def source_summary(spark, d):
    return library.source_summary(sources(spark, d), question_sources(spark, d), questions(spark, d))


@query(with_("sources") + "SELECT status, count(*) AS sources, CASE status WHEN 'pending' THEN 1 WHEN 'fetched' THEN 2 WHEN 'extracted' THEN 3 WHEN 'parsed' THEN 4 ELSE 0 END AS place FROM sources GROUP BY 1")
def status_ladder(spark, d):
    return library.status_ladder(sources(spark, d))


@query(with_("sources") + "SELECT count(*) FILTER (WHERE status IN ('fetched', 'extracted', 'parsed')) AS fetched, count(*) FILTER (WHERE status IN ('fetched', 'extracted', 'parsed') AND source_id % 3 = 0) AS cached, count(*) FILTER (WHERE status = 'robots_denied') AS denied, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'pending') AS queued FROM sources")
def crawl_counts(spark, d):
    return library.crawl_counts(sources(spark, d).withColumn("from_cache", F.col("source_id") % 3 == 0))


@query(with_("questions") + "SELECT type, origin, count(*) AS questions FROM questions GROUP BY ROLLUP (type, origin)")
def bank_counts(spark, d):
    return library.bank_counts(questions(spark, d))


@query(with_("question_tags") + "SELECT tag, (SELECT count(DISTINCT question_id) FROM question_tags t WHERE t.tag = v.tag) AS questions FROM (SELECT tag FROM question_tags UNION SELECT r_name FROM region) v")
def tag_counts(spark, d):
    qt = question_tags(spark, d)
    return library.tag_counts(qt.select("tag").union(table(spark, d, "region").select("r_name")).distinct(), qt)


@query(
    with_("sources", "questions", "question_tags", "attempts")
    + """SELECT 'status' AS section, status AS name, count(*) AS n FROM sources GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM sources GROUP BY 2 UNION ALL SELECT 'total', 'sources', count(*) FROM sources
    UNION ALL SELECT 'total', 'questions', count(*) FROM questions UNION ALL SELECT 'total', 'enriched', count(*) FROM questions WHERE enriched UNION ALL SELECT 'total', 'attempts', count(*) FROM attempts
    UNION ALL SELECT 'total', 'untagged', count(*) FROM questions q WHERE NOT EXISTS (SELECT 1 FROM question_tags t WHERE t.question_id = q.question_id)
    UNION ALL SELECT * FROM (SELECT 'tag', tag, count(*) AS c FROM question_tags GROUP BY 2 ORDER BY c DESC, tag LIMIT 15)"""
)
def bank_stats(spark, d):
    return library.bank_stats(sources(spark, d), questions(spark, d), question_tags(spark, d), attempts(spark, d))
