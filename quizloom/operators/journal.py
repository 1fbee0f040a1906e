"""The practice journal: reading it, and replaying it into the tables as often as one likes.

Journal ids are never trusted: users are matched by name, sessions by what they were, attempts by what they answered and when. So a
second replay adds nothing, whatever order the lines come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.operators.ranks import ranked
from quizloom.operators.review import rebuild_review_queue
from quizloom.sources.scratch import staged

EVENT = (
    "kind string, sessionId long, userId long, userName string, format string, origin string, difficulty string, filters struct<tags:array<string>,mode:string>, startedAt string, "
    "attemptId long, questionId long, buzzClueOrdinal int, clueCount int, response string, verdict string, judgedBy string, latencyMs long, createdAt string, endedAt string"
)
KINDS = ("session", "attempt", "session_end")
FIRST_USER = 1


def parse_journal(lines: DataFrame) -> DataFrame:
    """lines(value) as events; blank lines are left out, malformed ones (no object, no known kind) have a null kind and keep their text."""
    # What inline() gives is not written out again in a filter on it, so each line is parsed once.
    parsed = lines.where(F.trim("value") != "").select(F.col("value").alias("line"), F.inline(F.array(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}))))
    known = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    fields = [F.when(known, F.col(c)).alias(c) for c in parsed.columns if c != "line"]
    return parsed.select("line", *fields)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return parse_journal(spark.read.text(path))


def journal_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines (value); null fields are left out."""
    return events.select(F.to_json(F.struct(*[c for c in events.columns if c != "line"])).alias("value"))


def append_journal(events: DataFrame, path: str) -> None:
    journal_lines(events).write.mode("append").text(path)


def journal_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("kind", F.lit("malformed")).alias("kind")).agg(F.count(F.lit(1)).alias("events"))


def numbered(rows: DataFrame, order: list[str], most: DataFrame) -> DataFrame:
    """``rows`` with _new: the numbers after ``most`` (one row, _most) in the given order, dense whatever the keys look like."""
    return ranked(rows, order, "_rank").crossJoin(F.broadcast(most)).withColumn("_new", (F.col("_most") + F.col("_rank")).cast("long")).drop("_rank", "_most")


def resolve_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """(journal_user, user_id, name, created): each user of the journal, by name in any case; nameless ones are user 1.

    users(user_id, name). Names new to the table get the next ids in the order of their names.
    """
    seen = events.where("kind = 'session'").groupBy("userId").agg(F.min_by("userName", F.struct("startedAt", "sessionId")).alias("name"))
    # Read twice below; the journal behind it is not.
    seen = staged(seen.select(F.col("userId").alias("journal_user"), F.nullif(F.trim("name"), F.lit("")).alias("name"), F.lower(F.trim("name")).alias("_low")), "seen")
    held = users.groupBy(F.lower("name").alias("_low")).agg(F.min("user_id").alias("_id"))
    most = users.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("_most"))
    new = seen.where("name is not null").select("_low").distinct().join(held, "_low", "left_anti")
    new = numbered(new, ["_low"], most)
    out = seen.join(held, "_low", "left").join(new, "_low", "left")
    user = F.when(F.col("name").isNull(), F.lit(FIRST_USER).cast("long")).otherwise(F.coalesce("_id", "_new"))
    return out.select("journal_user", user.alias("user_id"), "name", F.col("_new").isNotNull().alias("created"))


def session_key() -> list[Column]:
    """What identifies a session whatever its id."""
    return [F.col("startedAt").alias("started_at"), F.col("format"), F.to_json(F.col("filters")).alias("filters_json")]


def resolve_sessions(events: DataFrame, sessions: DataFrame, user_map: DataFrame) -> DataFrame:
    """(journal_session, started_at, format, filters_json, user_id, session_id, added): sessions(session_id, started_at, format, filters_json, user_id).

    New ones get the ids after the largest; equal ones in the journal are one.
    """
    own = events.where("kind = 'session'").join(user_map.select("journal_user", "user_id"), F.col("userId").eqNullSafe(F.col("journal_user")), "left")
    own = own.select(F.col("sessionId").alias("journal_session"), *session_key(), F.coalesce("user_id", F.lit(FIRST_USER)).alias("user_id")).distinct()
    own = staged(own, "own")
    keys = ["started_at", "format", "filters_json", "user_id"]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0] & same[1] & same[2] & same[3]
    held = sessions.groupBy(*keys).agg(F.min("session_id").alias("_held"))
    new = own.select(*keys).distinct().alias("a").join(held.alias("b"), on, "left_anti")
    most = sessions.agg(F.coalesce(F.max("session_id"), F.lit(0)).alias("_most"))
    new = numbered(new, keys, most)
    both = own.alias("a").join(held.alias("b"), on, "left").select("a.*", "_held")
    both = both.alias("a").join(new.alias("b"), on, "left").select("a.*", "_new")
    return both.select("journal_session", *keys, F.coalesce("_held", "_new").alias("session_id"), F.col("_held").isNull().alias("added"))


def restore_attempts(events: DataFrame, attempts: DataFrame, session_map: DataFrame, questions: DataFrame) -> DataFrame:
    """Each attempt of the journal with its session_id and outcome: added, skipped (there already, or repeated) or orphan.

    attempts(session_id, question_id, created_at). A session anywhere in the journal counts, before or after the attempt.
    """
    own = events.where("kind = 'attempt'")
    sessions = session_map.groupBy("journal_session").agg(F.max_by("session_id", "started_at").alias("session_id"))
    rows = own.join(sessions, F.col("sessionId") == F.col("journal_session"), "left").join(questions.select(F.col("question_id").alias("_q")).distinct(), F.col("questionId") == F.col("_q"), "left")
    keys = ["session_id", "question_id", "created_at"]
    held = attempts.select(*keys).distinct().withColumn("_held", F.lit(True))
    rows = rows.select("session_id", F.col("questionId").alias("question_id"), F.col("createdAt").alias("created_at"), F.col("_q").isNull().alias("_no_question"), F.col("buzzClueOrdinal").alias("buzz_ordinal"), F.col("clueCount").alias("clue_count"), "response", "verdict", F.col("judgedBy").alias("judged_by"), F.col("latencyMs").alias("latency_ms"), F.col("attemptId").alias("journal_attempt"))
    rows = rows.join(held, keys, "left").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("journal_attempt")))
    outcome = F.when(F.col("session_id").isNull() | F.col("_no_question"), "orphan").when(F.coalesce("_held", F.lit(False)) | (F.col("_nth") > 1), "skipped").otherwise("added")
    return rows.withColumn("outcome", outcome).drop("_no_question", "_held", "_nth")


def apply_session_ends(sessions: DataFrame, events: DataFrame, session_map: DataFrame) -> DataFrame:
    """Sessions with ended_at filled in where it was null."""
    ends = events.where("kind = 'session_end'").join(session_map, F.col("sessionId") == F.col("journal_session")).groupBy("session_id").agg(F.min("endedAt").alias("_end"))
    return sessions.join(ends, "session_id", "left").withColumn("ended_at", F.coalesce("ended_at", "_end")).drop("_end")


def restore(events: DataFrame, users: DataFrame, sessions: DataFrame, attempts: DataFrame, questions: DataFrame, review_queue: DataFrame | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
    """The replayed tables, and a report of one row; none of the bank's tables is written here.

    review_queue: the old one (if given) and an entry for each pair whose latest attempt is a miss; ``queued`` in the report counts the
    new entries. A dry run has no attempts to look at, so it computes no queue and ``queued`` is null.
    """
    events = staged(events.drop("line"), "events")  # each of these is read several times
    people = staged(resolve_users(events, users), "people")
    mapped = staged(resolve_sessions(events, sessions, people), "mapped")
    outcomes = staged(restore_attempts(events, attempts, mapped, questions), "outcomes")
    new_users = people.where("created").select("user_id", "name").distinct()
    new_sessions = mapped.where("added").select("session_id", "started_at", "format", "filters_json", "user_id", F.lit(None).cast("string").alias("ended_at")).distinct()
    all_sessions = apply_session_ends(sessions.unionByName(new_sessions, allowMissingColumns=True), events, mapped)
    all_attempts = attempts.unionByName(outcomes.where("outcome = 'added'").drop("outcome", "journal_attempt"), allowMissingColumns=True)
    out = {"users": users.unionByName(new_users, allowMissingColumns=True), "sessions": all_sessions, "attempts": all_attempts}
    queued = None
    if not dry_run:
        timed = all_attempts.drop("user_id").join(all_sessions.select("session_id", "user_id"), "session_id").withColumn("created_at", F.to_timestamp("created_at"))
        new = staged(rebuild_review_queue(timed, review_queue), "queue")
        out["review_queue"] = new if review_queue is None else review_queue.unionByName(new, allowMissingColumns=True)
        queued = new.agg(F.count(F.lit(1)).alias("queued"))
    report = (
        outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(f"attempts_{o}") for o in ("added", "skipped", "orphan")])
        .crossJoin(mapped.agg(F.countDistinct(F.when(F.col("added"), F.col("session_id"))).alias("sessions_added"), F.countDistinct(F.when(~F.col("added"), F.col("session_id"))).alias("sessions_skipped")))
        .crossJoin(new_users.agg(F.count(F.lit(1)).alias("users_added")))
        .crossJoin(events.agg(F.count_if(F.col("kind").isNull()).alias("malformed"), F.count_if(F.col("kind") == "session_end").alias("ended")))
    )
    return {**out, "report": report.withColumn("queued", F.lit(None).cast("long")) if queued is None else report.crossJoin(queued)}


def history_diff(events: DataFrame, sessions: DataFrame, attempts: DataFrame) -> DataFrame:
    """(name, journal, tables): how many sessions and attempts each side has."""
    counts = events.agg(F.count_if(F.col("kind") == "session").alias("sessions"), F.count_if(F.col("kind") == "attempt").alias("attempts"))
    held = sessions.agg(F.count(F.lit(1)).alias("s")).crossJoin(attempts.agg(F.count(F.lit(1)).alias("a")))
    both = counts.crossJoin(held)
    return both.select(F.inline(F.array(F.struct(F.lit("sessions").alias("name"), F.col("sessions").alias("journal"), F.col("s").alias("tables")), F.struct(F.lit("attempts").alias("name"), F.col("attempts").alias("journal"), F.col("a").alias("tables")))))


def history_by_profile(users: DataFrame, sessions: DataFrame, attempts: DataFrame) -> DataFrame:
    s = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
    a = attempts.join(sessions.select("session_id", "user_id"), "session_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    return users.join(s, "user_id", "left").join(a, "user_id", "left").na.fill(0, ["sessions", "attempts"])


def clear_user_history(tables: dict[str, DataFrame], user_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (attempts, sessions, review_queue) without one user's rows, and how many go. Archive the journal before writing them."""
    mine = tables["sessions"].where(F.col("user_id") == user_id).select("session_id")
    own = {"sessions": F.col("user_id") == user_id, "review_queue": F.col("user_id") == user_id}
    left = {n: t.where(~own[n] | F.col("user_id").isNull()) if n in own else t.join(mine, "session_id", "left_anti") for n, t in tables.items()}
    gone = [(n, t.where(own[n]) if n in own else t.join(mine, "session_id", "left_semi")) for n, t in tables.items()]
    report = None
    for name, t in gone:
        one = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        report = one if report is None else report.unionByName(one)
    return left, report
