"""Dashboards of practice: accuracy, recent sessions, weak areas, most missed questions, lock-outs. All users at once.

Tables: attempts(attempt_id, user_id, session_id, question_id, verdict, buzz_ordinal, clue_count, created_at),
sessions(session_id, user_id, started_at), question_tags(question_id, tag), questions(question_id, ...). Each report is
one aggregation (combined before the shuffle) or a rank within a user; rankings sort a user's own rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.operators.containment import contained


def is_correct() -> Column:
    return F.col("verdict") == "correct"


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def overview(attempts: DataFrame, sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """Per user: attempts, correct, accuracy, sessions, mean buzz position, and the size of the bank."""
    position = F.when(F.col("buzz_ordinal").isNotNull() & (F.col("clue_count") > 1), F.col("buzz_ordinal") / (F.col("clue_count") - 1))
    done = attempts.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(is_correct()).alias("correct"), F.round(F.avg(position), 6).alias("mean_buzz"))
    held = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
    bank = questions.agg(F.count(F.lit(1)).alias("bank_questions"), F.count_if(F.col("origin") == "official").alias("bank_official"))
    users = held.join(done, "user_id", "full").na.fill(0, ["attempts", "correct", "sessions"])
    # The bank's totals are one row: the only join without a key.
    return users.withColumn("accuracy", ratio(F.col("correct"), F.col("attempts"))).crossJoin(F.broadcast(bank))


def recent_sessions(attempts: DataFrame, sessions: DataFrame, limit: int = 12) -> DataFrame:
    """Per user the newest sessions that have an attempt."""
    counts = attempts.groupBy("session_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(is_correct()).alias("correct"))
    held = sessions.join(counts, "session_id")
    return top_per(held, ["user_id"], [F.desc("started_at"), F.desc("session_id")], limit)


def accuracy_by_tag(attempts: DataFrame, question_tags: DataFrame, min_attempts: int = 1) -> DataFrame:
    """Per user and tag; an attempt counts once for each of its question's tags. Counts per question are combined before the tags fan out."""
    per_question = attempts.groupBy("user_id", "question_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(is_correct()).alias("correct"))
    per_tag = per_question.join(question_tags, "question_id").groupBy("user_id", "tag").agg(F.sum("attempts").alias("attempts"), F.sum("correct").alias("correct"))
    return per_tag.where(F.col("attempts") >= min_attempts).withColumn("accuracy", ratio(F.col("correct"), F.col("attempts")))


def weak_areas(attempts: DataFrame, question_tags: DataFrame, min_attempts: int = 4, limit: int = 6) -> DataFrame:
    """Per user the worst tags below the user's own accuracy, each with the number of its questions that the user has not seen."""
    own = attempts.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(is_correct()).alias("_c")).select("user_id", ratio(F.col("_c"), F.col("_n")).alias("overall"))
    weak = accuracy_by_tag(attempts, question_tags, min_attempts).join(own, "user_id").where("accuracy < overall")
    weak = top_per(weak, ["user_id"], [F.asc("accuracy"), F.desc("attempts"), F.asc("tag")], limit)
    totals = question_tags.groupBy("tag").agg(F.countDistinct("question_id").alias("_all"))
    seen = attempts.select("user_id", "question_id").distinct().join(question_tags, "question_id").groupBy("user_id", "tag").agg(F.countDistinct("question_id").alias("_seen"))
    return weak.join(totals, "tag").join(seen, ["user_id", "tag"], "left").withColumn("unseen", F.col("_all") - F.coalesce("_seen", F.lit(0))).drop("_all", "_seen")


def tag_resources(tags: DataFrame, sources: DataFrame, source_tags: DataFrame, per_tag: int = 3, kinds: tuple = ("studyguide", "index", "rules"), states: tuple = ("fetched", "extracted", "parsed")) -> DataFrame:
    """Up to ``per_tag`` reading resources of each tag: sources with the tag, or with its name in their title.

    ``tags`` is the vocabulary, of any size: titles and tags meet by rare runs of characters, see contained().
    """
    usable = sources.where(F.col("kind").isin(*kinds) & F.col("status").isin(*states)).select("source_id", "title", "url")
    vocabulary = tags.select("tag").distinct()
    tagged = source_tags.join(usable, "source_id").join(vocabulary, "tag", "left_semi").select("tag", "source_id", "title", "url")
    titled = contained(usable, vocabulary, "title", "tag").select("tag", "source_id", "title", "url")
    return top_per(tagged.union(titled).distinct(), ["tag"], [F.asc("url"), F.asc("source_id")], per_tag)


def weak_areas_with_resources(attempts: DataFrame, question_tags: DataFrame, sources: DataFrame, source_tags: DataFrame, min_attempts: int = 4, limit: int = 6, per_tag: int = 3) -> DataFrame:
    """weak_areas() with ``resources``, an array of up to ``per_tag`` (title, url) in order of url; a source without a title has its URL instead. Areas without any have an empty array."""
    weak = weak_areas(attempts, question_tags, min_attempts, limit)
    named = tag_resources(question_tags, sources, source_tags, per_tag).select("tag", F.struct("rank", F.coalesce("title", "url").alias("title"), "url").alias("_r"))
    listed = named.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list("_r")), lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"))).alias("resources"))
    none = F.filter(F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("url"))), lambda r: F.lit(False))
    return weak.join(listed, "tag", "left").withColumn("resources", F.coalesce("resources", none))


def most_missed(attempts: DataFrame, limit: int = 10) -> DataFrame:
    """Per user the questions most often not answered correctly."""
    per = attempts.groupBy("user_id", "question_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~is_correct()).alias("misses")).where("misses > 0")
    return top_per(per, ["user_id"], [F.desc("misses"), F.desc("attempts"), F.asc("question_id")], limit)


def attempt_counts_by_user(users: DataFrame, sessions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Sessions and attempts of each user, including users without any."""
    s = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
    a = attempts.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    return users.select("user_id").join(s, "user_id", "left").join(a, "user_id", "left").na.fill(0, ["sessions", "attempts"])


def failed_attempt_lockouts(events: DataFrame, threshold: int = 8, minutes: int = 15) -> DataFrame:
    """Failures (user_id, ts, failed) at which a user had ``threshold`` failures in the minutes up to them, none before a success counted.

    Times count in whole seconds; the window leaves out the moment exactly ``minutes`` earlier.
    """
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = events.withColumn("_second", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("_reset", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(by_time))
    trailing = Window.partitionBy("user_id", "_reset").orderBy("_second").rangeBetween(-(60 * minutes - 1), 0)
    return at.where("failed").withColumn("failures", F.count(F.lit(1)).over(trailing)).where(F.col("failures") >= threshold).drop("_second", "_reset")
