"""Spaced repetition and the choice of next questions. Each is a fold or a rank over one user's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.operators.ranks import ranked

MISSES = ("incorrect", "timeout")
FIRST_EASE, LEAST_EASE, MOST_EASE, LONGEST = 2.5, 1.3, 3.0, 180.0


def review_step(state: Column, attempt: Column, day: Column | None = None) -> Column:
    """The schedule entry after one more attempt: struct(active, interval, ease, lapses, due); ``day`` is one in the unit of the attempt's time, if that is a number."""
    day = F.expr("INTERVAL '1' DAY") if day is None else day
    missed = attempt["verdict"].isin(*MISSES)
    grown = F.least(F.lit(LONGEST), F.greatest(F.lit(1.0), F.floor(state["interval"] * state["ease"] + 0.5).cast("double")))
    done = state["active"] & ~missed & (grown >= LONGEST)
    interval = F.when(missed, 1.0).when(state["active"], grown).otherwise(state["interval"])
    ease = F.when(missed & ~state["active"], FIRST_EASE).when(missed, F.greatest(F.lit(LEAST_EASE), state["ease"] - 0.2)).when(state["active"], F.least(F.lit(MOST_EASE), state["ease"] + 0.05)).otherwise(state["ease"])
    lapses = F.when(missed & ~state["active"], 1).when(missed, state["lapses"] + 1).otherwise(state["lapses"])
    active = (missed | state["active"]) & ~done
    touched = missed | state["active"]
    due = F.when(touched, attempt["at"] + interval.cast("int") * day).otherwise(state["due"])
    return F.struct(active.alias("active"), interval.alias("interval"), ease.alias("ease"), lapses.cast("int").alias("lapses"), due.alias("due"))


def sm2_schedule(attempts: DataFrame) -> DataFrame:
    """Per (user, question) the live schedule entry after all attempts in time order: interval_days, ease, lapses, due_at.

    A fold over the pair's own attempts, which are few; entries that reach the longest interval leave the schedule.
    """
    history = F.array_sort(F.collect_list(F.struct(F.col("created_at").alias("at"), F.col("attempt_id").alias("id"), F.col("verdict"))))
    start = F.struct(F.lit(False).alias("active"), F.lit(0.0).alias("interval"), F.lit(FIRST_EASE).alias("ease"), F.lit(0).alias("lapses"), F.lit(None).cast(attempts.schema["created_at"].dataType).alias("due"))
    folded = attempts.groupBy("user_id", "question_id").agg(history.alias("_h")).withColumn("_s", F.aggregate("_h", start, lambda s, a: review_step(s, a)))
    return folded.where("_s.active").select("user_id", "question_id", F.col("_s.interval").alias("interval_days"), F.round("_s.ease", 6).alias("ease"), F.col("_s.lapses").alias("lapses"), F.col("_s.due").alias("due_at"))


def rebuild_review_queue(attempts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Entries for pairs whose latest attempt is a miss: ease by the number of misses, one day. Pairs in ``existing`` are left alone."""
    latest = F.max_by("verdict", F.struct("created_at", "attempt_id"))
    misses = F.count_if(F.col("verdict").isin(*MISSES))
    out = attempts.groupBy("user_id", "question_id").agg(latest.alias("_last"), misses.alias("_m"), F.max("created_at").alias("_at")).where(F.col("_last").isin(*MISSES))
    out = out.select(
        "user_id", "question_id", F.lit(1.0).alias("interval_days"), F.round(F.greatest(F.lit(LEAST_EASE), FIRST_EASE - 0.2 * F.greatest(F.lit(0), F.col("_m") - 1)), 6).alias("ease"),
        F.col("_m").cast("int").alias("lapses"), (F.col("_at") + F.expr("INTERVAL '1' DAY")).alias("due_at"),
    )
    return out if existing is None else out.join(existing.select("user_id", "question_id"), ["user_id", "question_id"], "left_anti")


def review_counts(queue: DataFrame, as_of: Column) -> DataFrame:
    return queue.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("due_at") <= as_of).alias("due"))


def review_list(queue: DataFrame, questions: DataFrame, as_of: Column, limit: int = 12) -> DataFrame:
    """Per user the entries due soonest, with the question's stem or last clue, and whether they are overdue."""
    ranked = queue.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("due_at", "question_id"))).where(F.col("rank") <= limit)
    prompt = F.coalesce("stem", F.get("clues", F.size("clues") - 1)["text"]) if "clues" in questions.columns else F.col("stem")
    return ranked.join(questions.select("question_id", prompt.alias("prompt"), "answer"), "question_id").withColumn("overdue", F.col("due_at") <= as_of)


def filter_questions(questions: DataFrame, question_tags: DataFrame | None = None, *, qtype: str | None = None, origin: str = "both", difficulty: str = "any", tags: list[str] = ()) -> DataFrame:
    """Questions of a format, an origin, a difficulty, and with any of the tags (compared without regard to case)."""
    out = questions
    if qtype:
        out = out.where(F.col("type") == qtype)
    if origin != "both":
        out = out.where(F.col("origin") == origin)
    if difficulty != "any":
        out = out.where(F.col("difficulty") == difficulty)
    if tags:
        out = out.join(question_tags.where(F.lower("tag").isin(*[t.lower() for t in tags])), "question_id", "left_semi")
    return out


def count_available(filtered: DataFrame, excluded: int) -> DataFrame:
    return filtered.agg(F.count(F.lit(1)).alias("total"), F.greatest(F.count(F.lit(1)) - excluded, F.lit(0)).alias("remaining"))


def count_by_tag(filtered: DataFrame, question_tags: DataFrame, tags: list[str] = ()) -> DataFrame:
    """Rows (tag, questions): for each tag how many of the filtered questions have it, and under a null tag how many have any of ``tags``."""
    per_tag = filtered.join(question_tags, "question_id").groupBy("tag").agg(F.countDistinct("question_id").alias("questions"))
    total = filter_questions(filtered, question_tags, tags=list(tags)).agg(F.lit(None).cast("string").alias("tag"), F.count(F.lit(1)).alias("questions"))
    return per_tag.unionByName(total)


def due_questions(queue: DataFrame, filtered: DataFrame, as_of: Column, excluded: DataFrame | None = None) -> DataFrame:
    """Per user the due questions, the longest due first, by ``rank``; ``excluded``: (user_id, question_id) not to ask."""
    due = queue.where(F.col("due_at") <= as_of).join(filtered.select("question_id"), "question_id", "left_semi")
    if excluded is not None:
        due = due.join(excluded, ["user_id", "question_id"], "left_anti")
    return due.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("due_at", "question_id"))).select("user_id", "question_id", "due_at", "rank")


def draw(seed: int, *columns: str) -> Column:
    """60 bits of MD5 of the seed and these columns: a draw that any engine repeats."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def fresh_questions(users: DataFrame, filtered: DataFrame, attempts: DataFrame, k: int, seed: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """Per user k questions: those never attempted first, then the least and the longest ago attempted, ties by a seeded hash.

    Users times questions would be a product that grows with both. A user needs at most k unattempted questions and those
    attempted (and excluded ones less): so each user gets the first k + a + e questions in the user's own cyclic order of a hash-sorted list, where
    a and e count attempted and excluded ones. The order among unattempted questions is that cyclic order.
    """
    listed = ranked(filtered.select("question_id", draw(seed, "question_id").alias("_h")), ["_h", "question_id"], "_place").select("question_id", (F.col("_place") - 1).alias("_place"))
    total = filtered.count()
    known = attempts.join(filtered.select("question_id"), "question_id", "left_semi").groupBy("user_id", "question_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
    out = excluded if excluded is not None else known.select("user_id", "question_id").limit(0)
    spare = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("_a")).join(out.groupBy("user_id").agg(F.count(F.lit(1)).alias("_e")), "user_id", "full")
    want = F.least(F.lit(total), k + F.coalesce("_a", F.lit(0)) + F.coalesce("_e", F.lit(0)))
    starts = users.select("user_id").distinct().join(spare, "user_id", "left").select("user_id", (draw(seed, "user_id") % F.lit(max(total, 1))).alias("_start"), want.alias("_want")).where("_want > 0")
    offered = starts.select("user_id", "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_want").cast("long") - 1)).alias("_k"))
    offered = offered.select("user_id", "_k", F.pmod(F.col("_start") + F.col("_k"), F.lit(max(total, 1))).alias("_place")).join(listed, "_place").select("user_id", "question_id", "_k")
    fresh = offered.join(known.select("user_id", "question_id"), ["user_id", "question_id"], "left_anti").select("user_id", "question_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast(attempts.schema["created_at"].dataType).alias("last_at"), "_k")
    both = fresh.unionByName(known.withColumn("_k", draw(seed, "user_id", "question_id") % F.lit(1 << 40))).join(out, ["user_id", "question_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("n", F.asc_nulls_first("last_at"), "_k", "question_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("user_id", "question_id", F.col("n").alias("attempts"), "rank")


def next_questions(mode: str, due: DataFrame, fresh: DataFrame, k: int) -> DataFrame:
    """Per user k questions: due ones, then fresh ones (mixed); or only one kind (review, fresh)."""
    parts = {"review": [due], "fresh": [fresh], "mixed": [due, fresh]}[mode]
    rows = [p.select("user_id", "question_id", F.lit(i).alias("_part"), F.col("rank").alias("_rank")) for i, p in enumerate(parts)]
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    once = both.groupBy("user_id", "question_id").agg(F.min(F.struct("_part", "_rank")).alias("_o"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("_o", "question_id"))).where(F.col("rank") <= k).drop("_o")


def hydrate(questions: DataFrame, question_tags: DataFrame, clues: DataFrame, options: DataFrame, sources: DataFrame) -> DataFrame:
    """Questions with their sorted tags, clues in order, options without the solution, and their source: three grouped joins."""
    t = question_tags.groupBy("question_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    c = clues.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tier", "text"))).alias("clues"))
    o = options.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("label", "text"))).alias("options"))
    s = sources.select("source_id", F.col("title").alias("source_title"), F.col("url").alias("source_url"))
    return questions.join(t, "question_id", "left").join(c, "question_id", "left").join(o, "question_id", "left").join(s, "source_id", "left")


def reveal(questions: DataFrame, options: DataFrame) -> DataFrame:
    """What is shown after an answer: the answer, alternates, explanation and the correct label."""
    right = options.where("is_correct").groupBy("question_id").agg(F.min("label").alias("correct_label"))
    return questions.select("question_id", "answer", "answer_alternates", "explanation").join(right, "question_id", "left")
