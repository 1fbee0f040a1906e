"""Bulk grading of attempts. The ladder runs once per answer candidate, then the best candidate decides; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions.grading import judge_candidate, normalize_response, tokenize_answer


def judge_offline(pairs: DataFrame, key: list[str] = ("attempt_id",)) -> DataFrame:
    """pairs(key, response, answer, alternates) to (key, decided, verdict, judged_by, reason).

    Candidates are exploded with their normal forms, so that each expression stays small. The ladder is the costly part, and a table of
    pairs may come in few tasks, so pairs are dealt by their key first; a key's candidates stand together then and need no other shuffle.
    """
    pairs = pairs.repartition(*key)
    said = pairs.select(*key, F.trim("response").alias("_r"), F.explode_outer(F.filter(F.concat(F.array("answer"), F.coalesce("alternates", F.array().cast("array<string>"))), lambda a: a.isNotNull() & (a != ""))).alias("_c"))
    forms = said.select(*key, "_r", normalize_response(F.col("_r")).alias("_rn"), tokenize_answer(F.col("_r")).alias("_rt"), normalize_response(F.col("_c")).alias("_cn"), tokenize_answer(F.col("_c")).alias("_ct"))
    judged = forms.select(*key, "_r", judge_candidate(F.col("_rn"), F.col("_rt"), F.col("_cn"), F.col("_ct")).alias("_j"))
    open_ = F.col("_j.rank") == 4
    best = judged.groupBy(*key).agg(
        F.first("_r").alias("_r"), F.min(F.col("_j.rank")).alias("_rank"), F.min_by("_j.reason", "_j.rank").alias("_why"),
        F.max(F.when(open_, F.col("_j.shared"))).alias("_shared"), F.max(F.when(open_, F.col("_j.close"))).alias("_close"), F.count("_j.rank").alias("_n"),
    )
    blank, rank, shared = F.coalesce(F.col("_r"), F.lit("")) == "", F.col("_rank"), F.coalesce("_shared", F.lit(False))
    lost = (rank == 4) & ~shared & (F.coalesce("_close", F.lit(0.0)) < 0.55)
    decided = blank | rank.isin(0, 1, 2, 3, 5) | lost
    return best.select(
        *key, decided.alias("decided"), F.when(~blank & rank.isin(0, 1, 2, 3), "correct").when(decided, "incorrect").alias("verdict"), F.when(blank | (rank == 0), "exact").when(decided, "fuzzy").alias("judged_by"),
        F.when(blank, "no answer given").when(rank == 5, "the number in the answer does not match").when(lost, "no overlap").when(rank == 4, F.when(shared, "partial token overlap").otherwise("close spelling")).otherwise(F.col("_why")).alias("reason"),
    )


def resolve_undecided(judged: DataFrame, model: DataFrame | None = None, key: list[str] = ("attempt_id",)) -> DataFrame:
    """Every verdict decided: by a model's verdict table (key, verdict, reason) where it has a row, else leniently by shared words."""
    if model is not None:
        judged = judged.join(model.select(*key, F.col("verdict").alias("_mv"), F.col("reason").alias("_mr")), list(key), "left")
    else:
        judged = judged.withColumns({"_mv": F.lit(None).cast("string"), "_mr": F.lit(None).cast("string")})
    lenient = F.when(F.col("reason") == "partial token overlap", "correct").otherwise("incorrect")
    done, ours = F.col("decided"), F.col("_mv").isNotNull()
    return judged.select(
        *key, F.when(done, F.col("verdict")).otherwise(F.coalesce("_mv", lenient)).alias("verdict"), F.when(done, F.col("judged_by")).when(ours, "llm").otherwise("fuzzy").alias("judged_by"),
        F.when(done, F.col("reason")).when(ours, F.col("_mr")).otherwise(F.concat("reason", F.lit(" (judged offline)"))).alias("reason"),
    )


def grade_attempts(attempts: DataFrame, questions: DataFrame, sessions: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """attempts(attempt_id, user_id, session_id, question_id, response, timed_out) with verdict, judged_by, reason; rejects have verdict null and say why.

    A session must be the user's own and the question must exist. Timeouts are timeouts; multiple-choice answers are compared by label.
    """
    owned = sessions.select("session_id", F.col("user_id").alias("_owner"))
    known = questions.select("question_id", "type", "answer", "answer_alternates", "correct_label")
    rows = attempts.join(owned, "session_id", "left").join(known, "question_id", "left")
    refused: Column = F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id")), "not this user's session").when(F.col("type").isNull(), "unknown question")
    rows = rows.withColumn("_refused", refused)
    spoken = rows.where("_refused is null and not timed_out and type != 'mcq'").select("attempt_id", "response", "answer", F.col("answer_alternates").alias("alternates"))
    judged = resolve_undecided(judge_offline(spoken), model).select("attempt_id", F.col("verdict").alias("_v"), F.col("judged_by").alias("_b"), F.col("reason").alias("_w"))
    rows = rows.join(judged, "attempt_id", "left")
    right = F.upper(F.trim("response")) == F.upper("correct_label")
    ok, late, mcq = F.col("_refused").isNull(), F.col("timed_out"), F.col("type") == "mcq"
    return rows.select(
        "attempt_id", "user_id", "session_id", "question_id",
        F.when(ok & late, "timeout").when(ok & mcq, F.when(right, "correct").otherwise("incorrect")).when(ok, F.col("_v")).alias("verdict"),
        F.when(ok & (late | mcq), "exact").when(ok, F.col("_b")).alias("judged_by"), F.when(~ok, F.col("_refused")).when(late, "no buzz").when(mcq, "option label").otherwise(F.col("_w")).alias("reason"),
    )
