"""Categories of questions and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions.tags import suggest_tags


def tag_untagged(questions: DataFrame, question_tags: DataFrame, only_unenriched: bool = True) -> DataFrame:
    """(question_id, tag) for questions(question_id, body, answer, enriched) that have no tag yet."""
    todo = questions.where(~F.col("enriched")) if only_unenriched else questions
    todo = todo.join(question_tags.select("question_id"), "question_id", "left_anti")
    return todo.select("question_id", F.explode(suggest_tags(F.col("body"), F.col("answer"))).alias("tag"))


def tag_sources(sources: DataFrame, source_texts: DataFrame, source_tags: DataFrame, kinds: tuple = ("studyguide", "index", "rules")) -> DataFrame:
    """(source_id, tag) for reading sources without tags, from title, URL and the beginning of the text."""
    todo = sources.where(F.col("kind").isin(*kinds)).join(source_tags.select("source_id"), "source_id", "left_anti").join(source_texts.select("source_id", "text"), "source_id", "left")
    hay = F.concat_ws(" ", "title", "url", F.substring("text", 1, 4000))
    return todo.select("source_id", F.explode(suggest_tags(hay)).alias("tag"))


def set_tags(question_tags: DataFrame, tags: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New tags (question_id, tag) replace the old ones of their questions; names are matched in any case, unknown ones become topics.

    Returns (question_tags, tags).
    """
    trimmed = new.select("question_id", F.trim("tag").alias("_name")).where("_name != ''")
    known = tags.select(F.lower("tag").alias("_low"), "tag")
    named = trimmed.withColumn("_low", F.lower("_name")).join(known, "_low", "left")
    spelled = named.groupBy("_low").agg(F.min("_name").alias("_new"))
    named = named.join(spelled, "_low").select("question_id", F.coalesce("tag", "_new").alias("tag")).distinct()
    fresh = spelled.join(known, "_low", "left_anti").select(F.col("_new").alias("tag"), F.lit("topic").alias("kind"))
    kept = question_tags.select("question_id", "tag").join(new.select("question_id").distinct(), "question_id", "left_anti")
    return kept.unionByName(named), tags.select("tag", "kind").unionByName(fresh)


def top_up_tags(model_tags: Column, text: Column, answer: Column) -> Column:
    """A model's categories; if fewer than two, keyword guesses up to three; five at most."""
    given = F.filter(model_tags, lambda t: F.trim(t) != "")
    few = F.size(given) < 2
    guesses = suggest_tags(F.when(few, text), F.when(few, answer))  # an empty text costs nothing to look through
    return F.slice(F.when(few, F.slice(F.array_union(given, guesses), 1, 3)).otherwise(given), 1, 5)
