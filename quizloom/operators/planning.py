"""What to ask a language model for, and what to take from its answers. Models are called elsewhere; requests and responses are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.text import collapse_spaces, normalize_answer
from quizloom.operators.containment import contained
from quizloom.operators.dedup import find_near_duplicates
from quizloom.operators.ranks import ranked

DIFFICULTIES = ("elementary", "middle", "high", "open")
SLICE = 5
# Words that no study topic begins with, words of competitions, and words of page furniture.
STOP_WORDS = [
    "the", "this", "that", "these", "those", "there", "then", "they", "their", "however", "additionally", "during", "after", "before", "while",
    "although", "welcome", "dear", "other", "many", "most", "some", "both", "each", "also", "for", "from", "with", "when", "where", "which", "who",
    "what", "his", "her", "its", "one", "two", "first", "second", "third", "part", "topics", "history", "middle", "high", "school", "please", "see",
    "note", "and", "but", "not",
]
ORGANISATION = r"(?i)\b(bee|bowl|olympiad|iac|ihbb|academic|competitions?|tournament|regional|nationals?|championships?|qualifier|round|packet|guide|set|junior|varsity|worldwide|events?|online|website|email|register)\b"
FURNITURE = r"(?i)\b(chapter|part \d|study guide|see also|page|www\.|http|tournament|competitors?|students?|coaches|division|the following|etc)\b|[?!:;]"
CONNECTORS = "of|the|and|de|von|van"


def enrichment_requests(questions: DataFrame, clues: DataFrame, options: DataFrame, limit: int | None = None, batch: int = 500) -> DataFrame:
    """(question_id, custom_id, batch_no, payload) for questions not yet enriched, the lowest ids first.

    Batches hold exactly ``batch`` questions whatever the gaps in ids, but for the last; they are numbered from 0 by ranks over all ids.
    """
    todo = questions.where(~F.col("enriched"))
    if limit is not None:
        todo = todo.orderBy("question_id").limit(limit)
    lines = clues.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.concat(F.lit("["), "tier", F.lit("] "), "text").alias("line")))).alias("_c"))
    labels = options.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("label", F.concat("label", F.lit(". "), "text").alias("line")))).alias("_o"))
    rows = todo.join(lines, "question_id", "left").join(labels, "question_id", "left")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    tossup = F.concat(F.lit("Question type: pyramidal tossup\n\n"), F.coalesce(joined("_c"), F.lit("")), F.lit("\n\nANSWER: "), "answer")
    choice = F.concat(F.lit("Question type: multiple choice\n\n"), F.coalesce("stem", F.lit("")), F.lit("\n"), F.coalesce(joined("_o"), F.lit("")), F.lit("\n\nCorrect answer: "), "answer")
    rows = rows.select("question_id", F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("custom_id"), F.when(F.col("type") == "tossup", tossup).otherwise(choice).alias("payload"))
    return ranked(rows, ["question_id"]).select("question_id", "custom_id", F.floor((F.col("rank") - 1) / batch).cast("long").alias("batch_no"), "payload")


RESPONSE = "categories array<string>, difficulty string, explanation string, answer_alternates array<string>"


def parse_responses(results: DataFrame, schema: str = RESPONSE) -> DataFrame:
    """results(custom_id, result_type, stop_reason, text): succeeded, not refused, valid JSON; ``data`` is null otherwise."""
    usable = (F.col("result_type") == "succeeded") & (F.coalesce("stop_reason", F.lit("")) != "refusal")
    valid = F.get_json_object("text", "$").isNotNull()
    return results.select("custom_id", F.when(usable & valid, F.from_json("text", schema)).alias("data"))


def apply_enrichment(questions: DataFrame, question_tags: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, question_tags, report) after the model's answers (custom_id, data).

    An answer needs a category and an explanation; unknown difficulties become middle, alternates are added to the old ones
    in order, tags are replaced.
    """
    data = responses.select(F.col("custom_id"), F.slice("data.categories", 1, 5).alias("_cats"), F.trim("data.explanation").alias("_why"), F.col("data.difficulty").alias("_diff"), F.filter("data.answer_alternates", lambda a: F.trim(a) != "").alias("_alt"))
    data = data.where((F.size("_cats") > 0) & (F.coalesce("_why", F.lit("")) != "")).dropDuplicates(["custom_id"])
    rows = questions.withColumn("custom_id", F.concat(F.lit("q"), F.col("question_id").cast("string"))).join(data, "custom_id", "left")
    hit = F.col("_cats").isNotNull()
    no = F.array().cast("array<string>")
    out = rows.withColumns({
        "difficulty": F.when(hit, F.when(F.col("_diff").isin(*DIFFICULTIES), F.col("_diff")).otherwise("middle")).otherwise(F.col("difficulty")),
        "explanation": F.when(hit, F.col("_why")).otherwise(F.col("explanation")),
        "answer_alternates": F.when(hit, F.array_distinct(F.concat(F.coalesce("answer_alternates", no), F.coalesce("_alt", no)))).otherwise(F.col("answer_alternates")),
        "_was": F.col("enriched"), "enriched": F.col("enriched") | hit,
    })
    new_tags = out.where(hit).select("question_id", F.explode(F.array_distinct("_cats")).alias("tag"))
    tags = question_tags.join(new_tags.select("question_id").distinct(), "question_id", "left_anti").unionByName(new_tags)
    report = out.agg(F.count_if(~F.col("_was")).alias("submitted"), F.count_if(hit).alias("applied"), F.count_if(~F.col("_was") & ~hit).alias("failed"))
    return out.select(*questions.columns), tags, report


def pending_count(questions: DataFrame) -> DataFrame:
    return questions.agg(F.count_if(~F.col("enriched")).alias("pending"))


def grounding_excerpts(tags: DataFrame, sources: DataFrame, source_texts: DataFrame, source_tags: DataFrame, budget: int = 6000, longest: int = 2500, most: int = 4, fallback: int = 3) -> DataFrame:
    """(tag, rank, source_id, name, excerpt): for each tag excerpts of allowed reading sources with the tag or its name in the title, else of any guides.

    Only sources that may be used for training. Texts are cut before anything is shuffled; a tag's excerpts together keep to the budget.
    """
    free = sources.where(F.col("ai_train_ok") & F.col("kind").isin("studyguide", "index")).select("source_id", "kind", "title", "url")
    vocabulary = tags.select("tag").distinct()
    hits = free.join(source_tags, "source_id").join(vocabulary, "tag", "left_semi").select("tag", "source_id", "title", "url")
    hits = hits.union(contained(free, vocabulary, "title", "tag").select("tag", "source_id", "title", "url")).distinct()
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy("source_id"))).where(F.col("rank") <= most)
    guides = free.where("kind = 'studyguide'").orderBy("source_id").limit(fallback)
    bare = tags.select("tag").distinct().join(hits.select("tag").distinct(), "tag", "left_anti").crossJoin(F.broadcast(guides.select("source_id", "title", "url")))
    bare = bare.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy("source_id")))
    chosen = ranked.unionByName(bare)
    texts = source_texts.join(chosen.select("source_id").distinct(), "source_id", "left_semi").select("source_id", F.substring("text", 1, longest).alias("_cut"))
    rows = chosen.join(texts, "source_id").where(F.trim("_cut") != "")
    before = F.coalesce(F.sum(F.length("_cut")).over(Window.partitionBy("tag").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_room", F.lit(budget) - before).where("_room > 0")
    return rows.select("tag", "rank", "source_id", F.coalesce(F.nullif("title", F.lit("")), "url").alias("name"), F.trim(F.substr("_cut", F.lit(1), F.col("_room").cast("int"))).alias("excerpt"))


def existing_answers(questions: DataFrame, question_tags: DataFrame, limit: int = 120) -> DataFrame:
    """(tag, answer, rank): each tag's distinct answers, the newest question first."""
    newest = questions.join(question_tags, "question_id").groupBy("tag", "answer").agg(F.max("question_id").alias("_id"))
    return newest.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("_id"), F.asc("answer")))).where(F.col("rank") <= limit).drop("_id")


def generation_plan(tags: DataFrame, fmt: str, per_tag: int | Column) -> DataFrame:
    """(custom_id, tag, fmt, count): each tag's number in requests of five."""
    n = F.lit(per_tag) if isinstance(per_tag, int) else per_tag
    rows = tags.select("tag", n.alias("_n")).where("_n > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / SLICE).cast("int") - 1)))
    name = F.concat_ws("-", F.lit("gen"), F.regexp_replace(F.lower("tag"), r"\s+", "-"), F.lit(fmt), "slice")
    return rows.select(name.alias("custom_id"), "tag", F.lit(fmt).alias("fmt"), F.least(F.lit(SLICE), F.col("_n") - SLICE * F.col("slice")).cast("int").alias("count"))


def coverage_gap_plan(tags: DataFrame, questions: DataFrame, question_tags: DataFrame, *, target: int, fmt: str = "tossup", per_round: int = 60, headroom: float = 1.45) -> DataFrame:
    """(tag, generated, place, per_tag): the next round: tags with the fewest generated questions of the format first; no rows once the target is met."""
    made = questions.where((F.col("origin") == "generated") & (F.col("type") == fmt)).select("question_id")
    have = made.join(question_tags, "question_id").groupBy("tag").agg(F.count(F.lit(1)).alias("generated"))
    totals = made.agg(F.count(F.lit(1)).alias("_made")).crossJoin(tags.agg(F.count(F.lit(1)).alias("_tags")))
    rows = tags.select("tag").join(have, "tag", "left").na.fill(0, ["generated"]).crossJoin(F.broadcast(totals)).where(F.col("_made") < target)
    wanted = F.ceil(F.floor((target - F.col("_made")) * headroom) / F.col("_tags"))
    place = F.row_number().over(Window.orderBy("generated", "tag"))  # over the vocabulary, a dimension of bounded size
    return rows.select("tag", "generated", place.alias("place"), F.greatest(F.lit(2), F.least(F.lit(per_round), wanted)).cast("int").alias("per_tag"))


def rounds_to_run(added: list[int], start: int, target: int) -> bool:
    """Whether another round is due after rounds that added so many: not at the target, nor after two rounds in a row that added nothing."""
    return start + sum(added) < target and not (len(added) >= 2 and added[-1] == added[-2] == 0)


ITEM = (
    "leadin string, middle array<string>, giveaway string, answer string, answer_alternates array<string>, stem string, options array<struct<label:string,text:string>>, correct_label string, "
    "explanation string, categories array<string>"
)


def validate_generated(items: DataFrame, fmt: str, bank: DataFrame | None = None, min_score: float = 8.0) -> DataFrame:
    """items(item_id, json) with reason (null: accepted), answer, body and, by format, clues or options.

    A tossup needs lead-in, giveaway and answer; a multiple-choice question a stem, four options and one correct. Near
    duplicates of the bank (question_id, type, answer, body) are rejected.
    """
    d = items.select("item_id", F.from_json("json", ITEM).alias("d"))
    text = lambda c: F.trim(F.coalesce(F.col(f"d.{c}"), F.lit("")))
    if fmt == "tossup":
        middles = F.slice(F.filter(F.transform(F.coalesce("d.middle", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda m: m != ""), 1, 3)
        one = lambda tier, t: F.array(F.struct(F.lit(tier).alias("tier"), t.alias("text")))
        clues = F.concat(one("leadin", text("leadin")), F.transform(middles, lambda m: F.struct(F.lit("middle").alias("tier"), m.alias("text"))), one("giveaway", text("giveaway")))
        rows = d.select("item_id", text("answer").alias("answer"), clues.alias("clues")).withColumn("body", F.array_join(F.transform("clues", lambda c: c["text"]), " "))
        whole = (F.col("answer") != "") & ~F.exists("clues", lambda c: c["text"] == "")
        reason = F.when(~whole, "incomplete tossup")
    else:
        options = F.transform(F.coalesce("d.options", F.array().cast("array<struct<label:string,text:string>>")), lambda o: F.struct(F.upper(F.trim(o["label"])).alias("label"), F.trim(o["text"]).alias("text")))
        options = F.filter(options, lambda o: (F.coalesce(o["label"], F.lit("")) != "") & (F.coalesce(o["text"], F.lit("")) != ""))
        marked = F.transform(options, lambda o: F.struct(o["label"].alias("label"), o["text"].alias("text"), F.coalesce(o["label"] == F.col("d.correct_label"), F.lit(False)).alias("is_correct")))
        rows = d.select("item_id", text("stem").alias("body"), marked.alias("options"))
        right = F.filter("options", lambda o: o["is_correct"])
        rows = rows.withColumn("answer", F.get(right, F.lit(0))["text"])
        reason = F.when((F.col("body") == "") | (F.size("options") != 4) | (F.size(right) != 1), "incomplete multiple-choice question")
    rows = rows.withColumns({"reason": reason, "origin": F.lit("generated")})
    if bank is None:
        return rows
    fresh = rows.where("reason is null").select(F.col("item_id").alias("question_id"), F.lit(fmt).alias("type"), "answer", "body")
    near = find_near_duplicates(fresh, bank, min_score).select(F.col("question_id").alias("item_id"), "duplicate_of")
    return rows.join(near, "item_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("duplicate_of").isNotNull(), "near duplicate")))


def topic_ok(topic: Column) -> Column:
    """Whether a phrase can be a subject: short, capitalised, no prose, furniture, organisation or heading."""
    letters = F.length(F.regexp_replace(topic, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(topic, r"[^\p{Lu}]", ""))
    words = F.split(topic, " ")
    return (
        (topic != "") & (F.size(words) <= 8) & ~topic.rlike(FURNITURE) & topic.rlike(r"^[A-Z0-9][\p{L}\p{N}_'&.,()\- /]{2,58}$")
        & ~F.lower(F.get(words, F.lit(0))).isin(STOP_WORDS) & ~topic.rlike(ORGANISATION) & ((letters == 0) | (capitals <= 0.7 * letters))
    )


def study_topics(texts: DataFrame, limit: int = 4000, include_prose: bool = False) -> DataFrame:
    """(topic, source_id, line, pos): subjects listed as bullets in texts(source_id, text), where each stands first; the earliest ``limit``.

    ``include_prose`` adds runs of two capitalised words or more outside bullets.
    """
    tidy = lambda t: F.regexp_replace(collapse_spaces(t), r"^[ \-–•.,]+|[ \-–•.,]+$", "")
    # What is exploded is trimmed and tidied before: a filter on it then names a value, where it would compute it each time that it names it.
    lines = texts.select("source_id", F.posexplode(F.transform(F.split("text", r"\n"), lambda t: F.trim(t))).alias("line", "_l"))
    bullets = lines.where(F.col("_l").rlike("^[-•–]")).select("source_id", "line", F.posexplode(F.transform(F.split("_l", r"(?:^|\s)[-•–]\s+"), tidy)).alias("pos", "topic"))
    found = bullets
    if include_prose:
        run = rf"\b[A-Z][a-zA-Z'\-]{{2,}}(?:\s+(?:{CONNECTORS})\s+[A-Z][a-zA-Z'\-]{{2,}}|\s+[A-Z][a-zA-Z'\-]{{2,}}){{1,3}}\b"
        prose = lines.where(~F.col("_l").rlike("^[-•–]")).select("source_id", "line", F.posexplode(F.transform(F.regexp_extract_all("_l", F.lit(run), F.lit(0)), tidy)).alias("pos", "topic"))
        found = found.unionByName(prose)
    topics = found.select("topic", "source_id", "line", "pos").where(topic_ok(F.col("topic")))
    first = topics.groupBy("topic").agg(F.min(F.struct("source_id", "line", "pos")).alias("_f")).select("topic", "_f.*")
    return first.orderBy("source_id", "line", "pos", "topic").limit(limit)


def unused_topics(topics: DataFrame, questions: DataFrame, fmt: str = "tossup") -> DataFrame:
    """Topics that are no answer yet of a question of this format."""
    taken = questions.where(F.col("type") == fmt).select(normalize_answer(F.col("answer")).alias("_k")).distinct()
    return topics.withColumn("_k", normalize_answer(F.col("topic"))).join(taken, "_k", "left_anti").drop("_k")


def topic_requests(topics: DataFrame, needed: int) -> DataFrame:
    """(slice, count, listing): the first int(1.6 needed) + 5 topics as numbered lists of five. The number needed bounds the rows."""
    head = topics.orderBy("source_id", "line", "pos", "topic").limit(int(needed * 1.6) + 5)
    placed = head.withColumn("_n", F.row_number().over(Window.orderBy("source_id", "line", "pos", "topic")) - 1)
    placed = placed.select(F.floor(F.col("_n") / SLICE).cast("int").alias("slice"), (F.col("_n") % SLICE + 1).alias("_i"), "topic")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "topic"))), lambda x: F.concat(x["_i"].cast("string"), F.lit(". "), x["topic"]))
    return placed.groupBy("slice").agg(F.count(F.lit(1)).alias("count"), F.array_join(listed, "\n").alias("listing"))
