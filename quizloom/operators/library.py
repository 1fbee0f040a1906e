"""The source library: faceted browsing, restricted hosts, and reports on the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_sources(sources: DataFrame, question_sources: DataFrame, questions: DataFrame, *, host: str = "all", kind: str = "all", status: str = "all", search: str = "", page: int = 1, per_page: int = 25) -> DataFrame:
    """One page of the sources that match, those with the most questions first; the page number is kept within bounds.

    ``search`` is a literal part of title or URL, in any case. Places in the list come from counts of each coverage value and ranks
    within a coverage value's rows that the page needs, so no task sorts the whole library.
    """
    found = sources
    for column, wanted in (("host", host), ("kind", kind), ("status", status)):
        if wanted != "all":
            found = found.where(F.col(column) == wanted)
    if search:
        found = found.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(search.lower())) | F.contains(F.lower("url"), F.lit(search.lower())))
    cover = question_sources.groupBy("source_id").agg(F.countDistinct("question_id").alias("coverage"))
    given = questions.groupBy("source_id").agg(F.count(F.lit(1)).alias("contributed"))
    found = found.join(cover, "source_id", "left").join(given, "source_id", "left").na.fill(0, ["coverage", "contributed"])
    total = found.count()
    page = min(max(1, page), max(1, -(-total // per_page)))
    # Page p of n rows is the end of the first p * n rows: two top-k steps, which Spark does per partition first.
    head = found.orderBy(F.desc("coverage"), F.asc("source_id")).limit(page * per_page)
    last = min(total, page * per_page) - (page - 1) * per_page
    tail = head.orderBy(F.asc("coverage"), F.desc("source_id")).limit(max(last, 0))
    return tail.withColumns({"page": F.lit(page), "total": F.lit(total).cast("long")})


def facets(sources: DataFrame) -> DataFrame:
    """(facet, name, sources): counts by host, kind and status over the unfiltered table, in one pass."""
    sets = sources.groupingSets([["host"], ["kind"], ["status"]], "host", "kind", "status").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("sources"))
    facet = F.when(F.col("_g") == 3, "host").when(F.col("_g") == 5, "kind").otherwise("status")
    return sets.select(facet.alias("facet"), F.when(F.col("_g") == 3, F.col("host")).when(F.col("_g") == 5, F.col("kind")).otherwise(F.col("status")).alias("name"), "sources")


def restricted_hosts(sources: DataFrame) -> DataFrame:
    """Hosts of which any source may not be used for training."""
    return sources.groupBy("host").agg(F.bool_or(~F.col("ai_train_ok")).alias("restricted")).where("restricted").select("host")


def restricted_propagation(sources: DataFrame) -> DataFrame:
    """Each source with its host's restriction. Hosts are combined before the shuffle; a hot host is only joined, never collected."""
    return sources.join(restricted_hosts(sources).withColumn("host_restricted", F.lit(True)), "host", "left").na.fill(False, ["host_restricted"])


def source_summary(sources: DataFrame, question_sources: DataFrame, questions: DataFrame) -> DataFrame:
    base = sources.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("host").alias("hosts"))
    covering = question_sources.agg(F.countDistinct("source_id").alias("with_questions"))
    asked = questions.agg(F.count_if(F.col("source_id").isNotNull()).alias("questions_with_source"))
    barred = sources.join(restricted_hosts(sources), "host", "left_semi").agg(F.count(F.lit(1)).alias("restricted"))
    return base.crossJoin(covering).crossJoin(asked).crossJoin(barred)  # one row each


def status_ladder(sources: DataFrame) -> DataFrame:
    """Sources by status, with the status' place on the way from found to parsed (0 for a way out)."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ["pending", "fetched", "extracted", "parsed"])), F.col("status")), F.lit(0))
    return sources.groupBy("status").agg(F.count(F.lit(1)).alias("sources")).withColumn("place", place.cast("int"))


def valid_transition(old, new):
    """Whether a source may go from one status to another: a step up, out at any point, or back to extracted when parsed."""
    steps = F.array(*map(F.lit, ["pending", "fetched", "extracted", "parsed"]))
    up = F.array_position(steps, new) - F.array_position(steps, old)
    return F.coalesce((up == 1) | new.isin("robots_denied", "error", "skipped") | ((old == "parsed") & (new == "extracted")), F.lit(False))


def crawl_counts(sources: DataFrame) -> DataFrame:
    """How many sources are fetched, of these from the cache (from_cache, where there is such a column), denied, in error and still queued."""
    s, got = F.col("status"), F.col("status").isin("fetched", "extracted", "parsed")
    cached = F.count_if(got & F.coalesce("from_cache", F.lit(False))) if "from_cache" in sources.columns else F.lit(0).cast("long")
    return sources.agg(F.count_if(got).alias("fetched"), cached.alias("cached"), F.count_if(s == "robots_denied").alias("denied"), F.count_if(s == "error").alias("errors"), F.count_if(s == "pending").alias("queued"))


def bank_counts(questions: DataFrame) -> DataFrame:
    """Questions by type and origin, with subtotals (null: all)."""
    return questions.rollup("type", "origin").agg(F.count(F.lit(1)).alias("questions"))


def tag_counts(tags: DataFrame, question_tags: DataFrame) -> DataFrame:
    """All tags of the vocabulary with their numbers of questions, zero included."""
    n = question_tags.groupBy("tag").agg(F.countDistinct("question_id").alias("questions"))
    return tags.join(n, "tag", "left").na.fill(0, ["questions"])


def bank_stats(sources: DataFrame, questions: DataFrame, question_tags: DataFrame, attempts: DataFrame, quarantine: DataFrame | None = None, top: int = 15) -> DataFrame:
    """(section, name, n) in one long table: sources by status and kind, totals, enriched, untagged, quarantined, attempts, top tags."""

    def line(df: DataFrame, section: str, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), "n")

    parts = [sources.groupBy(F.lit(s).alias("section"), F.col(s).alias("name")).agg(F.count(F.lit(1)).alias("n")) for s in ("status", "kind")]
    parts += [line(sources, "total", "sources"), line(questions, "total", "questions"), line(questions.where("enriched"), "total", "enriched"), line(attempts, "total", "attempts")]
    parts.append(line(questions.join(question_tags, "question_id", "left_anti"), "total", "untagged"))
    if quarantine is not None:
        parts.append(line(quarantine, "total", "quarantined"))
    tags = question_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("tag")).limit(top)
    parts.append(tags.select(F.lit("tag").alias("section"), F.col("tag").alias("name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
