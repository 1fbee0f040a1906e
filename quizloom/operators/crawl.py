"""Pages: text, links, the frontier of a crawl and its pacing. No fetching: what to fetch is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.text import recover_spaces
from quizloom.functions.web import is_boilerplate, is_document, join_url, normalize_doc_url, page_links, page_title, url_host, with_html_text
from quizloom.sources.scratch import staged

DEFAULT_DELAY, LEAST_DELAY = 10.0, 1.0
MAX_DEPTH, MAX_PAGES = 3, 600
DOCUMENT_HOSTS = ["docs.google.com", "drive.google.com"]


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of pages(page_id, url, html). One pass, built-in functions."""
    return with_html_text(pages.select("page_id", "url", "html", page_title(F.col("html")).alias("title")), "html").drop("html")


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, link): each page's links once, absolute, without fragment, http(s) only, document viewers rewritten."""
    raw = pages.select("page_id", "url", F.posexplode(page_links(F.col("html"))).alias("position", "href"))
    raw = raw.where(~F.col("href").rlike("^(?:$|#|mailto:|tel:|javascript:)"))
    joined = raw.select("page_id", "position", join_url(F.col("url"), F.col("href")).alias("_joined")).where(F.col("_joined").rlike("^https?:"))
    links = joined.select("page_id", "position", normalize_doc_url(F.col("_joined")).alias("link"))
    return links.groupBy("page_id", "link").agg(F.min("position").alias("position"))


def content_signal(robots: DataFrame) -> DataFrame:
    """robots(host, body): whether training is allowed, the note that says so, and the seconds between requests."""
    note = F.regexp_extract("body", r"(?im)^\s*(content-signal:.*)$", 1)
    delay = F.regexp_extract("body", r"(?im)^\s*crawl-delay:\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1)
    seconds = F.when(delay != "", F.greatest(F.lit(LEAST_DELAY), delay.try_cast("double"))).otherwise(DEFAULT_DELAY)
    barred = F.lower("body").rlike(r"ai-train\s*=\s*no")
    return robots.select("host", (~F.coalesce(barred, F.lit(False))).alias("ai_train_ok"), F.nullif(F.trim(note), F.lit("")).alias("license_note"), seconds.alias("delay_s"))


def crawl_frontier(links: DataFrame, sources: DataFrame, seeds: DataFrame, *, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES, document_hosts: list[str] = DOCUMENT_HOSTS) -> DataFrame:
    """(url, host, depth, is_document): what to fetch next, documents first, then by depth and URL.

    links(url, link) are the known pages' links, seeds(url) where the walk starts, sources(url, status, depth) what is known. The
    walk goes level by level, at most ``max_depth`` joins; a link counts if its host is a seed's or a document host's, it
    is no boilerplate, and it was not met before. Pending sources stay in. The limit is the crawl's page budget.
    """
    hosts = seeds.select(url_host(F.col("url")).alias("host")).distinct().union(seeds.sparkSession.createDataFrame([(h,) for h in document_hosts], "host string")).distinct()
    # Written out first: the filters below would else be pushed into the expressions that make the links, and repeat them for each test.
    links = staged(links.select("url", "link").distinct(), "links")
    good = links.select("url", "link", url_host(F.col("link")).alias("host")).where(~is_boilerplate(F.col("link"))).join(hosts, "host", "left_semi").select("url", "link").distinct()
    good = staged(good, "links")
    seen = staged(seeds.select("url", F.lit(0).alias("depth")), "level")
    level = seen
    for depth in range(1, max_depth + 1):
        found = level.select("url").join(good, "url").select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        level = staged(found.select("url", F.lit(depth).alias("depth")), "level")
        seen = seen.union(level)
    pending = sources.where("status = 'pending'").select("url", "depth")
    fetched = sources.where("status != 'pending'").select("url")
    todo = seen.union(pending).groupBy("url").agg(F.min("depth").alias("depth")).join(fetched, "url", "left_anti")
    todo = todo.select("url", url_host(F.col("url")).alias("host"), "depth", is_document(F.col("url"), document_hosts).alias("is_document"))
    return todo.orderBy(F.desc("is_document"), "depth", "url").limit(max_pages)


def fetch_schedule(frontier: DataFrame, policy: DataFrame) -> DataFrame:
    """The frontier with the earliest second at which each URL may be fetched: hosts side by side, each at its own pace.

    Rows that tie in all of these (a URL that is there twice) go by the frontier's further columns. policy(host, delay_s) is a table
    of hosts, joined as its size allows.
    """
    further = [F.col(f"`{c}`") for c in frontier.columns if c not in ("host", "is_document", "depth", "url")]
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("is_document"), "depth", "url", *further))
    rows = frontier.withColumn("_turn", turn).join(policy.select("host", "delay_s"), "host", "left")
    return rows.withColumn("earliest_s", (F.col("_turn") - 1) * F.coalesce("delay_s", F.lit(DEFAULT_DELAY))).drop("_turn", "delay_s")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url) with allowed and reason: the first rule (host, rule_order, pattern, allow) whose pattern begins the path decides; without any, allowed."""
    from quizloom.functions.web import url_path

    asked = urls.select("url", url_host(F.col("url")).alias("host"), F.coalesce(F.nullif(url_path(F.col("url")), F.lit("")), F.lit("/")).alias("_path")).distinct()
    hits = asked.join(rules, "host").where(F.col("_path").startswith(F.col("pattern"))).groupBy("url").agg(F.min_by(F.struct("allow", "pattern"), "rule_order").alias("_rule"))
    out = asked.join(hits, "url", "left").withColumn("allowed", F.coalesce("_rule.allow", F.lit(True)))
    return out.select("url", "host", "allowed", F.when(~F.col("allowed"), F.concat(F.lit("disallowed by robots rule "), F.col("_rule.pattern"))).alias("reason"), F.when(~F.col("allowed"), "robots_denied").alias("status"))


def strip_repeated_lines(doc_pages: DataFrame) -> DataFrame:
    """doc_pages(doc_id, page, text) without running headers and footers, and without page numbers.

    In documents of three pages or more, lines under 90 characters among the first or last two of a page count as furniture if
    they stand so on half of the pages (three at least).
    """
    lines = F.filter(F.transform(F.split("text", r"\n"), lambda t: F.trim(t)), lambda t: t != "")
    edge = F.filter(F.concat(F.slice(lines, 1, 2), F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), 2)), lambda t: F.length(t) < 90)
    counts = doc_pages.select("doc_id", F.explode(edge).alias("line")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    pages = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.join(pages, "doc_id").where("pages >= 3 and n >= greatest(3, pages div 2)").groupBy("doc_id").agg(F.collect_set("line").alias("_gone"), F.max("pages").alias("_pages"))
    rows = doc_pages.join(often, "doc_id", "left").join(pages, "doc_id")
    gone = F.coalesce("_gone", F.array().cast("array<string>"))
    kept = F.filter(F.split("text", r"\n"), lambda t: ~F.array_contains(gone, F.trim(t)) & ~t.rlike(r"(?i)^\s*(?:page\s+)?\d{1,3}\s*(?:of\s+\d{1,3})?\s*$"))
    return rows.select("doc_id", "page", F.when(F.col("pages") >= 3, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text): the retry's text where a page has lost its spaces and the retry has more."""
    return pages.select("doc_id", "page", recover_spaces(F.col("text"), F.coalesce("retry", F.lit(""))).alias("text"))


def extraction_gate(texts: DataFrame, min_chars: int = 200) -> DataFrame:
    """texts(source_id, text, error) with status extracted, skipped (too short) or error, and its detail."""
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < min_chars
    failed = F.col("error").isNotNull()
    return texts.withColumns({"status": F.when(failed, "error").when(short, "skipped").otherwise("extracted"), "status_detail": F.when(failed, F.col("error")).when(short, "extracted text too short")})
