"""Registered queries over pages, documents and questions; with their SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.functions import tags as tag_functions
from quizloom.functions import text as text_functions
from quizloom.functions import web
from quizloom.functions.grading import similarity
from quizloom.operators import crawl, dedup, grading, parse, planning, tagging
from quizloom.operators.index import TextIndex
from quizloom.plans.mapping import question_sources, question_tags, questions, sources, table, with_
from quizloom.sources.scratch import scratch_folder

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


# Pages ------------------------------------------------------------------------------------------------------------------

_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(f"""SELECT page_id, CASE WHEN t <> '' THEN left(t, 300) END AS title FROM (SELECT page_id, trim({_UNESCAPE.format("regexp_extract(html, '(?is)<title(?:[[:space:]][^>]*)?>(.*?)</title[[:space:]]*>', 1)")}) AS t FROM pages)""")
def page_title(spark, d):
    return crawl.extract_pages(table(spark, d, "pages")).select("page_id", "title")


def _html_sql() -> str:
    body = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for name in [*web.DROPPED_ELEMENTS, "head"]:
        body = f"regexp_replace({body}, '(?is)<{name}(?:\\s[^>]*)?>.*?</{name}\\s*>', '', 'g')"
    body = _UNESCAPE.format(f"regexp_replace({body}, '(?s)<[^>]*>', chr(10), 'g')")
    lines = f"list_transform(regexp_split_to_array({body}, '[\\n\\r]'), lambda t: regexp_replace(t, '^[\\s ]+|[\\s ]+$', '', 'g'))"
    return f"SELECT page_id, array_to_string(list_filter({lines}, lambda t: t <> ''), chr(10)) AS text FROM pages"


@query(_html_sql())
def html_text(spark, d):
    return crawl.extract_pages(table(spark, d, "pages")).select("page_id", "text")


_LINKS = """WITH tags AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS base, unnest(regexp_extract_all(html, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1)) AS h FROM pages),
hrefs AS (SELECT page_id, base, trim(regexp_replace(h, '^["'']|["'']$', '', 'g')) AS href FROM tags),
links AS (SELECT DISTINCT page_id, CASE WHEN href LIKE 'http%' THEN regexp_replace(href, '#.*$', '') WHEN href LIKE '/%' THEN regexp_extract(base, '^([a-z]+://[^/?]*)', 1) || regexp_replace(href, '#.*$', '') ELSE '?' END AS link FROM hrefs
WHERE NOT regexp_matches(href, '^(?:$|#|mailto:|tel:|javascript:)'))"""


@query(_LINKS + " SELECT page_id, link FROM links")
def extract_links(spark, d):
    return crawl.extract_links(table(spark, d, "pages")).select("page_id", "link")


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '(rule|scoresheet|score sheet|format)') THEN 'rules' WHEN regexp_matches(lower(url), '(study|guide|resource|syllabus|topic)') THEN 'studyguide'
    WHEN regexp_matches(lower(url), '(packet|round|question|tossup|bowl|bee|exam|set)') THEN 'packet' ELSE 'exam' END AS kind FROM pages""")
def classify_source(spark, d):
    return table(spark, d, "pages").select("page_id", web.classify_source(F.col("url"), F.lit(None).cast("string"), F.lit("pdf")).alias("kind"))


@query("SELECT page_id, 'html' AS kind FROM pages")
def detect_kind(spark, d):
    return table(spark, d, "pages").select("page_id", web.detect_kind(F.col("url"), F.lit(None).cast("string"), F.col("html").cast("binary")).alias("kind"))


_BOILER = "regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(/about|/contact|/apply|/registration|/privacy|/testimonial|/team|/hosting|/partners|/social-media|/cart|/checkout|/my-account|/donate|/shop|/product|/tag/|/author/|/wp-login|/feed|/category/)')"


@query(f"SELECT page_id, {_BOILER} AS boilerplate, regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.(pdf|docx|doc|txt|rtf)$') AS document FROM pages")
def url_flags(spark, d):
    return table(spark, d, "pages").select("page_id", web.is_boilerplate(F.col("url")).alias("boilerplate"), web.is_document(F.col("url")).alias("document"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://docs.google.com/document/d/D' || doc_id || '/export?format=txt' WHEN 1 THEN 'https://drive.google.com/uc?export=download&id=F-' || doc_id ELSE 'https://' || source || '.example.org/document/d/' || doc_id END AS url FROM documents")
def normalize_doc_url(spark, d):
    n = F.col("doc_id").cast("string")
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://docs.google.com/document/d/D"), n, F.lit("/edit#heading"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://drive.google.com/open?usp=x&id=F-"), n)).otherwise(F.concat(F.lit("https://"), "source", F.lit(".example.org/document/d/"), n))
    return table(spark, d, "documents").select("doc_id", web.normalize_doc_url(url).alias("url"))


@query(
    with_("sources")
    + "SELECT source_id, CASE WHEN title IS NOT NULL THEN title ELSE source_id || '.pdf' END AS name FROM sources"
)
def display_name(spark, d):
    return sources(spark, d).select("source_id", web.display_name(F.col("source_id"), F.col("title"), F.col("url")).alias("name"))


def _seeds(spark, d):
    return table(spark, d, "pages").where("page_id % 10 = 0").select("url")


_HOST = "regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"


@query(
    _LINKS.replace("WITH tags", "WITH RECURSIVE tags")
    + f""", seeds AS (SELECT DISTINCT url FROM pages WHERE page_id % 10 = 0), good AS (SELECT DISTINCT p.url, l.link FROM links l JOIN pages p USING (page_id) WHERE NOT {_BOILER.replace("(url,", "(l.link,")}
    AND ({_HOST.format("l.link")} IN (SELECT {_HOST.format("url")} FROM seeds) OR {_HOST.format("l.link")} IN ('docs.google.com', 'drive.google.com'))),
    walk AS (SELECT url, 0 AS depth FROM seeds UNION SELECT g.link, w.depth + 1 FROM walk w JOIN good g ON g.url = w.url WHERE w.depth < 3),
    todo AS (SELECT url, CAST(min(depth) AS INT) AS depth FROM (SELECT * FROM walk UNION ALL SELECT url, 1 FROM pages WHERE page_id % 2 = 1) GROUP BY 1)
    SELECT url, {_HOST.format("url")} AS host, depth, regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.(pdf|docx|doc|txt|rtf)$') AS is_document FROM todo
    WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0) ORDER BY is_document DESC, depth, url LIMIT 600"""
)
def crawl_frontier(spark, d):
    """The walk from each tenth page; pages are the known sources, those with even ids fetched."""
    pages = table(spark, d, "pages")
    links = crawl.extract_links(pages).join(pages.select("page_id", "url"), "page_id").select("url", "link")
    known = pages.select("url", F.when(F.col("page_id") % 2 == 0, "fetched").otherwise("pending").alias("status"), F.lit(1).alias("depth"))
    return crawl.crawl_frontier(links, known, _seeds(spark, d))


_HOST = _HOST.format("url")


@query(f"""SELECT page_id, url, host, CAST(depth AS INT) AS depth, is_document, (row_number() OVER (PARTITION BY host ORDER BY is_document DESC, depth, url, page_id) - 1) * CASE WHEN length(host) % 2 = 0 THEN 2.5::DOUBLE ELSE 10::DOUBLE END AS earliest_s
    FROM (SELECT page_id, url, {_HOST} AS host, page_id % 3 AS depth, page_id % 7 = 0 AS is_document FROM pages)""")
def fetch_schedule(spark, d):
    frontier = table(spark, d, "pages").select("page_id", "url", web.url_host(F.col("url")).alias("host"), (F.col("page_id") % 3).cast("int").alias("depth"), (F.col("page_id") % 7 == 0).alias("is_document"))
    policy = frontier.select("host", F.when(F.length("host") % 2 == 0, 2.5).alias("delay_s")).distinct().where("delay_s is not null")
    return crawl.fetch_schedule(frontier, policy)


_ROBOTS = "SELECT source AS host, CASE WHEN min(doc_id) % 2 = 0 THEN 'Content-Signal: ai-train=no' ELSE 'Content-Signal: ai-train=yes' END AS note, CASE WHEN min(doc_id) % 3 = 0 THEN 0.5::DOUBLE ELSE (min(doc_id) % 7)::DOUBLE END AS delay FROM documents GROUP BY 1"


@query(f"SELECT host, note NOT LIKE '%=no' AS ai_train_ok, note AS license_note, greatest(1.0, delay)::DOUBLE AS delay_s FROM ({_ROBOTS})")
def content_signal(spark, d):
    first = table(spark, d, "documents").groupBy(F.col("source").alias("host")).agg(F.min("doc_id").alias("n"))
    note = F.when(F.col("n") % 2 == 0, "Content-Signal: ai-train=no").otherwise("Content-Signal: ai-train=yes")
    delay = F.when(F.col("n") % 3 == 0, F.lit("0.5")).otherwise((F.col("n") % 7).cast("string"))
    return crawl.content_signal(first.select("host", F.concat(F.lit("User-agent: *\n"), note, F.lit("\nCrawl-delay: "), delay, F.lit("\nDisallow: /x\n")).alias("body")))


@query(f"""WITH u AS (SELECT DISTINCT url, {_HOST} AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
    SELECT url, host, CASE WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en/%' THEN false ELSE true END AS allowed, CASE WHEN path LIKE '/en/%' AND path NOT LIKE '/en/1%' THEN 'disallowed by robots rule /en/' END AS reason,
    CASE WHEN path LIKE '/en/%' AND path NOT LIKE '/en/1%' THEN 'robots_denied' END AS status FROM u""")
def robots_allowed(spark, d):
    pages = table(spark, d, "pages")
    rule = F.array(F.struct(F.lit(1).alias("rule_order"), F.lit("/en/1").alias("pattern"), F.lit(True).alias("allow")), F.struct(F.lit(2).alias("rule_order"), F.lit("/en/").alias("pattern"), F.lit(False).alias("allow")))
    rules = pages.select(web.url_host(F.col("url")).alias("host")).distinct().select("host", F.inline(rule))
    return crawl.robots_allowed(pages, rules)


# Texts ------------------------------------------------------------------------------------------------------------------

_PAGED = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
paged AS (SELECT doc_id, n // 5 AS page, 'Running head ' || (doc_id % 10) || chr(10) || string_agg(line, chr(10) ORDER BY n) AS text FROM lines GROUP BY doc_id, n // 5),
sizes AS (SELECT doc_id, count(*) AS pages FROM paged GROUP BY 1), trimmed AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '') AS l FROM paged),
edge AS (SELECT doc_id, unnest(list_concat(l[1:2], l[-2:])) AS line FROM trimmed), gone AS (SELECT doc_id, line FROM edge JOIN sizes USING (doc_id) WHERE length(line) < 90 AND pages >= 3 GROUP BY doc_id, line, pages HAVING count(*) >= greatest(3, pages // 2)),
kept AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM paged)
SELECT p.doc_id, p.page, CASE WHEN s.pages < 3 THEN p.text ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY n) FROM kept k WHERE k.doc_id = p.doc_id AND k.page = p.page
  AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = k.doc_id AND g.line = trim(k.line)) AND NOT regexp_matches(k.line, '(?i)^\\s*(?:page\\s+)?\\d{1,3}\\s*(?:of\\s+\\d{1,3})?\\s*$')), '') END AS text FROM paged p JOIN sizes s USING (doc_id)"""


@query("WITH " + _PAGED)
def repeated_lines(spark, d):
    lines = F.split("text", "\n")
    pages = documents(spark, d).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 5).cast("int")), lambda p: F.array_join(F.slice(lines, p * 5 + 1, 5), "\n"))).alias("page", "text"))
    pages = pages.select("doc_id", F.col("page").cast("long").alias("page"), F.concat(F.lit("Running head "), (F.col("doc_id") % 10).cast("string"), F.lit("\n"), "text").alias("text"))
    return crawl.strip_repeated_lines(pages)


@query("""SELECT doc_id, round(CASE WHEN length(t) > 0 THEN (length(t) - length(replace(t, ' ', ''))) / length(t) ELSE 0 END, 6) AS ratio, length(t) > 80 AND (length(t) - length(replace(t, ' ', ''))) / length(t) < 0.08 AS lost,
    md5(CASE WHEN length(t) > 80 AND (length(t) - length(replace(t, ' ', ''))) / length(t) < 0.08 AND contains(text, ' ') THEN text ELSE t END) AS text_md5 FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN replace(text, ' ', '') ELSE text END AS t FROM documents)""")
def space_ratio(spark, d):
    rows = documents(spark, d).withColumn("t", F.when(F.col("doc_id") % 10 == 0, F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text")))
    t = F.col("t")
    return rows.select("doc_id", F.round(text_functions.space_ratio(t), 6).alias("ratio"), text_functions.lost_spaces(t).alias("lost"), F.md5(text_functions.recover_spaces(t, F.col("text"))).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) < 200 THEN 'skipped' ELSE 'extracted' END AS status, CASE WHEN length(trim(text)) < 200 THEN 'extracted text too short' END AS status_detail FROM documents")
def extraction_gate(spark, d):
    texts = documents(spark, d).select(F.col("doc_id").alias("source_id"), "text", F.lit(None).cast("string").alias("error"))
    return crawl.extraction_gate(texts).select(F.col("source_id").alias("doc_id"), "status", "status_detail")


_W = "[\\p{L}\\p{N}_]"


def _clean_sql() -> str:
    t = "text || ' [read slowly] x(*)y (+) [E] it’s Six-' || chr(10) || 'Day S p a c e d out' || chr(10) || chr(10) || chr(10) || chr(10) || 'end'"
    for bad, good in text_functions.MOJIBAKE:
        t = f"replace({t}, '{bad}', '{good.replace(chr(39), chr(39) * 2)}')"
    t = f"replace({t}, '…', '...')"
    given = "".join(text_functions.QUOTES_AND_DASHES).replace("'", "''")
    t = f"translate({t}, '{given}{text_functions.INVISIBLE}', '{''.join(text_functions.QUOTES_AND_DASHES.values()).replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '(?i)\\[(?:read|note|moderator|emphasize)[^\\]]*\\]', ' ', 'g')"
    t = f"regexp_replace({t}, '\\((?:\\*|\\+)\\)|\\[(?:E|M|H)\\]', ' ', 'g')"
    runs = f"regexp_extract_all({t}, '(?:^|\\s)(?:{_W}\\s){{4,}}{_W}(?:\\s|$)')"
    bare = "regexp_replace(m, '^\\s|\\s$', '', 'g')"
    t = f"list_reduce(list_prepend({t}, {runs}), lambda a, m: replace(a, {bare}, replace({bare}, ' ', '')))"
    t = f"regexp_replace({t}, '({_W})-[ \\t]*\\n[ \\t]*({_W})', '\\1-\\2', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT doc_id, regexp_replace({t}, '^\\s+|\\s+$', '', 'g') AS text FROM documents"


@query(_clean_sql())
def clean_text_ascii(spark, d):
    added = F.lit(" [read slowly] x(*)y (+) [E] it’s Six-\nDay S p a c e d out\n\n\n\nend")
    return documents(spark, d).select("doc_id", text_functions.clean_text(F.concat("text", added), compose=False).alias("text"))


@query()
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", text_functions.clean_text(F.col("text")).alias("text"))


_SPLIT = """list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])["'')\\]]?\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda t: trim(t)), lambda t: t <> '')"""
_UNFINISHED = "(?i)(?:(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(a.replace(".", "\\.") for a in text_functions.ABBREVIATIONS) + ")|(?:^|[^\\p{L}\\p{N}_])[A-Z])\\.$"


@query(
    f"""WITH p AS (SELECT doc_id, unnest({_SPLIT}) AS s, unnest(range(len({_SPLIT}))) AS n FROM documents), g AS (SELECT *, n = 0 OR NOT regexp_matches(lag(s) OVER w, '{_UNFINISHED}') AS fresh FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    k AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sentence FROM g) SELECT doc_id, CAST(sentence - 1 AS INT) AS n, string_agg(s, ' ' ORDER BY k.n) AS sentence FROM k GROUP BY doc_id, k.sentence"""
)
def split_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(text_functions.split_sentences(F.col("text"))).alias("n", "sentence"))


def norm_sql(t: str) -> str:
    t = f"lower(translate({t}, '{text_functions.ACCENTED}', '{text_functions.BARE}'))"
    t = f"trim(regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"regexp_replace({t}, '^(?:(?:the|an|a)(?:\\s+|$))+', '')"


@query(f"SELECT doc_id, {norm_sql('text')} AS normal FROM documents")
def normalize_answer(spark, d):
    return documents(spark, d).select("doc_id", text_functions.normalize_answer(F.col("text")).alias("normal"))


_PRINT = f"SELECT doc_id, lang, source, sha256({norm_sql('lang')} || '|' || left({norm_sql('text')}, 200)) AS fingerprint FROM documents"


def printed(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("position"), F.col("lang").alias("answer"), F.col("text").alias("body"))
    return dedup.with_fingerprint(rows)


@query(f"SELECT doc_id AS question_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY source, doc_id) AS n FROM ({_PRINT})) WHERE n = 1")
def fingerprint_dedup(spark, d):
    return dedup.dedup_exact(printed(spark, d)).select("question_id", "fingerprint")


@query(
    f"""WITH f AS ({_PRINT}) SELECT doc_id AS question_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY source, doc_id) AS n FROM f WHERE doc_id % 2 = 1 AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE doc_id % 2 = 0)) WHERE n = 1"""
)
def fingerprint_dedup_incremental(spark, d):
    rows = printed(spark, d)
    return dedup.dedup_exact_incremental(rows.where("question_id % 2 = 1"), rows.where("question_id % 2 = 0")).select("question_id", "fingerprint")


def _tag_sql(hay: str, rows: str = "documents") -> str:
    hits = ", ".join(f"{{'less': -({' + '.join(f'(contains(h, {chr(39)}{t}{chr(39)}))::INT' for t in terms)}), 'tag': '{tag}'}}" for tag, terms in tag_functions.RULES.items())
    eras = "CASE " + " ".join(f"WHEN regexp_matches(h, '\\b{y}\\b') THEN '{e}'" for y, e in tag_functions.ERA_YEARS) + " END"
    names = "[" + ", ".join(f"'{e}'" for e in tag_functions.ERAS) + "]"
    return f"""WITH t AS (SELECT doc_id, lower({hay}) AS h FROM {rows}), s AS (SELECT doc_id, h, list_sort(list_filter([{hits}], lambda x: x.less < 0)) AS l FROM t),
    f AS (SELECT doc_id, list_transform(l[1:5], lambda x: x.tag) AS found, {eras} AS era FROM s), e AS (SELECT doc_id, CASE WHEN NOT list_has_any(found, {names}) AND era IS NOT NULL THEN list_append(found, era) ELSE found END AS found FROM f)
    SELECT doc_id, array_to_string((CASE WHEN len(found) = 0 THEN ['World History'] ELSE found END)[1:5], '|') AS tags FROM e"""


# Fixed words that the rules know, so that the texts, which are invented, meet them.
_TERMS = ["egypt", "rome", "battle of", "queen", "treaty", "novel", "river", "church", "empire", "revolution", "vaccine", "olympic", "samurai", "aztec", "viking", "trade", "goddess", "election", "suffrage", "engine"]
_TAG_TEXT = "text || ' ' || " + "['AFRICA', 'AMERICA', 'EUROPE', 'ASIA', 'MIDDLE EAST'][doc_id % 5 + 1] || ' ' || " + "[" + ", ".join(f"'{t}'" for t in _TERMS) + "][doc_id % 20 + 1] || ' ' || (1000 + doc_id % 1050) || ' ' || lang"


def tag_text():
    n = F.col("doc_id")
    regions = F.array(*map(F.lit, ["AFRICA", "AMERICA", "EUROPE", "ASIA", "MIDDLE EAST"]))
    return F.concat_ws(" ", "text", F.get(regions, (n % 5).cast("int")), F.get(F.array(*map(F.lit, _TERMS)), (n % 20).cast("int")), (1000 + n % 1050).cast("string"))


@query(_tag_sql(_TAG_TEXT))
def suggest_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tag_functions.suggest_tags(tag_text(), F.col("lang")), "|").alias("tags"))


@query("SELECT doc_id AS question_id, unnest(string_split(tags, '|')) AS tag FROM (" + _tag_sql(_TAG_TEXT) + ") WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0")
def tag_untagged(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), tag_text().alias("body"), F.col("lang").alias("answer"), (F.col("doc_id") % 4 == 0).alias("enriched"))
    return tagging.tag_untagged(rows, rows.where("question_id % 3 = 0").select("question_id"))


@query(
    "SELECT doc_id AS source_id, unnest(string_split(tags, '|')) AS tag FROM ("
    + _tag_sql("concat_ws(' ', title, url, left(text, 4000)) || ' '", "(" + with_("sources") + "SELECT s.*, d.text, d.doc_id FROM sources s JOIN documents d ON d.doc_id = s.source_id WHERE kind IN ('studyguide', 'index', 'rules') AND doc_id % 8 <> 0)")
    + ")"
)
def tag_sources(spark, d):
    texts = documents(spark, d).withColumnRenamed("doc_id", "source_id")
    return tagging.tag_sources(sources(spark, d), texts, texts.select("source_id").where("source_id % 8 = 0"))


@query(
    """SELECT doc_id AS question_id, CASE WHEN doc_id % 3 = 0 THEN 'Wars' WHEN doc_id % 3 = 1 THEN 'economy' ELSE lang END AS tag FROM documents"""
)
def set_tags(spark, d):
    """Languages are the old tags; two of three documents get a known tag in other letters, or a new one."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("tag"))
    vocabulary = docs.select("tag").union(table(spark, d, "part").select(F.lower("p_type"))).distinct().withColumn("kind", F.lit("topic"))
    new = docs.where("question_id % 3 != 2").select("question_id", F.when(F.col("question_id") % 3 == 0, " Wars ").otherwise("ECONOMY").alias("tag"))
    return tagging.set_tags(docs, vocabulary, new)[0]


@query(
    "WITH g AS (" + _tag_sql(_TAG_TEXT) + """) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_concat([lang], list_filter(string_split(tags, '|'), lambda t: t <> lang))[1:3], '|') ELSE lang || '|' || source END AS tags FROM g JOIN documents USING (doc_id)"""
)
def top_up_tags(spark, d):
    rows = table(spark, d, "documents").withColumn("given", F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array(F.col("lang"), F.col("source"))))
    return rows.select("doc_id", F.array_join(tagging.top_up_tags(F.col("given"), tag_text(), F.col("lang")), "|").alias("tags"))


@query(
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'elementary' WHEN 1 THEN 'high' WHEN 2 THEN 'open' WHEN 3 THEN 'middle' WHEN 4 THEN 'elementary' WHEN 5 THEN 'middle' WHEN 6 THEN 'high' ELSE 'middle' END AS difficulty FROM documents"""
)
def difficulty_hint(spark, d):
    names = ["2020-EMS-Round", "a-HS-b", "Collegiate%20Open", "MS_set", "elementary", "plain", "high%20school", "es-no"]
    name = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 8).cast("int"))
    host = F.when(F.col("doc_id") % 8 == 5, "ms.example.org").otherwise("files.example.org")
    name = F.when(F.col("doc_id") % 8 == 7, F.lit("tess-novice")).otherwise(name)
    return table(spark, d, "documents").select("doc_id", text_functions.difficulty_hint(F.concat(F.lit("https://"), host, F.lit("/"), name, F.lit(".pdf")), F.lit(None).cast("string")).alias("difficulty"))


# Packets ----------------------------------------------------------------------------------------------------------------


def packets(spark, d):
    """One packet per document: its text as one paragraph, then an answer line of a part."""
    docs = documents(spark, d).withColumn("p_partkey", F.col("doc_id") % 100)
    part = table(spark, d, "part")
    body = text_functions.collapse_spaces(F.col("text"))
    return docs.join(part, "p_partkey").select(F.col("doc_id").alias("source_id"), F.concat(body, F.lit("\nANSWER: "), "p_name", F.lit(" (accept "), "p_brand", F.lit("; prompt on "), "p_type", F.lit(")")).alias("text"))


@query()
def parse_tossups(spark, d):
    out = parse.parse_tossups(packets(spark, d))
    return out.select("source_id", "position", "reason", "answer", F.array_join("alternates", "|").alias("alternates"), F.size("clues").alias("n_clues"))


@query()
def parse_mcqs(spark, d):
    """One exam per document: each of its lines that is not blank is the stem of a question; a blank text has one without a stem."""
    docs = documents(spark, d).withColumn("p_partkey", F.col("doc_id") % 100)
    part = table(spark, d, "part")
    lines = F.filter(F.transform(F.split("text", "\n"), text_functions.collapse_spaces), lambda t: t != "")
    lines = F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines)
    options = F.concat(F.lit("?\nA. "), "p_name", F.lit("\nB. "), "p_brand", F.lit("\nC. "), "p_type", F.lit("\nCorrect Answer: "), F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, F.col("p_brand")).otherwise("none of these"), F.lit("\n\n"))
    exam = F.array_join(F.transform(lines, lambda line, i: F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(": History\n"), line, options)), "")
    out = parse.parse_mcqs(docs.join(part, "p_partkey").select(F.col("doc_id").alias("source_id"), exam.alias("text")))
    return out.select("source_id", "position", "reason", "stem", "answer", F.size("options").alias("n_options"))


def _told_body(text="text"):
    """A document's words of two letters or more, as one sentence, and a second sentence about a part: (body, first clue)."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " "), lambda w: F.length(w) > 1)
    first = F.concat_ws(" ", F.array_join(words, " "), F.lit("indeed."))
    return F.concat_ws(" ", F.nullif(F.array_join(words, " "), F.lit("")), F.lit("indeed. It was sold as"), F.lower("p_type"), F.lit("under label"), F.substring("p_brand", 7, 9), F.lit("by traders in the old town and all along the river, as its makers tell us.")), first


def told(spark, d):
    """Documents with a part each: (source_id, lang, body, first, exam) for packets of one tossup and one multiple-choice question."""
    part = table(spark, d, "part")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text").crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("n")))).withColumn("p_partkey", F.col("doc_id") % F.col("n")).join(part, "p_partkey")
    body, first = _told_body()
    exam = F.concat(F.lit("1. Which good has the brand "), F.substring("p_brand", 7, 9), F.lit(" in the list?\nA. "), "p_name", F.lit("\nB. "), F.lower("p_type"), F.lit("\nC. none of them\nAnswer: B"))
    return docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("market of "), "lang").alias("answer"), body.alias("body"), F.ltrim(first).alias("first"), exam.alias("exam"), F.lower("p_type").alias("choice"), "p_name")


def _near_bm25_sql(asked: str, index: str, least: float, pairs: str) -> str:
    """(query_id, doc_id, score) of the words of ``asked`` (query_id, term) over ``index`` (doc_id, term, tf, length), for the pairs that fit."""
    return f"""SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score
      FROM {asked} JOIN {index} USING (term) JOIN (SELECT term, count(*) AS df FROM {index} GROUP BY 1) USING (term), (SELECT count(*) AS n, avg(length) AS al FROM (SELECT DISTINCT doc_id, length FROM {index})) {pairs} GROUP BY 1, 2 HAVING score > {least}"""


_TOLD_SQL = f"""w AS (SELECT doc_id, lang, array_to_string(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: length(x) > 1), ' ') AS t, doc_id % (SELECT count(*) FROM part) AS k FROM documents),
told AS (SELECT doc_id, 'market of ' || lang AS answer, ltrim(concat(t, ' indeed. It was sold as ', lower(p_type), ' under label ', p_brand[7:], ' by traders in the old town and all along the river, as its makers tell us.')) AS body, ltrim(concat(t, ' indeed.')) AS first,
  concat('Which good has the brand ', p_brand[7:], ' in the list?') AS stem, lower(p_type) AS choice FROM w JOIN part ON p_partkey = k),
bank AS (SELECT doc_id AS question_id, answer, body, first FROM told WHERE doc_id % 4 < 2),
ready AS (SELECT source_id, kind FROM sources WHERE status = 'extracted'),
parsed AS (SELECT doc_id AS source_id, 'tossup' AS type, answer, body, first, length(body) <= 4000 AS good FROM told WHERE doc_id IN (SELECT source_id FROM ready WHERE kind IN ('packet', 'exam'))
  UNION ALL SELECT doc_id, 'mcq', choice, stem, stem, true FROM told WHERE doc_id IN (SELECT source_id FROM ready WHERE kind IN ('packet', 'exam'))),
cand AS (SELECT *, row_number() OVER (ORDER BY source_id, type DESC) AS c, {norm_sql("answer")} AS a, concat({norm_sql("answer")}, '|', left({norm_sql("first")}, 200)) AS print, string_split({norm_sql("body")}, ' ') AS toks FROM parsed WHERE good),
prints AS (SELECT DISTINCT concat({norm_sql("answer")}, '|', left({norm_sql("first")}, 200)) AS print FROM bank),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY print ORDER BY c) AS nth FROM cand) WHERE nth = 1 AND print NOT IN (SELECT print FROM prints)),
asks AS (SELECT c AS query_id, unnest(terms) AS term FROM (SELECT c, list_distinct(list_filter(toks[1:12], lambda x: length(x) >= 4)) AS terms FROM fresh) WHERE len(terms) >= 4),
held AS (SELECT doc_id, term, count(*) AS tf, length FROM (SELECT question_id AS doc_id, unnest(l) AS term, len(l) AS length FROM (SELECT question_id, list_filter(string_split({norm_sql("concat(body, ' ', answer)")}, ' '), lambda x: x <> '') AS l FROM bank)) GROUP BY ALL),
hits AS ({_near_bm25_sql("asks", "held", 0, "")}),
near AS (SELECT DISTINCT query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) JOIN fresh ON c = query_id JOIN bank ON question_id = doc_id
  WHERE rank <= 5 AND score > 8 AND type = 'tossup' AND a = {norm_sql("bank.answer")}),
rest AS (SELECT * FROM fresh WHERE c NOT IN (SELECT query_id FROM near)),
own AS (SELECT doc_id, term, count(*) AS tf, length FROM (SELECT c AS doc_id, unnest(l) AS term, len(l) AS length FROM (SELECT c, list_filter(string_split({norm_sql("concat(body, ' ', answer)")}, ' '), lambda x: x <> '') AS l FROM rest)) GROUP BY ALL),
ask2 AS (SELECT * FROM asks WHERE query_id NOT IN (SELECT query_id FROM near)),
edges AS (SELECT query_id, list(doc_id) AS nears FROM ({_near_bm25_sql("ask2", "own", 8, "WHERE doc_id < query_id AND EXISTS (SELECT 1 FROM rest x, rest y WHERE x.c = query_id AND y.c = doc_id AND x.a = y.a AND x.type = y.type)")}) GROUP BY 1),
line AS (SELECT c, row_number() OVER (ORDER BY c) AS i, coalesce(nears, []) AS nears FROM rest LEFT JOIN edges ON query_id = c),
walk(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT line.i, CASE WHEN len(list_filter(nears, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, c) ELSE gone END FROM walk JOIN line ON line.i = walk.i + 1),
lost AS (SELECT unnest(gone) AS c FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1)),
kept AS (SELECT source_id, count(*) FILTER (WHERE type = 'tossup') AS tossups, count(*) FILTER (WHERE type = 'mcq') AS mcqs FROM rest WHERE c NOT IN (SELECT c FROM lost) GROUP BY 1),
counts AS (SELECT source_id, coalesce(any_value(tossups), 0) AS tossups, coalesce(any_value(mcqs), 0) AS mcqs, count(*) FILTER (WHERE good) - coalesce(any_value(tossups), 0) - coalesce(any_value(mcqs), 0) AS duplicates, 1 + count(*) FILTER (WHERE NOT good) AS quarantined
  FROM parsed LEFT JOIN kept USING (source_id) GROUP BY 1)"""


@query(
    f"""WITH {_TOLD_SQL.split("bank AS (")[0].rstrip().rstrip(",")}, rows AS (SELECT doc_id AS source_id, 0 AS position, CASE WHEN length(body) < {text_functions.MIN_BODY} THEN '{text_functions.TOO_SHORT}' WHEN length(body) > {text_functions.MAX_BODY} THEN '{text_functions.TOO_LONG}' WHEN regexp_matches(body, '^bonus([^a-z]|$)') THEN '{text_functions.BONUS}' END AS reason, answer, 'old ' || choice || '|river goods' AS alternates, 2 AS n_clues FROM told WHERE answer IS NOT NULL
    UNION ALL SELECT doc_id, 1, '{text_functions.TOO_SHORT}', NULL, NULL, NULL FROM told WHERE answer IS NOT NULL)
    SELECT source_id, position, reason, CASE WHEN reason IS NULL THEN answer END AS answer, CASE WHEN reason IS NULL THEN alternates END AS alternates, CASE WHEN reason IS NULL THEN n_clues ELSE -1 END AS n_clues FROM rows"""
)
def parse_tossups_plain(spark, d):
    """Packets of one tossup, whose answer line has alternates and wraps into the next line, and one multiple-choice question; without an answer there is no packet."""
    line = F.concat(F.lit("\nANSWER: "), "answer", F.lit(" (accept old "), "choice", F.lit(" or\nriver goods; prompt on goods)\n\n"))
    out = parse.parse_tossups(told(spark, d).select("source_id", F.concat("body", line, "exam").alias("text")))
    return out.select("source_id", "position", "reason", "answer", F.array_join("alternates", "|").alias("alternates"), F.coalesce(F.size("clues"), F.lit(-1)).alias("n_clues"))


@query(
    f"""WITH {_TOLD_SQL.split("bank AS (")[0].rstrip().rstrip(",")}, p AS (SELECT doc_id AS source_id, stem, choice, p_name, doc_id % 4 AS kind FROM told JOIN w USING (doc_id) JOIN part ON p_partkey = k)
    SELECT source_id, 1 AS position, CASE kind WHEN 2 THEN 'MCQ answer does not match any option' WHEN 3 THEN 'MCQ stem missing or too short' END AS reason, CASE WHEN kind = 3 THEN 'Which good?' ELSE stem END AS stem,
    CASE kind WHEN 0 THEN choice WHEN 1 THEN p_name END AS answer, CASE WHEN kind < 2 THEN 3 ELSE -1 END AS n_options FROM p"""
)
def parse_mcqs_plain(spark, d):
    """The same packets; answers by label, by the text of an option in other letters, of no option, and a stem too short."""
    kind = F.col("source_id") % 4
    exam = F.when(kind == 3, F.regexp_replace("exam", r"(?m)^1\. .*$", "1. Which good?")).otherwise(F.col("exam"))
    exam = F.concat(F.regexp_replace(exam, "Answer: B$", "Answer: "), F.when(kind == 1, F.upper("p_name")).when(kind == 2, "something else").otherwise("(B)"))
    out = parse.parse_mcqs(told(spark, d).select("source_id", F.concat("body", F.lit("\nANSWER: "), "answer", F.lit("\n\n"), exam).alias("text")))
    return out.select("source_id", "position", "reason", "stem", "answer", F.coalesce(F.size("options"), F.lit(-1)).alias("n_options"))


@query(
    with_("sources").replace("WITH", "WITH RECURSIVE") + ", " + _TOLD_SQL
    + """ SELECT s.source_id, CASE WHEN s.status = 'extracted' THEN 'parsed' ELSE s.status END AS status, CASE WHEN s.status <> 'extracted' THEN NULL WHEN kind IN ('packet', 'exam') THEN concat(tossups, ' tossups, ', mcqs, ' mcqs, ', duplicates, ' dupes, ', quarantined, ' quarantined')
    ELSE concat('kind=', kind, ', kept as reference') END AS status_detail, coalesce(tossups, 0) AS tossups, coalesce(mcqs, 0) AS mcqs, coalesce(duplicates, 0) AS duplicates, coalesce(quarantined, 0) AS quarantined FROM sources s LEFT JOIN counts USING (source_id)"""
)
def parse_pipeline(spark, d):
    """Packets of all sources that are packets or exams, against a standing bank: the questions of the other sources, held in a word index."""
    rows = told(spark, d)
    texts = rows.select("source_id", F.concat("body", F.lit("\nANSWER: "), "answer", F.lit("\n\n"), "exam").alias("text"))
    bank = rows.where("source_id % 4 < 2").select(F.col("source_id").alias("question_id"), F.lit("tossup").alias("type"), "answer", "body", text_functions.fingerprint(F.col("answer"), F.col("first")).alias("fingerprint"))
    index = TextIndex(spark, scratch_folder(spark, "bank-index"))
    index.append(dedup.question_postings(bank), "bank")
    return parse.parse_pipeline(sources(spark, d), texts, bank, index)["sources"].select("source_id", "status", "status_detail", "tossups", "mcqs", "duplicates", "quarantined")


@query(
    with_("sources", "questions")
    + "SELECT count(*) AS examined, count(*) FILTER (WHERE difficulty <> CASE WHEN lang = 'es' THEN 'elementary' ELSE 'middle' END) AS changed FROM questions q JOIN sources s USING (source_id) JOIN documents ON doc_id = source_id WHERE origin = 'official'"
)
def redifficulty(spark, d):
    return parse.redifficulty_report(parse.redifficulty(questions(spark, d), sources(spark, d)))


@query("SELECT doc_id AS source_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'extracted' ELSE 'parsed' END WHEN 1 THEN 'extracted' ELSE 'error' END AS status FROM documents")
def reset_parsed(spark, d):
    n = F.col("source_id")
    rows = documents(spark, d).select(F.col("doc_id").alias("source_id")).withColumn("status", F.when(n % 3 == 0, "parsed").when(n % 3 == 1, "extracted").otherwise("error"))
    return parse.reset_parsed(rows, rows.where("source_id % 2 = 0")).select("source_id", "status")


# Near duplicates and the index ------------------------------------------------------------------------------------------

_TOK = f"list_filter(string_split({norm_sql('text')}, ' '), lambda t: t <> '')"
def _index_sql(text: str = "text") -> str:
    own = f"list_filter(string_split({norm_sql(text)}, ' '), lambda t: t <> '')"
    return f"""idx AS (SELECT item_id AS doc_id, term, count(*) AS tf, length FROM (SELECT item_id, unnest({own}) AS term, len({own}) AS length FROM benchmark) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(length) AS al FROM (SELECT DISTINCT doc_id, length FROM idx)), dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM idx GROUP BY 1),
q AS (SELECT doc_id AS query_id, list_distinct(list_filter(({_TOK})[1:12], lambda t: length(t) >= 4)) AS terms FROM documents), asked AS (SELECT query_id, unnest(terms) AS term FROM q WHERE len(terms) >= 4),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score FROM asked JOIN idx USING (term) JOIN dfs USING (term), stats GROUP BY 1, 2)"""


_INDEX = _index_sql()


def bank_index(spark, d):
    return dedup.build_text_index(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("body")))


def bm25_queries(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("query_id"), dedup.query_terms(F.col("text")).alias("terms")).where(F.size("terms") >= dedup.LEAST_TERMS)


@query(f"WITH {_INDEX} SELECT doc_id, term, tf, CAST(length AS INT) AS length FROM idx")
def build_text_index(spark, d):
    return bank_index(spark, d)


@query(f"WITH {_INDEX} SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored) WHERE rank <= 5")
def bm25_top5(spark, d):
    return dedup.search_bm25(bm25_queries(spark, d), bank_index(spark, d), 5)


@query("SELECT (SELECT count(*) FROM benchmark) AS documents, (SELECT count(*) FROM benchmark) AS indexed")
def index_parity(spark, d):
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("body"))
    return dedup.index_parity(bench, dedup.build_text_index(bench))


@query(
    f"""WITH {_INDEX}, top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT query_id AS question_id, arg_min(doc_id, rank) AS duplicate_of FROM top WHERE rank <= 5 AND score > 4 AND query_id % 2 = doc_id % 2 GROUP BY 1"""
)
def near_duplicates(spark, d):
    new = documents(spark, d).select(F.col("doc_id").alias("question_id"), F.lit("tossup").alias("type"), F.when(F.col("doc_id") % 2 == 0, "The Even").otherwise("odd").alias("answer"), F.col("text").alias("body"))
    bank = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("tossup").alias("type"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("Odd").alias("answer"), F.col("text").alias("body"))
    # The answers' own words are left out of the index here, so that scores are those of the texts.
    return _near_by_text(new, bank)


def _near_by_text(new, bank):
    blank = bank.withColumn("_answer", F.col("answer"))
    index = dedup.build_text_index(blank.select(F.col("question_id").alias("doc_id"), "body"))
    hits = dedup.search_bm25(new.select(F.col("question_id").alias("query_id"), dedup.query_terms(F.col("body")).alias("terms")).where(F.size("terms") >= dedup.LEAST_TERMS), index, 5).where("score > 4")
    own = new.select(F.col("question_id").alias("query_id"), text_functions.normalize_answer(F.col("answer")).alias("_a"))
    theirs = bank.select(F.col("question_id").alias("doc_id"), text_functions.normalize_answer(F.col("answer")).alias("_b"))
    same = hits.join(own, "query_id").join(theirs, "doc_id").where("_a = _b")
    return same.groupBy(F.col("query_id").alias("question_id")).agg(F.min_by("doc_id", "rank").alias("duplicate_of"))


@query(
    f"""WITH {_index_sql("text || ' The passage'")}, top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT query_id AS question_id, arg_min(doc_id, rank) AS duplicate_of FROM top WHERE rank <= 5 AND score > 4 GROUP BY 1"""
)
def find_near_duplicates(spark, d):
    new = documents(spark, d).select(F.col("doc_id").alias("question_id"), F.lit("tossup").alias("type"), F.lit("passage").alias("answer"), F.col("text").alias("body"))
    bank = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("tossup").alias("type"), F.lit("The passage").alias("answer"), F.col("text").alias("body"))
    return dedup.find_near_duplicates(new, bank, 4.0)


@query(
    f"""WITH RECURSIVE cand AS (SELECT doc_id AS c, {norm_sql("source")} AS a, list_filter(string_split({norm_sql("text")}, ' '), lambda x: x <> '') AS toks, list_filter(string_split({norm_sql("text || ' ' || source")}, ' '), lambda x: x <> '') AS l FROM documents),
    asks AS (SELECT c AS query_id, unnest(terms) AS term FROM (SELECT c, list_distinct(list_filter(toks[1:12], lambda x: length(x) >= 4)) AS terms FROM cand) WHERE len(terms) >= 4),
    own AS (SELECT doc_id, term, count(*) AS tf, length FROM (SELECT c AS doc_id, unnest(l) AS term, len(l) AS length FROM cand) GROUP BY ALL),
    edges AS (SELECT query_id, list(doc_id) AS nears FROM ({_near_bm25_sql("asks", "own", 8, "WHERE doc_id < query_id AND EXISTS (SELECT 1 FROM cand x, cand y WHERE x.c = query_id AND y.c = doc_id AND x.a = y.a)")}) GROUP BY 1),
    line AS (SELECT c, row_number() OVER (ORDER BY c) AS i, coalesce(nears, []) AS nears FROM cand LEFT JOIN edges ON query_id = c),
    walk(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT line.i, CASE WHEN len(list_filter(nears, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, c) ELSE gone END FROM walk JOIN line ON line.i = walk.i + 1),
    lost AS (SELECT gone FROM walk ORDER BY i DESC LIMIT 1)
    SELECT c AS question_id, CASE WHEN list_contains(gone, c) THEN list_min(list_filter(nears, lambda x: NOT list_contains(gone, x))) END AS duplicate_of FROM line, lost"""
)
def dedup_near(spark, d):
    batch = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.lit("tossup").alias("type"), F.col("source").alias("answer"), F.col("text").alias("body"), F.col("doc_id").alias("position"))
    return dedup.dedup_near(batch).select("question_id", "duplicate_of")


@query("SELECT DISTINCT doc_id % 100 AS question_id, doc_id AS source_id FROM documents")
def coverage(spark, d):
    pairs = question_sources(spark, d)
    return dedup.coverage(pairs.where("source_id % 3 = 0"), pairs.where("source_id % 3 > 0"), pairs.where("source_id % 2 = 0"))


@query(
    """SELECT source AS source_id, count(*) FILTER (WHERE o = 0) AS tossups, count(*) FILTER (WHERE o = 1) AS mcqs, count(*) FILTER (WHERE o = 2) AS duplicates, count(*) FILTER (WHERE o = 3) AS quarantined
    FROM (SELECT source, doc_id % 4 AS o FROM documents) GROUP BY ROLLUP (source)"""
)
def parse_counts(spark, d):
    outcome = F.get(F.array(*map(F.lit, ["tossup", "mcq", "duplicate", "quarantined"])), (F.col("doc_id") % 4).cast("int"))
    return dedup.parse_counts(table(spark, d, "documents").select(F.col("source").alias("source_id"), outcome.alias("outcome")))


# Grading ----------------------------------------------------------------------------------------------------------------


def name_pairs(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("answer"))
    return part.join(other, "p_partkey").select(F.col("p_partkey").alias("attempt_id"), F.col("p_name").alias("response"), "answer", F.array().cast("array<string>").alias("alternates"))


@query("SELECT a.p_partkey AS attempt_id, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def similarity_pairs(spark, d):
    return name_pairs(spark, d).select("attempt_id", F.round(similarity(F.col("response"), F.col("answer")), 6).alias("similarity"))


def _judge_sql() -> str:
    near = "(list_contains({l}, t) OR (length(t) >= 5 AND len(list_filter({l}, lambda x: length(x) >= 4 AND 1 - levenshtein(t, x) / greatest(length(t), length(x)) >= 0.82)) > 0))"
    hits = "len(list_filter(r, lambda t: " + near.format(l="s") + "))"
    # Part names are two words, none of them generic or a number: then all distinctive words, all words and a leading part are one case.
    return f"""WITH p AS (SELECT a.p_partkey AS attempt_id, a.p_name AS x, b.p_name AS y, string_split(a.p_name, ' ') AS s, string_split(b.p_name, ' ') AS r FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    m AS (SELECT *, x = y AS same, {hits} = len(r) AS every, {hits} > 0 AS shared, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS close FROM p)
    SELECT attempt_id, same OR every OR (NOT shared AND close < 0.55) AS decided, CASE WHEN same OR every THEN 'correct' WHEN NOT shared AND close < 0.55 THEN 'incorrect' END AS verdict,
    CASE WHEN same THEN 'exact' WHEN every OR (NOT shared AND close < 0.55) THEN 'fuzzy' END AS judged_by,
    CASE WHEN same THEN 'exact match' WHEN every THEN 'matched on ' || array_to_string(r, ' + ') WHEN shared THEN 'partial token overlap' WHEN close < 0.55 THEN 'no overlap' ELSE 'close spelling' END AS reason FROM m"""


@query(_judge_sql())
def judge_offline(spark, d):
    return grading.judge_offline(name_pairs(spark, d))


@query(
    f"""SELECT attempt_id, coalesce(verdict, CASE WHEN reason = 'partial token overlap' THEN 'correct' ELSE 'incorrect' END) AS verdict, coalesce(judged_by, 'fuzzy') AS judged_by, CASE WHEN decided THEN reason ELSE reason || ' (judged offline)' END AS reason FROM ({_judge_sql()})"""
)
def resolve_undecided(spark, d):
    return grading.resolve_undecided(grading.judge_offline(name_pairs(spark, d)))


# Planning ---------------------------------------------------------------------------------------------------------------


@query(
    with_("sources")
    + """, g AS (SELECT s.source_id, s.kind, s.title, s.url, d.lang AS tag, left(d.text, 2500) AS cut FROM sources s JOIN documents d ON d.doc_id = s.source_id WHERE ai_train_ok AND kind IN ('studyguide', 'index')),
    hits AS (SELECT DISTINCT v.tag, g.source_id, g.title, g.url, g.cut FROM (SELECT DISTINCT lang AS tag FROM documents) v JOIN g ON g.tag = v.tag OR contains(lower(g.title), v.tag)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tag ORDER BY source_id) AS INT) AS rank FROM hits), k AS (SELECT *, 6000 - coalesce(sum(length(cut)) OVER (PARTITION BY tag ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r WHERE rank <= 4 AND trim(cut) <> '')
    SELECT tag, rank, source_id, coalesce(title, url) AS name, trim(left(cut, CAST(room AS INT))) AS excerpt FROM k WHERE room > 0"""
)
def grounding_excerpts(spark, d):
    docs = table(spark, d, "documents")
    tags = docs.select(F.col("doc_id").alias("source_id"), F.col("lang").alias("tag"))
    return planning.grounding_excerpts(tags, sources(spark, d), docs.select(F.col("doc_id").alias("source_id"), "text"), tags)


@query(with_("questions", "question_tags") + "SELECT * FROM (SELECT tag, answer, CAST(row_number() OVER (PARTITION BY tag ORDER BY max(question_id) DESC, answer) AS INT) AS rank FROM questions JOIN question_tags USING (question_id) GROUP BY tag, answer) WHERE rank <= 120")
def existing_answers(spark, d):
    return planning.existing_answers(questions(spark, d), question_tags(spark, d))


@query(
    with_("question_tags")
    + "SELECT 'gen-' || regexp_replace(lower(tag), '\\s+', '-', 'g') || '-mcq-' || s AS custom_id, tag, 'mcq' AS fmt, CAST(least(5, 12 - 5 * s) AS INT) AS count FROM (SELECT DISTINCT tag FROM question_tags), (SELECT unnest(range(3)) AS s)"
)
def generation_plan(spark, d):
    return planning.generation_plan(question_tags(spark, d).select("tag").distinct(), "mcq", 12)


@query(
    with_("questions", "question_tags")
    + """, made AS (SELECT question_id FROM questions WHERE origin = 'generated' AND type = 'tossup'), have AS (SELECT v.tag, count(m.question_id) AS generated FROM (SELECT DISTINCT tag FROM question_tags) v LEFT JOIN question_tags t USING (tag) LEFT JOIN made m USING (question_id) GROUP BY 1)
    SELECT tag, generated, CAST(row_number() OVER (ORDER BY generated, tag) AS INT) AS place, CAST(greatest(2, least(60, ceil(floor((2 * (SELECT count(*) FROM made) - (SELECT count(*) FROM made)) * 1.45) / (SELECT count(*) FROM have)))) AS INT) AS per_tag FROM have
    WHERE (SELECT count(*) FROM made) < 2 * (SELECT count(*) FROM made)"""
)
def coverage_gap_plan(spark, d):
    """The target is twice what the bank has generated, so a round is due at any scale."""
    qt, q = question_tags(spark, d), questions(spark, d)
    return planning.coverage_gap_plan(qt.select("tag").distinct(), q, qt, target=2 * q.where("origin = 'generated' and type = 'tossup'").count())


def bullets(spark, d):
    """Lines of two part names each, as a study guide lists its subjects, by documents that name the part."""
    # One task may read the whole file; guides are written and searched by all of them.
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type").repartition("p_partkey").select("p_partkey", F.initcap("p_name").alias("a"), F.initcap(F.concat("p_type", F.lit(" of "), "p_name")).alias("b"))
    return part.select(F.col("p_partkey").alias("source_id"), F.concat(F.lit("Chapter one\n- "), "a", F.lit(" - "), "b", F.lit("\n- The End - THE BEE BOWL")).alias("text"))


_TOPICS = """WITH t AS (SELECT p_partkey AS source_id, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])) AS w, upper(p_type[1]) || lower(p_type[2:]) AS k FROM part),
    n AS (SELECT source_id, array_to_string(w, ' ') AS a, k || ' Of ' || array_to_string(w, ' ') AS b FROM t), u AS (SELECT a AS topic, source_id, 1 AS line, 1 AS pos FROM n UNION ALL SELECT b, source_id, 1, 2 FROM n),
    f AS (SELECT topic, min((source_id, line, pos)) AS m FROM u GROUP BY 1), topics AS (SELECT topic, m[1] AS source_id, m[3] AS pos FROM f ORDER BY source_id, pos LIMIT 4000)"""


@query(_TOPICS + " SELECT topic, source_id FROM topics")
def study_topics(spark, d):
    return planning.study_topics(bullets(spark, d)).select("topic", "source_id")


@query(_TOPICS + " SELECT topic, source_id FROM topics WHERE lower(topic) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 3 <> 0)")
def unused_topics(spark, d):
    return planning.unused_topics(planning.study_topics(bullets(spark, d)), questions(spark, d)).select("topic", "source_id")


@query(
    _TOPICS
    + """, h AS (SELECT topic, row_number() OVER (ORDER BY source_id, pos) - 1 AS n FROM topics ORDER BY n LIMIT 69)
    SELECT CAST(n // 5 AS INT) AS slice, count(*) AS count, string_agg((n % 5 + 1) || '. ' || topic, chr(10) ORDER BY n) AS listing FROM h GROUP BY 1"""
)
def topic_requests(spark, d):
    return planning.topic_requests(planning.study_topics(bullets(spark, d)), 40)


@query(with_("questions") + "SELECT count(*) FILTER (WHERE NOT enriched) AS pending FROM questions")
def pending_count(spark, d):
    return planning.pending_count(questions(spark, d))


def _pieces(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "question_id")
    clues = part.select("question_id", F.posexplode(F.array("p_type", "p_brand")).alias("ordinal", "text")).withColumn("tier", F.when(F.col("ordinal") == 0, "leadin").otherwise("giveaway"))
    options = part.select("question_id", F.inline(F.array(F.struct(F.lit("A").alias("label"), F.col("p_name").alias("text")), F.struct(F.lit("B").alias("label"), F.col("p_type").alias("text")))))
    return clues, options


@query(
    with_("questions")
    + """SELECT question_id, 'q' || question_id AS custom_id, CASE WHEN type = 'tossup' THEN 'Question type: pyramidal tossup' || chr(10) || chr(10) || '[leadin] ' || p_type || chr(10) || '[giveaway] ' || p_brand || chr(10) || chr(10) || 'ANSWER: ' || answer
    ELSE 'Question type: multiple choice' || chr(10) || chr(10) || stem || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_type || chr(10) || chr(10) || 'Correct answer: ' || answer END AS payload,
    CAST((row_number() OVER (ORDER BY question_id) - 1) // 20 AS BIGINT) AS batch_no FROM questions JOIN part ON p_partkey = question_id WHERE NOT enriched"""
)
def enrichment_requests(spark, d):
    clues, options = _pieces(spark, d)
    return planning.enrichment_requests(questions(spark, d), clues, options, batch=20)


def responses(spark, d):
    part = table(spark, d, "part")
    good = F.to_json(F.struct(F.array("p_type", "p_brand").alias("categories"), F.when(F.col("p_partkey") % 2 == 0, "hard").otherwise("high").alias("difficulty"), F.col("p_name").alias("explanation"), F.array("p_name").alias("answer_alternates")))
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("{oops")).otherwise(good)
    kind = F.when(F.col("p_partkey") % 7 == 0, "errored").otherwise("succeeded")
    return part.select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("custom_id"), kind.alias("result_type"), F.lit("end_turn").alias("stop_reason"), text.alias("text"))


@query("SELECT 'q' || p_partkey AS custom_id, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok FROM part")
def parse_responses(spark, d):
    return planning.parse_responses(responses(spark, d)).select("custom_id", F.col("data").isNotNull().alias("ok"))


@query(
    with_("questions")
    + """SELECT question_id, CASE WHEN ok THEN CASE WHEN question_id % 2 = 0 THEN 'middle' ELSE 'high' END ELSE difficulty END AS difficulty, CASE WHEN ok THEN answer END AS explanation, enriched OR ok AS enriched
    FROM (SELECT *, question_id % 5 <> 0 AND question_id % 7 <> 0 AS ok FROM questions)"""
)
def apply_enrichment(spark, d):
    q = questions(spark, d).withColumns({"explanation": F.lit(None).cast("string"), "answer_alternates": F.array().cast("array<string>")})
    done, _, _ = planning.apply_enrichment(q, question_tags(spark, d), planning.parse_responses(responses(spark, d)))
    return done.select("question_id", "difficulty", "explanation", "enriched")


@query(
    """SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'incomplete multiple-choice question' END AS reason, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS answer FROM part"""
)
def validate_generated(spark, d):
    four = F.transform(F.array(F.lit("a"), F.lit("B"), F.lit("C"), F.lit("D")), lambda x: F.struct(x.alias("label"), F.when(x == "B", F.col("p_brand")).otherwise(F.concat(x, F.lit(" "), "p_type")).alias("text")))
    item = F.to_json(F.struct(F.col("p_name").alias("stem"), four.alias("options"), F.when(F.col("p_partkey") % 3 != 0, "B").otherwise("E").alias("correct_label")))
    return planning.validate_generated(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), item.alias("json")), "mcq").select("item_id", "reason", "answer")
