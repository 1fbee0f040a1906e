"""URLs, document kinds and HTML, as Column to Column functions."""

from __future__ import annotations

import html as html_references

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.functions.text import bound

# Words in a URL or title that tell what a document is, tried in this order.
RULES_HINTS = ["rule", "scoresheet", "score sheet", "format"]
GUIDE_HINTS = ["study", "guide", "resource", "syllabus", "topic"]
PACKET_HINTS = ["packet", "round", "question", "tossup", "bowl", "bee", "exam", "set"]
# Parts of paths that never lead to documents, and endings that always do.
BOILERPLATE_PATHS = [
    "/about", "/contact", "/apply", "/registration", "/privacy", "/testimonial", "/team", "/hosting", "/partners", "/social-media", "/cart", "/checkout",
    "/my-account", "/donate", "/shop", "/product", "/tag/", "/author/", "/wp-login", "/feed", "/category/",
]
DOCUMENT_ENDINGS = [".pdf", ".docx", ".doc", ".txt", ".rtf"]
# Elements whose content is no text of the page, and named character references.
DROPPED_ELEMENTS = ["script", "style", "noscript", "nav", "footer", "svg"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def any_of(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


# By pattern and not by a URL parser: links of real pages break its rules (stray per cent signs, spaces), and still have a host.
_HOST, _PATH, _QUERY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", r"\?([^#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def url_query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit(""))


def detect_kind(url: Column, content_type: Column, content: Column) -> Column:
    """pdf, docx, html, text or unknown, by first bytes, content type and ending."""
    kind, path = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.get(F.split(url, r"\?"), F.lit(0)))
    head = F.coalesce(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), F.lit(""))
    return (
        F.when(head.startswith("%PDF") | kind.contains("application/pdf") | path.endswith(".pdf"), "pdf")
        .when(head.startswith("PK") & (path.endswith(".docx") | kind.contains("wordprocessingml") | kind.contains("officedocument")), "docx")
        .when(kind.contains("text/html") | kind.contains("application/xhtml") | F.regexp_replace(head, r"^\s+", "").startswith("<"), "html")
        .when(kind.contains("text/plain") | path.endswith(".txt"), "text")
        .otherwise("unknown")
    )


def classify_source(url: Column, title: Column, kind: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit(""))))
    return (
        F.when(kind == "html", "index")
        .when(any_of(hay, RULES_HINTS), "rules")
        .when(any_of(hay, GUIDE_HINTS), "studyguide")
        .when(any_of(hay, PACKET_HINTS), "packet")
        .when(kind.isin("pdf", "docx"), "exam")
        .otherwise("unknown")
    )


def is_boilerplate(url: Column) -> Column:
    """Paths of site furniture; on Google hosts, all but documents."""
    google = url_host(url).endswith("google.com") & ~url.rlike(r"/(?:document|spreadsheets|presentation|file)/d/|[?&]export=")
    return google | any_of(F.lower(url_path(url)), BOILERPLATE_PATHS)


def is_document(url: Column, document_hosts: list[str] = ()) -> Column:
    found = url_host(url).isin(list(document_hosts)) if document_hosts else F.lit(False)
    for ending in DOCUMENT_ENDINGS:
        found = found | F.lower(url_path(url)).endswith(ending)
    return found


def normalize_doc_url(url: Column) -> Column:
    """Viewer pages of Google Docs and Drive, as the addresses that return the document itself."""
    host, path, query = url_host(url), url_path(url), url_query(url)
    doc, file = F.regexp_extract(path, r"/document/d/([A-Za-z0-9_-]+)", 1), F.regexp_extract(path, r"/file/d/([A-Za-z0-9_-]+)", 1)
    opened = F.regexp_extract(F.concat(F.lit("?"), query), r"[?&]id=([A-Za-z0-9_-]+)", 1)
    some = F.when(file != "", file).when(opened != "", opened)
    ours = host.isin("docs.google.com", "drive.google.com")
    return (
        F.when(ours & (doc != ""), F.concat(F.lit("https://docs.google.com/document/d/"), doc, F.lit("/export?format=txt")))
        .when(ours & some.isNotNull(), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), some))
        .otherwise(url)
    )


def _unescape(text: str | None) -> str | None:
    return None if text is None else html_references.unescape(text).replace("\xa0", " ")


@F.arrow_udf(T.StringType())
def _unescaped(text: pa.Array) -> pa.Array:
    return pa.array([_unescape(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _all_unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if ts is None else [_unescape(t) for t in ts] for ts in texts.to_pylist()], pa.list_(pa.string()))


def _frequent(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def rare_references(text: Column) -> Column:
    """Whether a text holds a character reference, named or numeric, that is none of the frequent ones."""
    rest = text
    for name in ENTITIES:
        rest = F.replace(rest, F.lit(name), F.lit(""))
    return F.when(text.contains("&"), rest.rlike(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*;)")).otherwise(F.lit(False))


def unescape(text: Column, rare: Column | None = None) -> Column:
    """Character references as characters: the frequent ones by built-in functions; only texts with others go through Python.

    ``text`` is named several times, and so is ``rare``, which is rare_references(text): where they are more than columns, project them first.
    """
    rare = rare_references(text) if rare is None else rare
    return F.when(rare, _unescaped(F.when(rare, text))).when(text.contains("&"), _frequent(text)).otherwise(text)


def stripped_html(html: Column) -> Column:
    """The page with a line feed for each tag; scripts, styles, navigation, footers, pictures and the head left out. References stay as they are."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in [*DROPPED_ELEMENTS, "head"]:
        body = F.regexp_replace(body, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>", "")
    return F.regexp_replace(body, r"(?s)<[^>]*>", "\n")


def text_lines(body: Column) -> Column:
    """A page's lines, trimmed, without blank ones."""
    lines = F.transform(F.split(body, r"[\n\r]"), lambda line: F.regexp_replace(line, r"^[\s ]+|[\s ]+$", ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def html_text(html: Column) -> Column:
    """The page's text as one expression; over a table, with_html_text() computes each step once."""
    return text_lines(unescape(stripped_html(html)))


def with_html_text(rows: DataFrame, html_col: str, name: str = "text") -> DataFrame:
    """``rows`` with the text of the pages in a column: a line for each run between tags. Each step is a projection of its own, so none is computed twice."""
    body = rows.withColumn("_body", stripped_html(F.col(html_col)))
    return body.withColumn("_rare", rare_references(F.col("_body"))).withColumn(name, text_lines(unescape(F.col("_body"), F.col("_rare")))).drop("_body", "_rare")


def page_title(html: Column) -> Column:
    title = F.trim(unescape(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)))
    return F.when(title != "", F.substring(title, 1, 300))


def join_url(base: Column, link: Column) -> Column:
    """A link of the page at ``base`` as an absolute URL without fragment: absolute, //host, /path, ?query and relative forms."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    base = F.regexp_replace(base, "#.*$", "")
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    no_query = F.regexp_replace(base, r"\?.*$", "")
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(F.substr(no_query, F.length(root) + 1), r"^(.*/)", 1), F.lit("")), F.lit("/")))
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(no_query, link))
        .when(link == "", base)
        .otherwise(F.concat(folder, link))
    )
    return bound(joined, without_dots)


def without_dots(url: Column) -> Column:
    """The URL with its path's ``.`` and ``..`` parts resolved, however deep: one fold over the parts."""
    front = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, query = url_path(url), F.regexp_extract(url, r"(\?.*)$", 1)
    none = F.array().cast("array<string>")
    # The first part is what stands before the first slash: nothing. A part in the last place leaves a slash behind if it is a dot or two.
    folded = lambda parts: F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), none,
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
    )
    kept = bound(F.split(path, "/"), folded)
    resolved = bound(kept, lambda k: F.concat(F.array_join(k, "/"), F.when(path.rlike(r"/\.{1,2}$") & (F.size(k) > 0), "/").otherwise("")))
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)") & (front != ""), F.concat(front, F.lit("/"), resolved, query)).otherwise(url)


def page_links(html: Column) -> Column:
    """The href of each link, in the order of the page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(1))
    raw = F.transform(tags, lambda h: F.regexp_replace(h, r"""^["']|["']$""", ""))
    other = F.exists(raw, rare_references)
    return F.transform(F.when(other, _all_unescaped(F.when(other, raw))).otherwise(F.transform(raw, _frequent)), F.trim)


def display_name(source_id: Column, title: Column, url: Column) -> Column:
    """A source's title, or the last telling part of its path, or its id parameter, or its URL."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: (p != "") & ~F.lower(p).isin(GENERIC_PARTS))
    last = F.get(parts, F.size(parts) - 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    by_id = F.nullif(F.regexp_extract(F.concat(F.lit("?"), url_query(url)), r"[?&]id=([^&]*)", 1), F.lit(""))
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), decoded, by_id, url)


# Parts of a path that name no document.
GENERIC_PARTS = ["export", "edit", "view", "preview", "open", "pub", "uc", "download", "file", "d"]
