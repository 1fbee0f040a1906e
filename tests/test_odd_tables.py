"""Queries against their SQL twins on small tables with ties, blanks and repeats, which the given tables lack."""

import datetime
import glob
import unicodedata

import pytest
from pyspark.sql import functions as F

from quizloom.functions import text
from quizloom.operators import planning
from quizloom.plans import queries_corpus, queries_jobs
from quizloom.streaming.state import review_schedules

duckdb = pytest.importorskip("duckdb")


def agree(spark, tmp_path, module, name, tables):
    """The rows of a query over ``tables`` (name to DataFrame), once they equal those of its SQL."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = module.QUERIES[name](spark, str(tmp_path))
    plain = lambda rows: sorted((tuple(str(v) for v in r) for r in rows))
    found = plain(got.collect())
    assert found == plain(con.sql(f"SELECT {', '.join(got.columns)} FROM ({module.ORACLE[name]})").fetchall())
    return found


def test_fetch_schedule_of_repeated_urls(spark, tmp_path):
    """Pages 21 and 42 have one URL, depth and kind, and so have 3 and 9: they go by their ids, in whatever order they are read."""
    pages = [(n, f"https://a.org/{'x' if n % 21 == 0 else 'y' if n in (3, 9) else n}") for n in (42, 21, 9, 3, 63, 5, 84)]
    df = spark.createDataFrame(pages, "page_id long, url string").coalesce(1)
    found = agree(spark, tmp_path, queries_corpus, "fetch_schedule", {"pages": df})
    at = {r[1]: float(r[-1]) for r in found}  # host, page_id, .., earliest_s
    assert at["21"] < at["42"] < at["63"] < at["84"] and at["3"] < at["9"]


def test_tossups_of_odd_texts(spark, tmp_path):
    """Texts too short for a question, bonus rounds, texts of no Latin letter, blank ones, and a document without an answer."""
    texts = ["De a.", "", None, "Вода 12", "bonus", "Bonus round of the town", "bonuses are no bonus " * 3, "ANSWER the town", "word " * 796, "word " * 797, "word " * 900, "a b c d e", "x"]
    docs = [(n, t, "en") for n, t in enumerate(texts)] + [(50, "A text without an answer " * 4, None)]
    # Brands and types so short that a body of few words falls under the least length.
    parts = [(n, "hot bolt", f"Brand#{n % 12}", "LARGE" if n % 2 else "ECONOMY") for n in range(60)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string, lang string"), "part": spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string")}
    reasons = [r[2] for r in agree(spark, tmp_path, queries_corpus, "parse_tossups_plain", tables) if r[1] == "0"]
    assert {"None", text.TOO_SHORT, text.TOO_LONG, text.BONUS} == set(reasons)


def test_journal_of_attempts_in_one_second(spark, tmp_path):
    """Attempts of one user at one question in one second are one attempt, that with the smallest id, whatever is read first."""
    at = datetime.datetime(2024, 1, 1, 10, 0, 0)
    kinds = ["error", "purchase", "view", "signup"]
    rows = [(n, at + datetime.timedelta(seconds=n % 3, milliseconds=n), n % 2, kinds[n % 4], 1.0, '{"k": %d}' % (n % 5)) for n in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = agree(spark, tmp_path, queries_jobs, "stream_journal", {"events": df.orderBy(F.desc("event_id")).coalesce(1)})
    assert 30 <= len(found) < 200


def test_schedules_need_no_python(spark, tmp_path):
    """Each of many pairs with few attempts cost calls to a Python worker before; now none is started for them."""
    df = spark.createDataFrame([(1, 2, 3, "error", datetime.datetime(2024, 1, 1))], "user_id long, question_id long, attempt_id long, verdict string, created_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    plan = review_schedules(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "TransformWithState" not in plan


def test_accents_of_every_character(spark):
    """Each character of Unicode, alone and in texts of many, as Python decomposes it; no Python worker takes texts any more."""
    chars = [chr(n) for n in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    few = [chars[k : k + 97] for k in range(0, len(chars), 97) if k < 0x3400 or 0xA000 <= k < 0x20000 or k % 40 == 0]
    rows = ["é ö̧", *("x".join(f) for f in few), *(c for f in few for c in f[:1])]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "n int, t string")
    found = df.select("t", text.fold_accents(F.col("t")).alias("bare"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert [(r["t"], r["bare"]) for r in found.collect() if r["bare"] != strip(r["t"])] == []


def _tables_with_articles(spark):
    """Texts of nothing but articles, and such that begin with thousands of them; some are equal behind them."""
    words = "alpha river copper seven winter garden marble lantern orbit velvet thunder meadow quartz harbor".split()
    said = lambda n, k: " ".join(words[i % len(words)] + chr(97 + n) for i in range(k))
    docs = [(n, ("The " * 3000 if n % 4 == 0 else "a, AN é " if n % 4 == 1 else "") + said(n % 7, 14 + n % 3), "en", f"s{n % 2}", 0) for n in range(24)]
    docs += [(24, "a an the " * 1500, "en", "s0", 0), (25, "The " * 4000, "en", "s1", 0)]
    bank = [(n, ("The " * 3000 if n % 2 else "") + said(n, 15)) for n in range(9)]
    parts = [(n, "hot bolt", f"Brand#{n % 12}", "LARGE" if n % 2 else "ECONOMY") for n in range(30)]
    labels = [(n, n % 2, int(n % 9 == 0)) for n in range(0, 26, 3)]
    return {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "benchmark": spark.createDataFrame(bank, "item_id long, text string"),
        "part": spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }


@pytest.mark.parametrize("name", ["normalize_answer", "bm25_top5", "find_near_duplicates", "fingerprint_dedup", "fingerprint_dedup_incremental", "near_duplicates", "dedup_near", "parse_pipeline"])
def test_texts_of_many_articles(spark, tmp_path, name):
    """Some 800 articles at the beginning of a text ended the executor that brought it into its normal form."""
    assert agree(spark, tmp_path, queries_corpus, name, _tables_with_articles(spark))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _journal_tables(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(n, at + datetime.timedelta(hours=n % 50, seconds=n % 7), n % 9, ["error", "purchase", "view", "signup"][n % 4], 1.0, '{"k": %d}' % (n % 5)) for n in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    parts = spark.createDataFrame([(n, "hot bolt", "Brand#1", "LARGE", 1, 1.0) for n in range(4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    return {"events": events, "part": parts}


def test_restored_attempts_read_the_journal_once(spark, tmp_path):
    """Filters on a line's fields wrote the parse out again, and each step went back to the whole journal."""
    found = agree(spark, tmp_path, queries_jobs, "restore_attempts", _journal_tables(spark, tmp_path))
    assert {"added", "orphan"} <= {r[0] for r in found}
    plan = _plan(queries_jobs.journal_events(spark, str(tmp_path)).where("kind = 'attempt'").select("questionId"))
    assert plan.count("from_json") <= 4  # there are four kinds of lines
    assert "from_json" not in _plan(queries_jobs.restore_attempts(spark, str(tmp_path)))


def test_resolved_sessions_read_the_journal_once(spark, tmp_path):
    """Sessions are a small part of the journal, which each of four joins read and parsed."""
    assert len(agree(spark, tmp_path, queries_jobs, "resolve_sessions", _journal_tables(spark, tmp_path))) > 9
    assert "from_json" not in _plan(queries_jobs.resolve_sessions(spark, str(tmp_path)))


def test_replayed_journal_is_kept_without_its_text(spark, tmp_path):
    """The replays read fields only; the lines' text was written and read with them."""
    before = set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/journal-*"))
    agree(spark, tmp_path, queries_jobs, "restore_again", _journal_tables(spark, tmp_path))
    (made,) = set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/journal-*")) - before
    assert "line" not in spark.read.parquet(made).columns


def test_study_topics_tidy_each_phrase_once(spark, tmp_path):
    """Each test of a phrase tidied it anew, and guides were searched by the tasks that read the file; two parts of one name are one topic."""
    parts = [(n, ["hot bolt", "blue ring", "the end", "x"][n % 4], f"Brand#{n}", ["LARGE", "ECONOMY"][n % 2]) for n in range(40)]
    df = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string")
    texts = spark.createDataFrame([(1, "-  Hot   Bolt, - Blue Ring -\n\n• The End\n– Roman Empire – of the 2nd Kind\nplain - Line"), (2, None), (3, "- Roman Empire\n-")], "source_id long, text string")
    found = planning.study_topics(texts)
    assert [tuple(r) for r in found.collect()] == [("Hot Bolt", 1, 0, 1), ("Blue Ring", 1, 0, 2), ("Roman Empire", 1, 3, 1)]
    assert _plan(found).count("regexp_replace") <= 8
    df.write.parquet(f"{tmp_path}/part.parquet")
    assert "RepartitionByExpression" in _plan(queries_corpus.study_topics(spark, str(tmp_path)))
