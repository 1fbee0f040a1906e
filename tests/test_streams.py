"""Streams with keyed state, the intake queue, and the containment join, each against its batch twin or brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quizloom.operators import journal, practice, review
from quizloom.operators.containment import contained
from quizloom.sources import bank
from quizloom.streaming import inbox, jobs
from quizloom.streaming.state import lockouts, state_on_disk


@pytest.mark.parametrize("seed", [1, 2])
def test_schedules_in_any_order(spark, tmp_path, seed):
    """Attempts shuffled over micro-batches, a third of them delivered twice."""
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), rng.randint(1, 4), n, rng.choice(["correct", "correct", "correct", "incorrect", "timeout"]), 1_700_000_000 + rng.randint(0, 400) * 43_200) for n in range(300)]
    df = spark.createDataFrame(rows, "user_id long, question_id long, attempt_id long, verdict string, s long").withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    df.union(df.where("attempt_id % 3 = 0")).repartition(5, F.rand(seed)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    jobs.stream_review_queue(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    got, want = jobs.read_review_queue(spark, str(tmp_path / "state")), review.sm2_schedule(df)
    assert want.count() > 3 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(str(tmp_path / "state/queue")).select("epoch").distinct().count() > 2
    assert not (tmp_path / "state/attempts").exists()  # nothing is kept to be read again


def test_lockouts_with_clearing(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), n, 1_700_000_000 + rng.randint(0, 6000) + rng.random(), rng.random() < 0.8) for n in range(600)]
    rows += [(4, 1000 + n, 1_700_003_000.0 + n // 3, n != 7) for n in range(30)]  # several in one second, a success among them
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double, failed boolean").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    last = spark.createDataFrame([(9, 5000, 1_700_100_000, False)], "user_id long, event_id long, s long, failed boolean").select("user_id", "event_id", "failed", F.timestamp_seconds("s").alias("ts"))
    df.repartition(4, F.rand(1)).write.parquet(str(tmp_path / "in"))
    last.select(df.columns).write.mode("append").parquet(str(tmp_path / "in"))
    found = lockouts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), threshold=8, watermark="3 hours")
    with state_on_disk(spark):
        running = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = sorted((r["event_id"], r["failures"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["event_id"], r["failures"]) for r in practice.failed_attempt_lockouts(df).collect())
    assert got == want and len(want) > 20


def test_lockouts_of_many_users_in_one_bucket(spark, tmp_path):
    """Users whose ids are texts, one without, share two buckets over many micro-batches; some rows come twice. State is read and written by bucket, not by user."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c", "d", None]), n, 1_700_000_000.0 + n * 20 + rng.randint(0, 900), rng.random() < 0.8) for n in range(900)]
    df = spark.createDataFrame(rows, "user_id string, event_id long, s double, failed boolean").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    last = spark.createDataFrame([("z", 5000, 1_700_100_000.0, False)], "user_id string, event_id long, s double, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    for k in range(6):
        part = df.where(f"event_id div 150 = {k}").orderBy("s")
        part.unionByName(part.where("event_id % 7 = 0")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last.drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = lockouts(spark.readStream.schema(df.drop("s").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), threshold=8, watermark="1 hour", buckets=2)
    with state_on_disk(spark):
        running = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = sorted((r["event_id"], r["failures"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["event_id"], r["failures"]) for r in practice.failed_attempt_lockouts(df.drop("s").fillna("none", "user_id")).collect())
    assert got == want and len(want) > 20


def page(n):
    return "<html><title>T</title><body>" + f"word{n} " * 60 + "</body></html>"


def test_inbox_and_a_run_that_dies(spark, tmp_path):
    log = str(tmp_path / "log")
    items = spark.createDataFrame(
        [("file", "a.html", "A", 100), ("file", "b.exe", None, 5), ("file", "big.pdf", None, 1 << 30), ("url", "ftp://x.org/1", None, None), ("url", "https://good.org/1", None, None), ("url", "https://bad.org/1", None, None),
         ("file", "gone.txt", None, 1), ("url", "https://good.org/none", None, None), ("post", "x", None, None), ("file", "a.html", "again", 100)],
        "kind string, path_or_url string, title string, bytes long",
    )
    inbox.enqueue(items, log, "0")
    inbox.enqueue(items, log, "0b")  # queued once
    assert {r["status"]: r["items"] for r in inbox.inbox_counts(spark, log).collect()} == {"pending": 5, "error": 4}
    files = spark.createDataFrame([("a.html", bytearray(page(1).encode()))], "path string, content binary")
    pages = spark.createDataFrame([("https://good.org/1", page(2)), ("https://bad.org/1", page(3))], "url string, html string")
    allowed = spark.createDataFrame([("good.org",)], "host string")
    taken = []

    def dies(texts):
        taken.extend(r["path"] for r in texts.collect())
        raise RuntimeError("killed between claim and result")

    with pytest.raises(RuntimeError):
        inbox.drain_inbox(spark, log, "1", files, pages, allowed, dies)
    assert {r["status"]: r["items"] for r in inbox.inbox_counts(spark, log).collect()} == {"processing": 5, "error": 4}
    inbox.enqueue(items.where("path_or_url = 'a.html'"), log, "1b")  # a claimed item is not queued anew

    def works(texts):
        taken.extend(r["path"] for r in texts.collect())
        return texts.select("item_id", F.lit("2 tossups, 0 mcqs").alias("detail"))

    inbox.drain_inbox(spark, log, "2", files, pages, allowed, works)
    assert sorted(taken) == ["a.html", "a.html", "https://good.org/1", "https://good.org/1"]
    state = {r["path_or_url"]: (r["status"], r["detail"]) for r in inbox.states(spark, log).collect()}
    assert state == {
        "a.html": ("done", "2 tossups, 0 mcqs"), "https://good.org/1": ("done", "2 tossups, 0 mcqs"), "b.exe": ("error", "unsupported file type exe"), "big.pdf": ("error", "file larger than 64 MB"),
        "ftp://x.org/1": ("error", "not an http(s) URL"), "https://bad.org/1": ("error", "host not allowed: bad.org"), "gone.txt": ("error", "file is missing"), "https://good.org/none": ("error", "not fetched"), "x": ("error", "neither file nor url"),
    }
    assert inbox.drain_inbox(spark, log, "3", files, pages, allowed, works).count() == 0 and len(taken) == 4


def test_containment(spark):
    rng = random.Random(8)
    words = ["war", "World War", "art", "Ärt", "x", "no", "War of 1812", "", "zz zz", "1812", None, "ar", "absent words", "of"]
    titles = [None, "", "x", "ar", "Warsaw", "The War of 1812", "ÄRT history", *[" ".join(rng.choice([w for w in words if w] + ["guide", "set"]) for _ in range(rng.randint(1, 6))) for _ in range(120)]]
    texts = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(titles)], "source_id long, title string, _low string").drop("_low")
    needles = spark.createDataFrame([(w,) for w in words + ["art"]], "tag string")
    got = sorted((r["source_id"], r["tag"]) for r in contained(texts, needles, "title", "tag").collect())
    assert got == sorted((i, w) for i, t in enumerate(titles) if t is not None for w in set(words) if w and w.lower() in t.lower())
    assert contained(texts, needles.limit(0), "title", "tag").count() == 0 and contained(texts.limit(0), needles, "title", "tag").count() == 0


def test_containment_of_many_needles(spark):
    """A hundred thousand tags: no text is held against all of them."""
    needles = spark.range(100_000).select(F.concat(F.lit("topic "), F.col("id").cast("string"), F.lit(" end")).alias("tag"))
    texts = spark.range(2000).select(F.col("id").alias("source_id"), F.concat(F.lit("Guide to topic "), (F.col("id") * 40).cast("string"), F.lit(" end")).alias("title"))
    found = contained(texts, needles, "title", "tag")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 2000


def test_weak_areas_with_resources(spark):
    attempts = spark.createDataFrame([(n, 1, 1, n % 4, "correct" if n % 4 == 0 else "incorrect") for n in range(40)], "attempt_id long, user_id long, session_id long, question_id long, verdict string")
    tags = spark.createDataFrame([(0, "Leaders"), (1, "Wars"), (2, "Wars"), (3, "Art")], "question_id long, tag string")
    sources = spark.createDataFrame([(1, "studyguide", "parsed", "All wars", "u1"), (2, "index", "fetched", None, "u0"), (3, "rules", "parsed", "wars and rules", "u3"), (4, "studyguide", "extracted", "more WARS", "u4"), (5, "packet", "parsed", "wars", "u5"), (6, "studyguide", "error", "wars", "u6")], "source_id long, kind string, status string, title string, url string")
    given = spark.createDataFrame([(2, "Wars"), (2, "Wars")], "source_id long, tag string")
    got = {r["tag"]: [tuple(x) for x in r["resources"]] for r in practice.weak_areas_with_resources(attempts, tags, sources, given).collect()}
    assert got == {"Wars": [("u0", "u0"), ("All wars", "u1"), ("wars and rules", "u3")], "Art": []}


def test_history_in_any_order(spark, tmp_path):
    """Sessions, ends and attempts of a shuffled and repeated journal equal the batch replay."""
    rng = random.Random(4)
    lines = []
    for s in range(40):
        day = f"2026-03-{s % 20 + 1:02}"
        lines.append(f'{{"kind":"session","sessionId":{s},"userId":{s % 5},"userName":"u{s % 5}","format":"tossup","startedAt":"{day} 10:00:{s:02}"}}')
        lines += [f'{{"kind":"attempt","attemptId":{s * 10 + k},"sessionId":{s},"userId":{s % 5},"questionId":{k},"verdict":"correct","createdAt":"{day} 10:{k:02}:00"}}' for k in range(5)]
        if s % 4:
            lines.append(f'{{"kind":"session_end","sessionId":{s},"endedAt":"{day} 11:00:00"}}')
    journal_rows = spark.createDataFrame([(x,) for x in lines], "value string")
    again = lines + rng.sample(lines, 80) + ["{broken", " "]
    rng.shuffle(again)
    folder = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(x,) for x in again[k::3]], "value string").coalesce(1).write.mode("append").text(folder)
    beat = ['{"kind":"session","sessionId":-1,"userId":0,"startedAt":"2200-01-01"}', '{"kind":"session_end","sessionId":-1,"endedAt":"2200-01-01 00:00:00"}']
    spark.createDataFrame([(x,) for x in beat], "value string").coalesce(1).write.mode("append").text(folder)
    for _ in range(2):  # the second start finds nothing new
        for running in jobs.stream_history(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"), "60 days"):
            running.awaitTermination()
    empty = [spark.createDataFrame([], bank.SCHEMAS[n]) for n in ("users", "sessions", "attempts")]
    replay = journal.restore(journal.parse_journal(journal_rows), *empty, spark.range(5).withColumnRenamed("id", "question_id"))
    want = {(r["started_at"], r["ended_at"]) for r in replay["sessions"].collect()}
    got = {(r["session_id"], str(r["started_at"]), str(r["ended_at"]) if r["ended_at"] else None) for r in spark.read.parquet(str(tmp_path / "out/sessions")).where("session_id >= 0").collect()}
    assert {x[1:] for x in got} == want and len(got) == len(want) == 40
    assert spark.read.parquet(str(tmp_path / "out/sessions")).where("session_id >= 0").count() == 40
    taken = spark.read.parquet(str(tmp_path / "out/attempts"))
    assert taken.count() == 200 and taken.select("attempt_id").distinct().count() == 200
