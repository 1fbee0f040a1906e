"""Grading, reviews, journal replay and streams, on small examples."""

from pyspark.sql import functions as F

from quizloom.functions.grading import tokenize_answer
from quizloom.operators import crawl, dedup, grading, journal, planning, practice, review
from quizloom.streaming import jobs


def verdict(spark, response, answer, alternates=()):
    df = spark.createDataFrame([(1, response, answer, list(alternates))], "attempt_id long, response string, answer string, alternates array<string>")
    r = grading.judge_offline(df).first()
    return r["verdict"] if r["decided"] else "undecided"


def test_tokens(spark):
    def tokens(t):
        return spark.createDataFrame([(t,)], "t string").select(tokenize_answer(F.col("t"))).first()[0]

    assert tokens("Louis XIV") == tokens("Louis the Fourteenth") == tokens("Louis the 14th") == ["louis", "14"]
    assert tokens("Henry V") == ["henry", "5"]
    assert tokens("Civil War") == ["civil", "war"]


def test_judging(spark):
    for response, answer in [("Mali", "Mali Empire"), ("the Mali Empire of West Africa", "Mali Empire"), ("Louis the 14th", "Louis XIV"), ("cuneform", "Cuneiform"), ("Napoleon", "Napoleon Bonaparte"), ("mali empire!", "The Mali Empire")]:
        assert verdict(spark, response, answer) == "correct", response
    for response, answer in [("Louis XVI", "Louis XIV"), ("Songhai Empire", "Mali Empire"), ("Empire", "Mali Empire"), ("  ", "Mali")]:
        assert verdict(spark, response, answer) == "incorrect", response
    assert verdict(spark, "Roosevelt", "Franklin Delano Roosevelt") == "undecided"
    assert verdict(spark, "Manden Kurufaba", "Mali Empire", ["Manden Kurufaba"]) == "correct"


def attempts(spark, verdicts):
    rows = [(1, 9, i, v) for i, v in enumerate(verdicts)]
    df = spark.createDataFrame(rows, "user_id long, question_id long, attempt_id long, verdict string")
    return df.withColumn("created_at", F.timestamp_seconds(F.col("attempt_id") * 86400))


def test_rebuild(spark):
    assert review.rebuild_review_queue(attempts(spark, ["incorrect", "correct"])).count() == 0
    r = review.rebuild_review_queue(attempts(spark, ["incorrect"] * 3)).first()
    assert (r["ease"], r["lapses"]) == (2.1, 3)
    assert review.rebuild_review_queue(attempts(spark, ["incorrect"] * 20)).first()["ease"] == 1.3


def fold(verdicts):
    """The schedule by a plain loop."""
    entry = None
    for v in verdicts:
        if v in ("incorrect", "timeout"):
            entry = (1.0, 2.5, 1) if entry is None else (1.0, max(1.3, entry[1] - 0.2), entry[2] + 1)
        elif entry is not None:
            days = min(180.0, max(1.0, float(int(entry[0] * entry[1] + 0.5))))
            entry = None if days >= 180 else (days, min(3.0, entry[1] + 0.05), entry[2])
    return entry


def test_schedule_equals_loop(spark):
    for verdicts in (["correct"], ["incorrect"], ["timeout", "correct", "correct"], ["incorrect"] + ["correct"] * 4, ["incorrect"] + ["correct"] * 8, ["incorrect", "skipped", "incorrect", "correct"]):
        rows = review.sm2_schedule(attempts(spark, verdicts).repartition(3)).collect()
        want = fold(verdicts)
        assert len(rows) == (want is not None)
        if rows:
            assert (rows[0]["interval_days"], rows[0]["lapses"]) == (want[0], want[2]) and abs(rows[0]["ease"] - want[1]) < 1e-6


def test_fresh_questions(spark):
    q = spark.createDataFrame([(i,) for i in range(10)], "question_id long")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    done = attempts(spark, ["correct"] * 2).withColumn("question_id", F.col("attempt_id")).union(attempts(spark, ["correct"]).withColumn("question_id", F.lit(0).cast("long")))
    got = review.fresh_questions(users, q, done, 10).collect()
    one = [r for r in sorted(got, key=lambda r: r["rank"]) if r["user_id"] == 1]
    assert len(one) == 10 and [r["question_id"] for r in one[8:]] == [1, 0]
    assert len({r["question_id"] for r in got if r["user_id"] == 2}) == 10
    out = spark.createDataFrame([(1, 5)], "user_id long, question_id long")
    assert 5 not in {r["question_id"] for r in review.fresh_questions(users, q, done, 10, excluded=out).collect() if r["user_id"] == 1}


LINES = [
    '{"kind":"session","sessionId":1,"userId":4,"userName":"Ann","format":"tossup","filters":{"tags":[],"mode":"mixed"},"startedAt":"2024-01-01 10:00:00"}',
    '{"kind":"attempt","attemptId":1,"sessionId":1,"questionId":5,"verdict":"correct","createdAt":"2024-01-01 10:01:00"}',
    '{"kind":"attempt","attemptId":2,"sessionId":1,"questionId":6,"verdict":"incorrect","createdAt":"2024-01-01 10:02:00"}',
    '{"kind":"attempt","attemptId":3,"sessionId":8,"questionId":5,"verdict":"correct","createdAt":"2024-01-01 10:03:00"}',
    '{"kind":"attempt","attemptId":4,"sessionId":1,"questionId":77,"verdict":"correct","createdAt":"2024-01-01 10:04:00"}',
    '{"kind":"session_end","sessionId":1,"endedAt":"2024-01-01 11:00:00"}', "", "   ", "[1]", '{"no":"kind"}', '{"kind":"attempt","attem',
]


def bank_tables(spark):
    from quizloom.sources.bank import SCHEMAS

    return [spark.createDataFrame([], SCHEMAS[n]) for n in ("users", "sessions", "attempts")]


def test_journal_replay_is_idempotent(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text("\n".join(LINES))
    events = journal.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert {r["kind"]: r["events"] for r in journal.journal_stats(events).collect()} == {"session": 1, "attempt": 4, "session_end": 1, "malformed": 3}
    questions = spark.createDataFrame([(5,), (6,)], "question_id long")
    first = journal.restore(events, *bank_tables(spark), questions)
    r = first["report"].first().asDict()
    assert (r["sessions_added"], r["attempts_added"], r["attempts_orphan"], r["malformed"], r["users_added"]) == (1, 2, 2, 3, 1)
    assert first["sessions"].first()["ended_at"] == "2024-01-01 11:00:00" and first["users"].first()["name"] == "Ann"
    again = journal.restore(events, first["users"], first["sessions"], first["attempts"], questions)["report"].first().asDict()
    assert (again["sessions_added"], again["attempts_added"], again["attempts_skipped"], again["users_added"]) == (0, 0, 2, 0)


def test_journal_round_trip(spark, tmp_path):
    events = journal.parse_journal(spark.createDataFrame([(line,) for line in LINES], "value string")).where("kind is not null")
    journal.append_journal(events, str(tmp_path / "out"))
    journal.append_journal(events, str(tmp_path / "out"))
    back = journal.read_journal(spark, str(tmp_path / "out"))
    assert back.count() == 2 * events.count() and back.drop("line").exceptAll(events.drop("line").union(events.drop("line"))).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = attempts(spark, ["incorrect", "correct", "incorrect", "correct", "correct", "timeout"])
    for i, part in enumerate([rows.where("attempt_id % 2 = 1"), rows.where("attempt_id % 2 = 0")]):  # late rows come second
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for i in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in/{i}"))
        folder = str(tmp_path / "state")
        if i == 1:
            break
        jobs.stream_review_queue(stream, folder, str(tmp_path / "cp")).awaitTermination()
    both = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "state2")
    jobs.stream_review_queue(both, folder, str(tmp_path / "cp2")).awaitTermination()
    got, want = jobs.read_review_queue(spark, folder), review.sm2_schedule(rows)
    assert got.count() == 1 and got.exceptAll(want).count() == 0


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<html><title>T</title><body>" + "word " * 60 + "</body></html>")
    (tmp_path / "in/b.txt").write_text("short")
    taken = []
    jobs.stream_inbox(spark, str(tmp_path / "in"), lambda df, epoch: taken.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert {(r["path"].rsplit("/", 1)[1], r["status"], r["detail"]) for r in taken} == {("a.html", "done", None), ("b.txt", "error", "extracted text too short")}


def test_near_greedy(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()
    body = " ".join(words)
    rows = [(1, "tossup", "X", body, 1), (2, "tossup", "the x", body + " more", 2), (3, "tossup", "X", body + " again", 3), (4, "mcq", "X", body, 4), (5, "tossup", "Y", body, 5)]
    fill = [(100 + i, "tossup", f"z{i}", f"unrelated{i} text{i} about{i} things{i}", 100 + i) for i in range(60)]
    batch = spark.createDataFrame(rows + fill, "question_id long, type string, answer string, body string, position long")
    gone = {r["question_id"]: r["duplicate_of"] for r in dedup.dedup_near(batch, 8.0).where("duplicate_of is not null").collect()}
    assert gone == {2: 1, 3: 1}


def test_generation(spark):
    assert planning.rounds_to_run([], 0, 10) and not planning.rounds_to_run([10], 0, 10) and not planning.rounds_to_run([3, 0, 0], 0, 10)
    good = '{"leadin":"a","middle":["b"," "],"giveaway":"c","answer":"d"}'
    rows = planning.validate_generated(spark.createDataFrame([(1, good), (2, '{"leadin":"a"}'), (3, "{bad")], "item_id long, json string"), "tossup").orderBy("item_id").collect()
    assert [r["reason"] for r in rows] == [None, "incomplete tossup", "incomplete tossup"] and len(rows[0]["clues"]) == 3


def test_repeated_lines(spark):
    pages = [(1, p, f"Head 0\nbody {p} is here\nmore {p}\nPage {p + 1} of 4") for p in range(4)] + [(2, 0, "Head 0\nx"), (2, 1, "Head 0\ny")]
    out = {(r["doc_id"], r["page"]): r["text"] for r in crawl.strip_repeated_lines(spark.createDataFrame(pages, "doc_id long, page long, text string")).collect()}
    assert out[1, 2] == "body 2 is here\nmore 2" and out[2, 0] == "Head 0\nx"


def test_large_vocabularies_keep_all_tags(spark):
    """With more than 10,000 tags each one keeps its tagged and its titled sources."""
    n = 10_500
    tags = spark.range(n).select(F.format_string("tag%05d;", F.col("id")).alias("tag"))
    sources = spark.range(40).select(F.col("id").alias("source_id"), F.lit("studyguide").alias("kind"), F.lit("parsed").alias("status"), F.lit(True).alias("ai_train_ok"), F.format_string("On TAG%05d; and more", F.col("id") * 262).alias("title"), F.format_string("u%02d", F.col("id")).alias("url"))
    source_tags = tags.select("tag", (F.substring("tag", 4, 5).cast("long") % 40).alias("source_id"))
    want = {(f"tag{k:05};", k % 40) for k in range(n)} | {(f"tag{262 * k:05};", k) for k in range(40)}
    assert {(r["tag"], r["source_id"]) for r in practice.tag_resources(tags, sources, source_tags).collect()} == want
    texts = sources.select("source_id", F.lit("some text").alias("text"))
    assert {(r["tag"], r["source_id"]) for r in planning.grounding_excerpts(tags, sources, texts, source_tags).collect()} == want


def test_greedy_choice_over_chains_and_a_hot_row(spark):
    chain = [(k, k - 1) for k in range(1, 60)]
    star = [(k, 100) for k in range(101, 400)] + [(300, 250), (301, 99)]
    edges = sorted(set(chain + star))
    gone = {}
    for q in sorted({q for q, _ in edges}):
        kept = [d for e, d in edges if e == q and d not in gone]
        if kept:
            gone[q] = min(kept)
    got = dedup.greedy_gone(spark.createDataFrame(edges, "question_id long, near long"))
    assert {r["question_id"]: r["duplicate_of"] for r in got.collect()} == gone
    none = dedup.greedy_gone(spark.createDataFrame([], "question_id long, near long"))
    assert none.columns == ["question_id", "duplicate_of"] and none.isEmpty()


def test_scores_beyond_a_bound_are_all_found(spark):
    docs = [(i, " ".join(["common"] * (1 + i % 3) + [f"word{i % 7}", f"rare{i % 40}", "other" * (1 + i % 2)])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, body string")
    index = dedup.build_text_index(df)
    queries = df.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), dedup.query_terms(F.col("body")).alias("terms"))
    every = {(r["query_id"], r["doc_id"]): r["score"] for r in dedup.bm25_scores(queries, index).collect()}
    for above in (0.0, 2.0, 4.0, 8.0):
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in dedup.bm25_scores(queries, index, above=above).collect()}
        want = {k: v for k, v in every.items() if v > above}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_ladder_runs_behind_the_shuffle(spark):
    """Pairs that come in one task are dealt by their key before the costly ladder, and not once more."""
    pairs = spark.createDataFrame([(1, "a", "b", ["c"])], "attempt_id long, response string, answer string, alternates array<string>").coalesce(1)
    plan = grading.judge_offline(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("levenshtein") < plan.index("Exchange")
