"""The word index, dense numbers, and the parse job that uses both."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizloom.operators import dedup, index, parse, ranks
from quizloom.operators.index import TextIndex
from quizloom.sources.scratch import scratch_folder, shuffles_freed, staged


def texts(seed, n, common="everywhere"):
    """Documents of rare and frequent words; one word is in all of them, up to thirty times."""
    rng = random.Random(seed)
    words = [f"w{i}x" for i in range(400)]
    return [(i, " ".join([common] * rng.randint(1, 30) + [words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randint(3, 60))])) for i in range(n)]


def brute(queries, postings, k, above=None):
    """The k best of all pairs that share a word."""
    best = {}
    for r in dedup.bm25_scores(queries, postings).collect():
        best.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    return {(q, d, round(-s, 5)) for q, found in best.items() for s, d in sorted(found)[:k] if above is None or -s > above}


def found(rows):
    return {(r["query_id"], r["doc_id"], round(r["score"], 5)) for r in rows.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(texts(1, 1500), "doc_id long, body string")
    queries = spark.createDataFrame([(q, ["everywhere", f"w{q}x", f"w{q * 3}x", f"w{q + 200}x", "unknown"]) for q in range(60)] + [(99, ["everywhere"]), (98, ["unknown"]), (97, ["w399x"])], "query_id long, terms array<string>")
    return docs, dedup.build_text_index(docs).cache(), queries.cache()


@pytest.mark.parametrize("k,above", [(5, None), (1, None), (40, None), (5, 7.5)])
def test_top_k_is_exact(corpus, k, above):
    docs, postings, queries = corpus
    want = brute(queries, postings, k, above)
    assert found(dedup.search_bm25(queries, postings, k, above)) == want and len(want) > 10


def test_common_word_does_not_pair_all(corpus):
    """A word of all 1,500 documents: queries that rarer words decide meet few documents, and one of that word alone few of its blocks."""
    docs, postings, queries = corpus
    n, mean = postings.select("doc_id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    held = index.blocks(postings, n, mean).cache()
    assert held.where("term = 'everywhere'").agg(F.max(F.size("docs"))).first()[0] < 2 * index.BLOCK
    pairs, _ = index.met(queries, held, n, mean, mean, 5)
    met = {r["query_id"]: r["count"] for r in pairs.groupBy("query_id").count().collect()}
    sharing = {r["query_id"]: r["count"] for r in dedup.bm25_scores(queries, postings).groupBy("query_id").count().collect()}
    assert all(sharing[q] == 1500 for q in range(60)) and sum(met.values()) < sum(sharing.values()) / 4
    assert met[99] < 700


@pytest.mark.parametrize("k,above", [(5, None), (1, None), (5, 7.5)])
def test_many_queries_go_to_shards_of_documents(corpus, monkeypatch, k, above):
    """All words in arrays: the same k best, ties by id among copies too, and k rows a shard of a query at most, however many documents share its words."""
    docs, postings, queries = corpus
    copies = postings.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 2000)
    both = postings.unionByName(copies)
    n, mean = both.select("doc_id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    held = index.blocks(both, n, mean).cache()
    asked = index.asked_words(queries, held, n)
    rows = index._by_shards(asked.select("query_id", "term", "idf"), held, n, mean, k, above or 0.0)
    most = rows.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most <= k * index.LEAST_SHARDS < 1500
    monkeypatch.setattr(index, "PAIRED", 0)
    monkeypatch.setattr(index, "met", None)
    want = brute(queries, both, k, above)
    assert found(dedup.search_bm25(queries, both, k, above)) == want and len(want) > 10
    monkeypatch.setattr(index, "ASKED_AT_ONCE", 20)
    assert found(dedup.search_bm25(queries, both, k, above)) == want


def test_shards_are_plain_numbers():
    """Postings came as arrays, three for each block, most of them of one posting; a shard's worker held several hundred bytes a posting."""
    rng = np.random.default_rng(5)
    n = 200_000
    held = pd.DataFrame({"_no": rng.integers(0, 5000, n), "doc_id": rng.integers(0, 8000, n), "_part": rng.random(n)}).drop_duplicates(["_no", "doc_id"])
    queries = pd.DataFrame({"query_id": np.arange(50), "_nos": [rng.choice(6000, 8, replace=False) for _ in range(50)]})
    tracemalloc.start()
    got = index._best((0, 0), held, queries, 3, 0.5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120 * n
    for q, nos in zip(queries["query_id"], queries["_nos"], strict=True):
        sums = held[held["_no"].isin(nos)].groupby("doc_id")["_part"].sum()
        want = sorted(sums[sums > 0.5].items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]
        assert sorted(got[got["query_id"] == q]["doc_id"]) == sorted(d for d, _ in want)


def test_search_of_nothing(spark, corpus):
    docs, postings, queries = corpus
    assert dedup.search_bm25(queries, postings.limit(0)).count() == 0 and dedup.search_bm25(queries.limit(0), postings).count() == 0


def test_segments(spark, corpus, monkeypatch):
    docs, postings, queries = corpus
    kept = TextIndex(spark, scratch_folder(spark, "index"))
    assert kept.search(queries).count() == 0
    monkeypatch.setattr(index, "MOST_SEGMENTS", 4)
    for run in range(7):
        assert kept.append(postings.where(F.col("doc_id") % 7 == run), f"run {run}")
        assert not kept.append(postings.where(F.col("doc_id") % 7 == run), f"run {run}")  # a run that is repeated adds nothing
    assert 1 < len(kept.manifest()["segments"]) <= 5
    assert found(kept.search(queries)) == brute(queries, postings, 5)
    assert found(kept.search(queries, 5, 7.5)) == brute(queries, postings, 5, 7.5)
    # A segment that no manifest names, as a run that died leaves it, is not there.
    index.blocks(postings, 10, 5.0).write.parquet(f"{kept.folder}/segments/lost/blocks")
    assert found(kept.search(queries)) == brute(queries, postings, 5)
    gone = docs.where("doc_id % 3 = 0").select("doc_id")
    kept.remove(gone, "removal")
    left = postings.where("doc_id % 3 != 0")
    assert found(kept.search(queries)) == brute(queries, left, 5)
    kept.merge()
    assert found(kept.search(queries)) == brute(queries, left, 5)
    kept.merge(keep=0)
    now = kept.manifest()
    assert len(now["segments"]) == 1 and now["removed"] == [] and now["segments"][0][1] == 1000
    assert found(kept.search(queries)) == brute(queries, left, 5)
    kept.append(postings.limit(0), "nothing")
    assert len(kept.manifest()["segments"]) == 1


def test_dense_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["all begin alike", "all begin alike too", None, f"name {i}"]), i) for i in range(3000)] + [("same", 1)] * 50
    df = spark.createDataFrame(rows, "name string, n int").repartition(6)
    got = sorted(ranks.ranked(df, ["name"], "r").collect(), key=lambda r: r["r"])
    assert [r["r"] for r in got] == list(range(1, len(rows) + 1))
    assert [r["name"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or ""))
    down = sorted(ranks.ranked(df, [F.desc("n")], "r").collect(), key=lambda r: r["r"])
    assert [r["n"] for r in down] == sorted((r[1] for r in rows), reverse=True)
    assert ranks.ranked(df.limit(0), ["name"]).count() == 0


def test_equal_keys_spread(spark):
    """A key with all rows goes to many tasks."""
    df = spark.range(200_000).select(F.lit("hot").alias("key"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = df.withColumn("_tie", F.xxhash64("key", "id")).repartitionByRange("key", "_tie").groupBy(F.spark_partition_id()).count().collect()
        assert len(held) > 1 and max(r["count"] for r in held) < 150_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks.ranked(df, ["key"], "r").agg(F.sum("r"), F.countDistinct("r")).first() == (200_000 * 200_001 // 2, 200_000)


BODY = "{0} built the long bridge over the wide valley near the northern harbour in those years. Sailors of {0} praised the tall lighthouse. For ten points, name this town known for {1}."


def packet(*names, answer=None):
    return "\n\n".join(f"{i + 1}. {BODY.format(n, w)}\nANSWER: {answer or n.split()[0]} (accept Old {n.split()[0]})" for i, (n, w) in enumerate(names))


EXAM = "1. Which of these rivers crosses the old capital?\nA. Tiber\nB. Rhine\nC. Danube\nAnswer: B\n"


@pytest.fixture()
def bank(spark):
    sources = spark.createDataFrame(
        [(1, "packet", "extracted", "https://a.org/2020-HS-set.pdf"), (2, "packet", "extracted", "https://a.org/b.pdf"), (3, "studyguide", "extracted", "https://a.org/g.pdf"), (4, "packet", "fetched", "https://a.org/c.pdf"), (5, "exam", "extracted", "https://a.org/EMS.pdf")],
        "source_id long, kind string, status string, url string",
    ).withColumn("title", F.lit(None).cast("string"))
    # The second packet republishes one tossup exactly, one lightly reworded, and has one of its own and a broken one.
    near = packet(("Carthage", "purple")).replace("long bridge", "great bridge").replace("those years", "early years")
    rows = [
        (1, packet(("Carthage", "purple"), ("Athens", "owls"))), (2, packet(("Athens", "owls")) + "\n\n" + near + "\n\n" + packet(("Sparta", "hoplites")) + "\n\nToo short.\nANSWER: none"),
        (3, "The empire and its emperor. " * 20), (4, packet(("Corinth", "pots"))), (5, EXAM),
    ]
    return sources, spark.createDataFrame(rows, "source_id long, text string")


BANK = "question_id long, type string, answer string, body string, fingerprint string"


def test_parse_job_end_to_end(spark, bank):
    sources, texts = bank
    kept = TextIndex(spark, scratch_folder(spark, "bank"))
    old = dedup.with_fingerprint(spark.createDataFrame([(10, "tossup", "Troy", "Troy stood where merchants sailed and horses were made of timber")], "question_id long, type string, answer string, body string"))
    kept.append(dedup.question_postings(old), "first")
    quarantine = spark.createDataFrame([(2, "old reason", "x"), (4, "kept reason", "y")], "source_id long, reason string, raw_text string")
    out = parse.parse_pipeline(sources, texts, old, kept, quarantine, min_score=2.0)
    questions = {(r["type"], r["answer"]): r for r in out["questions"].collect()}
    assert set(questions) == {("tossup", "Carthage"), ("tossup", "Athens"), ("tossup", "Sparta"), ("mcq", "Rhine")}
    assert questions["tossup", "Carthage"]["question_id"] == 11 and questions["tossup", "Carthage"]["difficulty"] == "high" and questions["mcq", "Rhine"]["difficulty"] == "elementary"
    assert all(r["tags"] and r["origin"] == "official" for r in questions.values()) and questions["tossup", "Athens"]["alternates"] == ["Old Athens"]
    links = {(r["question_id"], r["source_id"]) for r in out["question_sources"].collect()}
    ids = {a: r["question_id"] for (_, a), r in questions.items()}
    assert links == {(ids["Carthage"], 1), (ids["Carthage"], 2), (ids["Athens"], 1), (ids["Athens"], 2), (ids["Sparta"], 2), (ids["Rhine"], 5)}
    details = {r["source_id"]: (r["status"], r["status_detail"]) for r in out["sources"].collect()}
    assert details[1] == ("parsed", "2 tossups, 0 mcqs, 0 dupes, 0 quarantined") and details[2] == ("parsed", "1 tossups, 0 mcqs, 2 dupes, 1 quarantined")
    assert details[3] == ("parsed", "kind=studyguide, kept as reference") and details[4] == ("fetched", None) and details[5] == ("parsed", "0 tossups, 1 mcqs, 0 dupes, 1 quarantined")
    assert tuple(out["totals"].first()) == (3, 3, 1, 2, 2, 1)
    reasons = sorted((r["source_id"], r["reason"]) for r in out["quarantine"].collect())
    assert [s for s, _ in reasons] == [2, 4, 5] and (4, "kept reason") in reasons and (2, "old reason") not in reasons
    assert {r["tag"] for r in out["source_tags"].collect()} >= {"Empires", "Leaders"}

    # The second run over what is parsed by now does nothing; over the same texts once more it adds nothing and leaves the links as they are.
    both = old.unionByName(out["questions"].select(*old.columns))
    kept.append(dedup.question_postings(out["questions"]), "second")
    idle = parse.parse_pipeline(out["sources"], texts, both, kept, out["quarantine"], out["source_tags"])
    assert tuple(idle["totals"].first()) == (0, 0, 0, 0, 0, 0) and idle["questions"].count() == 0
    assert {r["source_id"]: r["status_detail"] for r in idle["sources"].collect()} == {s: d for s, (_, d) in details.items()}
    again = parse.parse_pipeline(parse.reset_parsed(out["sources"], texts).drop("_reset", "tossups", "mcqs", "duplicates", "quarantined"), texts, both, kept, out["quarantine"], out["source_tags"], min_score=2.0)
    assert again["questions"].count() == 0 and again["totals"].first()["duplicates"] == 6
    assert {(r["question_id"], r["source_id"]) for r in again["question_sources"].collect()} == links
    assert sorted((r["source_id"], r["reason"]) for r in again["quarantine"].collect()) == reasons


def test_repeat_of_a_near_duplicate(spark):
    """A candidate that repeats one which goes as a near duplicate points to what stays."""
    rows = [(i, "tossup", "Rome", b) for i, b in [(1, "seven hills stood above yellow river water there"), (2, "seven hills stood above yellow river banks there"), (3, "seven hills stood above yellow river banks there")]]
    rows += [(i, "tossup", f"other {i}", f"quite different body number{i} with nothing shared{i} anywhere") for i in range(4, 30)]
    new = dedup.with_fingerprint(spark.createDataFrame(rows, "question_id long, type string, answer string, body string"))
    got = {r["question_id"]: r["duplicate_of"] for r in parse.duplicates_of(new, new.limit(0), TextIndex(spark, scratch_folder(spark, "none"))).collect()}
    assert got == {2: 1, 3: 1}


def test_greedy_over_long_chains(spark):
    """A chain of 10,000 is settled at once; rounds before it give the same choice."""
    chain = spark.range(1, 10_000).select(F.col("id").alias("question_id"), (F.col("id") - 1).alias("near"))
    got = dedup.greedy_gone(chain)
    assert got.agg(F.count("question_id"), F.sum(F.col("question_id") % 2), F.sum(F.col("question_id") - F.col("duplicate_of"))).first() == (5000, 5000, 5000)
    rng = random.Random(2)
    edges = sorted({(q, rng.randrange(q)) for q in range(1, 400) for _ in range(2)})
    gone = {}
    for q in range(400):
        kept = [d for e, d in edges if e == q and d not in gone]
        if kept:
            gone[q] = min(kept)
    frame = spark.createDataFrame(edges, "question_id long, near long")
    assert {r["question_id"]: r["duplicate_of"] for r in dedup.greedy_gone(frame, 300).collect()} == gone


def test_copies_are_not_paired(spark):
    """3,000 copies in one block go with the first of them; what is near to them is held against that one."""
    body = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    rows = [(i, "tossup", "X", body, i) for i in range(3000)] + [(5000, "tossup", "the x", body + " more", 5000), (5001, "tossup", "Y", body, 5001)]
    rows += [(9000 + i, "tossup", f"z{i}", f"unrelated{i} text{i} about{i} things{i}", 9000 + i) for i in range(4000)]
    batch = spark.createDataFrame(rows, "question_id long, type string, answer string, body string, position long")
    gone = {r["question_id"]: r["duplicate_of"] for r in dedup.dedup_near(batch, 1.0).where("duplicate_of is not null").collect()}
    assert gone == {i: 0 for i in [*range(1, 3000), 5000]}


def test_near_choice_in_chunks(spark):
    """Chunks of any size give the choice of the plain loop, also where places run against ids; the whole vocabulary counts, asked or not."""
    rng = random.Random(7)
    vocabulary = [f"word{i:03}" for i in range(120)]
    rows = []
    for i in range(260):
        said = rows[rng.randrange(len(rows))][3].split()[:14] if rows and rng.random() < 0.3 else rng.sample(vocabulary, 14)
        rows.append((i, "tossup", f"answer {i % 3}", " ".join([*rng.sample(said, 14), *rng.sample(vocabulary, rng.randrange(30))]), (i * 101) % 260))
    batch = spark.createDataFrame(rows, "question_id long, type string, answer string, body string, position long").cache()
    postings = dedup.build_text_index(batch.select(F.col("question_id").alias("doc_id"), "body", "answer"))
    near = {}
    for r in dedup.bm25_scores(dedup.near_queries(batch), postings).where("score > 14").collect():
        near.setdefault(r["query_id"], set()).add(r["doc_id"])
    at, kind, gone = {r[0]: r[4] for r in rows}, {r[0]: r[2] for r in rows}, {}
    for q in sorted(at, key=at.get):
        kept = [d for d in near.get(q, ()) if at[d] < at[q] and kind[d] == kind[q] and d not in gone]
        if kept:
            gone[q] = min(kept)
    assert 20 < len(gone) < 240
    for chunk in (50, 4096):
        assert {r["question_id"]: r["duplicate_of"] for r in dedup.dedup_near(batch, 14.0, chunk).where("duplicate_of is not null").collect()} == gone


def test_near_pairs_with_kept_questions_only(spark, monkeypatch):
    """900 near copies in one block: the first of them meets the rest, which then meet each other no more."""
    rows = [(i, "tossup", "X", f"alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima end{i}", i) for i in range(900)]
    rows += [(9000 + i, "tossup", f"z{i}", f"unrelated{i} text{i} about{i} things{i}", 9000 + i) for i in range(900)]
    batch = spark.createDataFrame(rows, "question_id long, type string, answer string, body string, position long")
    made, plain = [], dedup._near_pairs
    monkeypatch.setattr(dedup, "_near_pairs", lambda *args: made.append(plain(*args)) or made[-1])
    gone = {r["question_id"]: r["duplicate_of"] for r in dedup.dedup_near(batch, 1.0, 200).where("duplicate_of is not null").collect()}
    assert gone == {i: 0 for i in range(1, 900)}
    assert sum(p.count() for p in made) <= 200 * 199 / 2 + 900


def test_only_what_the_bank_can_hold_is_searched(spark, monkeypatch):
    """A question whose type and answer no question of the bank has is no near duplicate there: it asks for nothing."""
    body = "the quick brown foxes jumped over several sleeping hounds yesterday"
    bank = spark.createDataFrame([(1, "tossup", "A fox", body, "x")], "question_id long, type string, answer string, body string, fingerprint string")
    new = spark.createDataFrame([(2, "tossup", "fox", body, "y"), (3, "mcq", "fox", body, "z"), (4, "tossup", "dog", body, "v")], bank.schema)
    asked = []

    class Seen(TextIndex):
        def search(self, queries, k=5, above=None):
            asked.extend(r["query_id"] for r in queries.collect())
            return super().search(queries, k, above)

    kept = Seen(spark, scratch_folder(spark, "index"))
    kept.append(dedup.question_postings(bank), "bank")
    got = parse.duplicates_of(new, bank, kept, 0.5)
    assert asked == [2] and [tuple(r) for r in got.collect()] == [(2, 1)]


def test_staged_tables_leave_no_shuffles(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
    out = staged(spark.range(1000).groupBy(F.col("id") % 7).count(), "counted")
    assert out.count() == 7 and spark.conf.get(name) == before
