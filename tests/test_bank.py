"""Raw documents, snapshots and the status ladder."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quizloom.operators import library, tagging
from quizloom.sources import bank


def full_bank(spark):
    tables = {n: spark.createDataFrame([], s) for n, s in bank.SCHEMAS.items()}
    tables["users"] = spark.createDataFrame([(1, "Ann")], bank.SCHEMAS["users"])
    tables["source_texts"] = spark.createDataFrame([(1, "text", 4)], bank.SCHEMAS["source_texts"])
    tables["inbox"] = spark.createDataFrame([(1,)], "inbox_id long")
    return tables


def test_raw_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"%PDF-1.4 x")
    r = bank.read_raw_documents(spark, str(tmp_path)).first()
    assert (r["sha256"], r["bytes"]) == (hashlib.sha256(b"%PDF-1.4 x").hexdigest(), 10)


def test_snapshot(spark, tmp_path):
    tables = full_bank(spark)
    whole = bank.publish_snapshot(tables, f"{tmp_path}/all")
    assert whole["users"] == 1 and "inbox" not in whole and "source_texts" in whole
    bare = bank.publish_snapshot(tables, f"{tmp_path}/bare", accounts=False, texts=False)
    assert not {"users", "sessions", "attempts", "review_queue", "source_texts", "quarantine", "inbox"} & set(bare)
    assert bank.install_snapshot(spark, f"{tmp_path}/all", f"{tmp_path}/new") == whole
    held = bank.read_bank(spark, f"{tmp_path}/new")
    assert held["users"].first()["name"] == "Ann" and held["questions"].count() == 0
    with pytest.raises(Exception, match="already exists"):
        bank.install_snapshot(spark, f"{tmp_path}/all", f"{tmp_path}/new")


def test_transitions(spark):
    cases = [("pending", "fetched", True), ("fetched", "parsed", False), ("parsed", "extracted", True), ("extracted", "error", True), ("error", "parsed", False)]
    df = spark.createDataFrame(cases, "old string, new string, ok boolean")
    assert df.where(library.valid_transition(F.col("old"), F.col("new")) != F.col("ok")).count() == 0


def test_search_is_literal(spark):
    rows = [(1, "https://x.org/a%20b", "h", "packet", "extracted", "100% sure_thing"), (2, "https://x.org/ab", "h", "packet", "extracted", None)]
    s = spark.createDataFrame(rows, "source_id long, url string, host string, kind string, status string, title string")
    qs, q = spark.createDataFrame([], "question_id long, source_id long"), spark.createDataFrame([], "question_id long, source_id long")
    for text, found in (("%", [1]), ("_", [1]), ("SURE", [1]), ("x.org", [1, 2]), ("a.b", [])):
        assert sorted(r["source_id"] for r in library.list_sources(s, qs, q, search=text, page=9).collect()) == found


def test_set_tags_replaces(spark):
    old = spark.createDataFrame([(1, "Empires"), (2, "Wars")], "question_id long, tag string")
    vocabulary = spark.createDataFrame([("Empires", "topic"), ("Wars", "topic")], "tag string, kind string")
    tags, all_ = tagging.set_tags(old, vocabulary, spark.createDataFrame([(1, " wars "), (1, "WARS"), (1, "New Thing"), (1, "")], "question_id long, tag string"))
    assert sorted(map(tuple, tags.collect())) == [(1, "New Thing"), (1, "Wars"), (2, "Wars")] and all_.count() == 3
