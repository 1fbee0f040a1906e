"""The pipeline, stage by stage, on a small corpus written as the driver's tables are."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quizloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import brute_components, corpus, line_words, near, shingles  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, None if t is None else t, lang, source, len(t or "")) for i, t, lang, source, *_ in corpus()]
    labels = []
    for k in range(200):
        toxic = k % 4 == 0
        words = [f"u{rng.randrange(300)}" for _ in range(25)] + (["vilestword"] if toxic else [])
        rows.append((5000 + k, " ".join(words), "en", "s1", 0))
        labels.append((5000 + k, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    kept, columns = {"": {r["doc_id"]: r["text"] for r in docs.collect()}}, docs.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        counts[name] = docs.count()
    assert set(kept[""]) - set(kept["toxicity"]) == {5000 + k for k in range(0, 200, 4)}
    gone, seen = set(), []
    for i, t in sorted(kept["toxicity"].items()):
        for p, line in enumerate((t or "").split("\n")):
            w = line_words(line)
            if w:
                if any(w == s or (min(len(w), len(s)) >= 8 and near(w, s)) for s in seen):
                    gone.add((i, p))
                seen.append(w)
    left = {}
    for i, t in kept["toxicity"].items():
        lines = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        if lines == t or (lines or "").strip():
            left[i] = lines
    assert kept["line_dedup"] == left
    sets = {i: shingles(t) for i, t in left.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = brute_components(pairs, list(sets))
    assert set(kept["ngram_join"]) == {i for i in sets if root[i] == i}
    assert kept["mixing"] == kept["ngram_join"] and counts["ngram_join"] <= counts["mixing"] <= 2 * counts["ngram_join"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    ends = packed.where("start + length = doc_tokens").groupBy("doc_id").count()
    assert ends.agg(F.sum("count")).first()[0] == counts["mixing"]


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
