"""Duplicate questions: exact by fingerprint, near by shared rare words and equal answers; coverage; the text index behind it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.text import fingerprint, normalize_answer
from quizloom.operators.index import K1, B, blocks, top_k
from quizloom.operators.ranks import ranked
from quizloom.sources.scratch import staged

QUERY_WORDS, LEAST_LETTERS, LEAST_TERMS = 12, 4, 4
#: Characters in which the first QUERY_WORDS words are looked for before the whole text is.
HEAD_CHARS = 400


def with_fingerprint(questions: DataFrame) -> DataFrame:
    """questions(question_id, answer, body) with their fingerprint."""
    return questions.withColumn("fingerprint", fingerprint(F.col("answer"), F.col("body")))


def dedup_exact(questions: DataFrame, order: list[str] = ("source_id", "position")) -> DataFrame:
    """The first of each fingerprint. Combined before the shuffle, so a text copied a million times is one row per task."""
    first = F.min(F.struct(*[F.col(c) for c in order], "question_id"))
    keep = questions.groupBy("fingerprint").agg(first.alias("_f")).select(F.col("_f.question_id").alias("question_id"))
    return questions.join(keep, "question_id", "left_semi")


def dedup_exact_incremental(new: DataFrame, bank: DataFrame, order: list[str] = ("source_id", "position")) -> DataFrame:
    return dedup_exact(new.join(bank.select("fingerprint"), "fingerprint", "left_anti"), order)


def question_body(clues: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, body): a tossup's clues in order, or the stem."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    bodies = clues.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), " ").alias("_c"))
    return questions.join(bodies, "question_id", "left").withColumn("body", F.coalesce("_c", "stem")).drop("_c")


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda t: t != "")


def build_text_index(documents: DataFrame, keep: list[str] = (), marked: bool = False) -> DataFrame:
    """(doc_id, term, tf, length) of documents(doc_id, body[, answer]), and the columns to ``keep``.

    Words are counted where the document is: sorted, equal ones stand together, and the places where they begin tell how often each
    is there. So nothing is shuffled. Ids are expected once; a repeated one gives its rows each time. With ``marked`` a row of no
    word (term empty, tf 0) stands for each document, so that a part of the index still tells how many there are and how long.
    """
    text = F.concat_ws(" ", "body", "answer") if "answer" in documents.columns else F.col("body")
    words = documents.select("doc_id", *keep, F.sort_array(tokens(text)).alias("_t")).withColumn("length", F.size("_t")).where("length > 0")
    places = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", F.greatest(i - 1, F.lit(0)))))
    words = words.withColumn("_at", places)
    found = F.transform("_at", lambda i, k: F.struct(F.get("_t", i).alias("term"), (F.coalesce(F.get("_at", k + 1), F.col("length")) - i).cast("long").alias("tf")))
    if marked:
        found = F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"))), found)
    return words.select("doc_id", *keep, "length", F.inline(found)).select("doc_id", "term", "tf", "length", *keep)


def index_parity(documents: DataFrame, index: DataFrame) -> DataFrame:
    """How many documents there are and how many the index holds; they agree if the index is whole."""
    return documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(index.agg(F.countDistinct("doc_id").alias("indexed")))


def query_terms(body: Column) -> Column:
    """Distinct longer words among the first of a text. The text's head has them unless it holds no more words than that: only its last can be cut."""
    head = tokens(F.substring(body, 1, HEAD_CHARS))
    words = F.when(F.size(head) > QUERY_WORDS, head).otherwise(tokens(body))
    return F.array_distinct(F.filter(F.slice(words, 1, QUERY_WORDS), lambda t: F.length(t) >= LEAST_LETTERS))


def _asked(queries: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, float]:
    """The words of queries(query_id, terms) with their idf over the whole index, and its mean length."""
    n, mean = index.select("doc_id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))  # a document has one row a word
    return queries.select("query_id", *keys, F.explode("terms").alias("term")).join(df, "term").withColumn("_idf", _idf(n)).drop("_df"), float(mean or 1.0)


def _idf(documents: int) -> Column:
    return F.log(1 + (F.lit(documents) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))


def _summed(hits: DataFrame, mean: float, *keys: str) -> DataFrame:
    part = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return hits.groupBy("query_id", "doc_id", *keys).agg(F.round(F.sum(part), 6).alias("score"))


def bm25_scores(queries: DataFrame, index: DataFrame, keys: list[str] = (), above: float | None = None, without: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of queries(query_id, terms) for all documents that share a term, and the ``keys`` if given.

    With ``above`` only the scores beyond it, all of them: a word adds less than its idf times K1 + 1, so the commonest words of a
    query that together cannot pass ``above`` bring no document in; documents meet a query by the others only, and are then scored
    on all words. Documents of ``without`` (doc_id) are not met; words and lengths count over all. The joins are plain equi-joins, which Spark splits where a word is hot.
    """
    asked, mean = _asked(queries, index, list(keys))
    met_index = index if without is None else index.join(without, "doc_id", "left_anti")
    if above is None:
        return _summed(asked.join(met_index, [*keys, "term"]), mean)
    telling = _with_most(asked).where(F.col("_most") > above - _SLACK)
    met = staged(telling.join(met_index, [*keys, "term"]).select("query_id", "doc_id").distinct(), "met")
    # Of the index only documents that are met go on; their list is a table of known size, so Spark sees whether to send it or to shuffle.
    words = met_index.drop(*keys).join(staged(met.select("doc_id").distinct(), "met-documents"), "doc_id", "left_semi")
    return _summed(met.join(asked.drop(*keys), "query_id").join(words, ["doc_id", "term"]), mean).where(F.col("score") > above)


_SLACK = 1e-6  # scores are rounded to six places


def _with_most(asked: DataFrame) -> DataFrame:
    """``asked`` with _most: what a word and all commoner ones of its query can add at most."""
    commonest = Window.partitionBy("query_id").orderBy("_idf", "term").rowsBetween(Window.unboundedPreceding, 0)
    return asked.withColumn("_most", F.sum(F.col("_idf") * (K1 + 1)).over(commonest))


def search_bm25(queries: DataFrame, index: DataFrame, k: int = 5, above: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, by score and then id; with ``above``, those of them that score more.

    Exact, but not by scoring all pairs that share a word: see index.top_k().
    """
    n, mean = index.select("doc_id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    mean = float(mean or 1.0)
    return top_k(queries, staged(blocks(index, n, mean), "blocks"), n, mean, mean, k, above)


def near_queries(questions: DataFrame) -> DataFrame:
    """(query_id, terms) of questions with enough query terms."""
    return questions.select(F.col("question_id").alias("query_id"), query_terms(F.col("body")).alias("terms")).where(F.size("terms") >= LEAST_TERMS)


def same_question(hits: DataFrame, new: DataFrame, bank: DataFrame) -> DataFrame:
    """(question_id, duplicate_of): the best of a question's hits (query_id, doc_id, rank) with equal answer and type."""
    own = new.select(F.col("question_id").alias("query_id"), F.col("type").alias("_t"), normalize_answer(F.col("answer")).alias("_a"))
    theirs = bank.select(F.col("question_id").alias("doc_id"), F.col("type").alias("_bt"), normalize_answer(F.col("answer")).alias("_ba"))
    same = hits.join(own, "query_id").join(theirs, "doc_id").where("_t = _bt and _a = _ba")
    return same.groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("duplicate_of")).withColumnRenamed("query_id", "question_id")


def find_near_duplicates(new: DataFrame, bank: DataFrame, min_score: float = 8.0, k: int = 5) -> DataFrame:
    """(question_id, duplicate_of): the best of a new question's k best matches in the bank with equal answer and type, if it scores enough.

    Both: (question_id, type, answer, body). Questions with fewer than LEAST_TERMS query terms have no near duplicate. The bank is
    indexed here; a bank that stays is better kept in a TextIndex, as parse_pipeline() has it.
    """
    index = question_postings(bank)
    return same_question(search_bm25(near_queries(new), index, k, min_score), new, bank)


def question_postings(questions: DataFrame) -> DataFrame:
    return build_text_index(questions.select(F.col("question_id").alias("doc_id"), "body", "answer"))


#: Edges that one task settles; more are first thinned in rounds.
SETTLED_AT_ONCE = 200_000


def _settle(edges: pd.DataFrame) -> pd.DataFrame:
    """Who goes, by the plain loop in order; edges(question_id, near, _at): near stands before question_id, whose place is _at."""
    before: dict = {}
    for q, n, at in zip(edges["question_id"], edges["near"], edges["_at"], strict=True):
        before.setdefault((at, q), []).append(n)
    gone: set = set()
    for (_, q), nears in sorted(before.items()):
        if any(n not in gone for n in nears):
            gone.add(q)
    return pd.DataFrame({"question_id": pd.Series(list(gone), dtype=edges["question_id"].dtype)})


def greedy_gone(edges: DataFrame, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """(question_id, duplicate_of) of edges(question_id, near[, _at]), near standing before question_id, whose place in the order is _at (or its id): who goes if each is held against the kept ones before it.

    Many edges are thinned in rounds, each written to the shared folder: who has no earlier neighbour left stays, and the neighbours behind
    it go with their edges; in an order that has nothing to do with the edges few rounds do. Once ``at_once`` edges are left at most,
    one task settles them in order, however long their chains. duplicate_of is the smallest kept neighbour.
    """
    edges = left = staged(edges if "_at" in edges.columns else edges.withColumn("_at", F.col("question_id")), "near")
    kind = edges.schema["question_id"].dataType.simpleString()
    gone = []
    while (n := left.count()) > at_once:
        stays = left.select(F.col("near")).distinct().join(left.select(F.col("question_id").alias("near")).distinct(), "near", "left_anti")
        goes = staged(left.join(stays, "near", "left_semi").select("question_id").distinct(), "gone")
        gone.append(goes)
        left = staged(left.join(goes, "question_id", "left_anti").join(goes.toDF("near"), "near", "left_anti"), "left")
    if n:
        gone.append(staged(left.groupBy().applyInPandas(_settle, f"question_id {kind}"), "gone"))
    for goes in gone:
        edges = edges.join(goes.toDF("near"), "near", "left_anti")
    return edges.groupBy("question_id").agg(F.min("near").alias("duplicate_of"))


#: So many questions, first in the order, are settled among themselves before the others meet those of them that stay; then twice as many each time.
FIRST_CHUNK = 4096


def _near_pairs(asked: DataFrame, askers: DataFrame, held: DataFrame, mean: float, above: float) -> DataFrame:
    """(query_id, doc_id, _q) of askers(query_id, _q) for the documents of held(doc_id, _d, _block, term, tf, length) that stand before them and score more than ``above``.

    As in bm25_scores(), documents are met by a query's telling words within its block, then scored on all of its words.
    """
    mine = asked.join(askers, "query_id")
    met = mine.where(F.col("_most") > above - _SLACK).join(held, ["_block", "term"]).where("_d < _q").select("query_id", "_q", "doc_id").distinct()
    hits = met.join(asked.drop("_block", "_most"), "query_id").join(held.drop("_block", "_d"), ["doc_id", "term"])
    return _summed(hits, mean, "_q").where(F.col("score") > above).drop("score")


def _settle_in_chunks(order: DataFrame, asked: DataFrame, postings: DataFrame, mean: float, above: float, chunk: int) -> DataFrame:
    """(question_id, duplicate_of) of those of order(question_id, _rank) that go if each is held against the kept ones before it.

    The first ``chunk`` of them are settled among themselves; those that go are held against no one any more, and the rest is held against
    those that stay. What is near to one of them goes and is in no later pair, so pairs are made with kept questions only. Then
    the first of what is left, twice as many, and so on. duplicate_of is the smallest kept neighbour: one that went is held
    against later chunks too if they keep an id smaller than its neighbour's, which an order by ids never has.
    """
    left, found, behind = order, [], []
    while n := left.count():
        last = n <= 2 * chunk
        cut = left.agg(F.max("_rank") if last else F.percentile_approx("_rank", chunk / n, 10_000)).first()[0]
        first = left.where(F.col("_rank") <= cut)
        held = staged(postings.join(first.select(F.col("question_id").alias("doc_id"), F.col("_rank").alias("_d")), "doc_id"), "near-held")
        pairs = _near_pairs(asked, first.toDF("query_id", "_q"), held, mean, above)
        goes = staged(greedy_gone(pairs.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("near"), F.col("_q").alias("_at"))), "near-gone")
        found.append(goes)
        if last:
            break
        kept = staged(first.join(goes, "question_id", "left_anti").select(F.col("question_id").alias("doc_id")), "near-kept")
        least, rest = kept.agg(F.min("doc_id")).first()[0], left.where(F.col("_rank") > cut)
        askers = rest
        for went in behind:
            askers = askers.unionByName(order.join(went.where(F.col("duplicate_of") > F.lit(least)), "question_id", "left_semi"))
        pairs = _near_pairs(asked, askers.distinct().toDF("query_id", "_q"), held.join(kept, "doc_id", "left_semi"), mean, above)
        behind.append(staged(pairs.groupBy(F.col("query_id").alias("question_id")).agg(F.min("doc_id").alias("duplicate_of")), "near-behind"))
        left, chunk = staged(rest.join(behind[-1], "question_id", "left_anti"), "near-left"), 2 * chunk
    gone = order.sparkSession.createDataFrame([], order.select("question_id", F.col("question_id").alias("duplicate_of")).schema)
    for went in [*found, *behind]:
        gone = gone.unionByName(went)
    return gone.groupBy("question_id").agg(F.min("duplicate_of").alias("duplicate_of"))


def dedup_near(batch: DataFrame, min_score: float = 8.0, chunk: int = FIRST_CHUNK) -> DataFrame:
    """batch(question_id, type, answer, body, position) with duplicate_of: in order of position, each is held against the kept ones before it.

    Duplicates share type and answer, so words are joined within such a block only. An id that occurs more than once stands at its
    first place. Copies (equal block, body and answer) whose score against themselves is enough go with the first of them, which alone is
    held against others: a later copy has the neighbours of the first, and the first besides, so it never stays. Of the index only words
    that a question asks for are kept, under numbers, and pairs are made with kept questions only (_settle_in_chunks), as rows, so
    that no block need fit into one task.
    """
    keyed = batch.withColumn("_block", F.concat_ws("|", "type", normalize_answer(F.col("answer"))))
    queries = keyed.select(F.col("question_id").alias("query_id"), "_block", query_terms(F.col("body")).alias("terms")).where(F.size("terms") >= LEAST_TERMS)
    queries = staged(queries.select("query_id", "_block", F.explode("terms").alias("_w")), "near-queries")
    none = batch.sparkSession.createDataFrame([("",)], "_w string")
    words = staged(queries.select("_w").distinct().unionByName(none).withColumn("_no", F.monotonically_increasing_id()), "near-words")
    index = build_text_index(keyed.select(F.col("question_id").alias("doc_id"), "body", "answer", "_block"), ["_block"], marked=True)
    index = staged(index.join(words, F.col("term") == F.col("_w")).select("doc_id", F.col("_no").alias("term"), "tf", "length", "_block"), "near-index")
    postings = index.where("tf > 0")
    n, mean = index.where("tf = 0").select("doc_id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    mean = float(mean or 1.0)
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    named = queries.join(words, "_w").select("query_id", "_block", F.col("_no").alias("term"))
    asked = staged(_with_most(named.join(df, "term").withColumn("_idf", _idf(n)).drop("_df")), "near-asked")

    place = keyed.groupBy("question_id").agg(F.min(F.struct("position", "question_id")).alias("_p"))
    text = F.sha2(F.concat_ws("\u0000", "_block", "answer", "body"), 256)
    classes = staged(keyed.select("question_id", text.alias("_class")).join(place, "question_id"), "near-classes")
    first = classes.groupBy("_class").agg(F.min("_p").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    heads = staged(first.select(F.col("_first.question_id").alias("query_id"), "_class"), "near-heads")
    theirs = postings.drop("_block").join(heads.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").withColumn("query_id", F.col("doc_id"))
    own = _summed(asked.join(heads, "query_id", "left_semi").join(theirs, ["query_id", "term"]), mean).where(F.col("score") > min_score)
    followers = classes.join(heads.join(own.select("query_id"), "query_id", "left_semi"), "_class").where("question_id != query_id").select("question_id", F.col("query_id").alias("_head")).distinct()
    followers = staged(followers, "near-copies")

    order = ranked(classes.select("question_id", "_p").distinct().join(followers, "question_id", "left_anti"), ["_p"], "_rank")
    gone = staged(_settle_in_chunks(staged(order.select("question_id", "_rank"), "near-order"), asked, postings, mean, min_score, chunk), "near-gone")
    copies = followers.join(gone.select(F.col("question_id").alias("_head"), "duplicate_of"), "_head", "left").select("question_id", F.coalesce("duplicate_of", "_head").alias("duplicate_of"))
    return batch.join(gone.unionByName(copies), "question_id", "left")


def coverage(kept: DataFrame, near: DataFrame, exact: DataFrame) -> DataFrame:
    """(question_id, source_id): each source in which a question appears, itself or as an exact or near duplicate; pairs once, nulls none."""
    pairs = kept.select("question_id", "source_id").union(near.select("question_id", "source_id")).union(exact.select("question_id", "source_id"))
    return pairs.dropna().dropDuplicates()


def parse_counts(outcomes: DataFrame) -> DataFrame:
    """outcomes(source_id, outcome) with outcome tossup, mcq, duplicate or quarantined: numbers per source, and in all (null)."""
    n = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.rollup("source_id").agg(n("tossup").alias("tossups"), n("mcq").alias("mcqs"), n("duplicate").alias("duplicates"), n("quarantined").alias("quarantined"))
