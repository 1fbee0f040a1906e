"""Each operator against brute force on small tables, and with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quizloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quizloom.llm import _shared, exact_dedup, language_id, line_dedup, linear, mixing, ngram_join, packing, quality, queries, token_count, toxicity, vector_dedup  # noqa: E402
from quizloom.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, _text string, size long"
VOCABULARY = [f"w{i}" for i in range(40)]


def prose(rng, n, words=VOCABULARY):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1):
    """Odd texts, copies, near copies and a hot text; columns whose names clash with inner ones."""
    rng = random.Random(seed)
    texts = [None, "", " ", "\n", "a", "a b", "A B", "…", "x" * 30_000, prose(rng, 4000), "tab\tand\x0bmore\r\nlines", "<|endoftext|> it's don't 3x Ünï", "é é ① Σς"]
    texts += ["hot text that many rows repeat word for word " * 2] * 150
    for _ in range(12):
        base = [prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            i = rng.randrange(len(near))
            w = near[i].split()
            at = rng.randrange(len(w))
            edit = rng.choice(["swap", "drop", "add"])
            if edit == "swap":
                w[at] = "changed"
            elif edit == "drop":
                del w[at]
            else:
                w.insert(at, "added")
            near[i] = " ".join(w)
            texts.append("\n".join(near))
    rows = [(i * 3 + 5, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 9 else None, "clash", 1) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 8 ----------------------------------------------------------------------------------------------------------------------


def test_exact(spark, docs, rows, none):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    got = by_id(exact_dedup.exact_duplicates(docs))
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    small = by_id(exact_dedup.exact_duplicates(docs, keep="smallest", hot_part=0.9))
    assert all(small[i]["keep_id"] == min(ids) for ids in groups.values() for i in ids)
    assert exact_dedup.exact_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "t"), (1, "t"), (1, "t"), (None, "u")], "doc_id long, text string")
    out = exact_dedup.exact_duplicates(odd).collect()
    assert sum(r["kept"] for r in out) == 2 and {r["group_size"] for r in out} == {3, 1}
    folded = by_id(exact_dedup.exact_duplicates(docs, normalise=F.lower))
    assert folded[rows[5][0]]["keep_id"] == rows[6][0]


# 3 ----------------------------------------------------------------------------------------------------------------------


def line_words(line):
    return tuple(re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def near(x, y):
    """Word edit distance of at most one, by definition."""
    if x == y:
        return True
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def test_lines(spark, docs, rows, none):
    seen, gone = [], set()
    for i, t, *_ in sorted(rows):
        for p, line in enumerate((t or "").split("\n")):
            w = line_words(line)
            if w:
                if any(w == s or (min(len(w), len(s)) >= line_dedup.LEAST_WORDS and near(w, s)) for s in seen):
                    gone.add((i, p))
                seen.append(w)
    got = {(r["doc"], r["place"]) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == gone and len(gone) > 20
    out = by_id(line_dedup.dedup_lines(docs))
    for i, t, *_ in rows:
        want = None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in gone)
        assert out[i]["text"] == want and out[i]["_text"] == "clash"
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.within_one_edit("a B c", "a b  d") and not line_dedup.within_one_edit("a b c", "b c d")


def test_lines_of_long_texts_and_clashing_columns(spark, monkeypatch):
    """Texts cut into blocks give the same lines; columns with inner names stay; a chain of edits leaves its first line."""
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 64)
    rng = random.Random(3)
    lines = [prose(rng, rng.randint(0, 12)) for _ in range(40)]
    texts = ["\n".join(rng.choice(lines) for _ in range(60)) + rng.choice(["", "\n"]) for _ in range(6)]
    seen, gone = set(), set()
    for i, t in enumerate(texts):
        for p, line in enumerate(t.split("\n")):
            w = line_words(line)
            if w and w in seen:
                gone.add((i, p))
            seen.add(w)
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    got = [(int(r), int(p), int(e - s)) for _, row, place, s_, e_, *_ in line_dedup._lines(np.frombuffer(b"".join(data), np.uint8), offsets) for r, p, s, e in zip(row, place, s_, e_, strict=True) if e > s]
    assert sorted(got) == sorted((i, p, len(line_words(x))) for i, t in enumerate(texts) for p, x in enumerate(t.split("\n")) if line_words(x))
    names = ["doc", "_places", "_row", "_doc", "_gone", "place", "check"]
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = by_id(line_dedup.dedup_lines(df, least_words=50))
    for i, t in enumerate(texts):
        assert out[i]["text"] == "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert all(out[i][n] == n for n in names if n != "_gone") and out[i]["_gone"] == sum(d == i for d, _ in gone)
    words_ = [f"v{k}" for k in range(10)]
    chain = [" ".join([f"x{k}" for k in range(step)] + words_[step:]) for step in range(5)]
    assert [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")).orderBy("doc_id").collect()] == [chain[0], "", "", "", ""]


def test_second_hash_of_lines():
    raw = b"A b  ab\tc\na B ab C"
    data = np.frombuffer(raw, np.uint8)
    start, end = _shared.spans(~_shared.spaces(data), np.array([0]))
    check = _shared.PrimeSums(data, start, end)
    run = check.run(np.array([0, 4, 0, 1, 4]), np.array([4, 8, 3, 4, 7]))
    assert run[0] == run[1] and run[2] == run[4] and len(set(run.tolist())) == 3


def test_query_takes_short_lines(spark, tmp_path):
    """op3: every exact repeat of a line that is not blank goes, short ones too; one word apart, only of LEAST_WORDS words or more."""
    long = "one two three four five six seven eight"
    texts = ["MIT license.\n\nx\n漢字の行", f"mit  License.\n\ny\n漢字の行\n{long}", f"MIT licence.\n\nX\n{long} nine\n漢字の行二", "one two three four five six seven", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, gone = [], collections.Counter()
    for i, t in rows:
        for w in filter(None, map(line_words, (t or "").split("\n"))):
            gone[i] += any(w == s or (min(len(w), len(s)) >= line_dedup.LEAST_WORDS and near(w, s)) for s in seen)
            seen.append(w)
    out = by_id(queries.op3_line_dedup(spark, str(tmp_path)))
    assert {i: out[i]["n_gone"] for i, _ in rows} == {i: gone[i] for i, _ in rows} == {0: 0, 1: 2, 2: 2, 3: 0, 4: 0}
    assert out[1]["text_sha256"] == hashlib.sha256(f"\ny\n{long}".encode()).hexdigest()


# 9 ----------------------------------------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = line_words(text or "")
    return {w[i : i + n] for i in range(len(w) - n + 1)} if len(w) >= n else ({w} if w else set())


def brute_components(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard(spark, docs, rows, none):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = brute_components(pairs, ids)
    got = by_id(ngram_join.ngram_jaccard_join(docs))
    assert {i: got[i]["n_shingles"] for i in ids} == {i: len(sets[i]) for i in ids}
    assert {i: got[i]["component_id"] for i in ids} == want
    assert ngram_join.ngram_jaccard_join(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    out = ngram_join.ngram_jaccard_join(odd).collect()
    assert len(out) == 4 and {(r["doc_id"], r["component_id"]) for r in out} == {(None, None), (2, 2), (9, 2)}


def test_long_runs_use_trees(spark):
    """More near copies than a short run holds: pivots, then trees, lose no link."""
    rng = random.Random(5)
    base = prose(rng, 60, [f"v{i}" for i in range(500)]).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = by_id(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: got[i]["component_id"] for i in sets} == brute_components(pairs, list(sets))


def test_ids_with_several_texts(spark):
    """A class is told by its set: identical documents stay linked whatever other texts share their smallest id."""
    rng = random.Random(11)
    bases = [prose(rng, 30, [f"v{i}" for i in range(300)]) for _ in range(12)]
    rows = [(5, bases[0]), (9, bases[0]), (5, bases[1]), (12, bases[1]), (13, bases[1])]
    for _ in range(200):
        w = rng.choice(bases).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((rng.randint(20, 60), " ".join(w)))
    sets = [frozenset(shingles(t)) for _, t in rows]
    distinct = sorted(set(sets), key=sorted)
    number = {s: k for k, s in enumerate(distinct)}
    linked = brute_components([(a, b) for a in range(len(distinct)) for b in range(a) if 100 * len(distinct[a] & distinct[b]) >= 75 * len(distinct[a] | distinct[b])], range(len(distinct)))
    least, class_least = {}, {}
    for (i, _), s in zip(rows, sets, strict=True):
        least[linked[number[s]]] = min(i, least.get(linked[number[s]], i))
        class_least[s] = min(i, class_least.get(s, i))
    want = collections.Counter((i, len(s), class_least[s], least[linked[number[s]]]) for (i, _), s in zip(rows, sets, strict=True))
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["class_id"], r["component_id"]) for r in out) == want
    with pytest.raises(TypeError):
        ngram_join.ngram_jaccard_join(spark.createDataFrame([(1.5, "a")], "doc_id double, text string"))


@pytest.mark.parametrize("block_rows", [512, 16])
def test_all_links_of_long_runs(spark, tmp_path, monkeypatch, block_rows):
    """op9: n_links counts every link, also between texts of one component that meet in long runs only."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    rng = random.Random(8)
    rows = []
    for g in range(2):
        base = prose(rng, 70, [f"v{i}" for i in range(500)]).split()
        for i in range(80):
            w = base[: rng.randint(45, 70)]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((g * 1000 + i, " ".join(w)))
    rows += [(3000, rows[3][1]), (3001, "alone in the whole of this corpus"), (3002, ""), (3003, None), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    distinct = set(sets.values()) - {frozenset()}
    want = {i: sum(x != y and 100 * len(x & y) >= 75 * len(x | y) for y in distinct) if x else 0 for i, x in sets.items()}
    got = queries.op9_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and max(want.values()) > 24
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_signature_tree():
    """No pair at the threshold is apart in the groups, and the traversal visits a small part of the pairs of nodes."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(1, 2**63, rng.integers(60, 120)).astype(np.uint64)) for _ in range(400)]
    shared = np.arange(1, 30, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.union1d(s, shared) for s in sets]
    for k in range(60):
        sets.append(np.union1d(sets[k][2:], rng.integers(1, 2**63, 3).astype(np.uint64)))
    sets += [np.unique(rng.integers(1, 2**63, n).astype(np.uint64)) for n in (1500, 3000, 5, 1)]
    sets += [sets[-4][20:], sets[-3][100:], sets[-1]]
    maps, size = [ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    label = ngram_join.run_groups(size, maps, 75)
    want = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert len(want) >= 62 and all(label[a] == label[b] for a, b in want)
    assert len(np.unique(label)) > len(sets) - 80
    small = [np.unique(rng.integers(1, 2**63, 36).astype(np.uint64)) for _ in range(600)]
    tree = ngram_join.SignatureTree(np.array([len(s) for s in small]), np.stack([ngram_join.bitmap(s) for s in small]))
    assert len(np.unique(tree.groups(75).label)) == 600 and tree.visited < 600**2 / 2 / 4


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == brute_components([p for p in pairs if p[0] != p[1]], ids)


# 2 ----------------------------------------------------------------------------------------------------------------------


def brute_mix(rows, exponent, budget, block_docs, seed):
    """Copies of each document by the definition, for a given exponent."""

    def draw(*parts):
        return int(hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:15], 16)

    tokens = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows}
    sources = collections.defaultdict(list)
    for i, _, _, s, *_ in rows:
        sources[s].append(i)
    total = sum(tokens.values())
    share = {s: sum(tokens[i] for i in ids) / total for s, ids in sources.items()}
    z = sum(p**exponent for p in share.values() if p)
    out = {}
    for s, ids in sources.items():
        own = sum(tokens[i] for i in ids)
        if not own:
            out |= dict.fromkeys(ids, 1)
            continue
        epochs, rest = divmod(int(share[s] ** exponent / z * budget + 1e-6), own)
        n = -(-len(ids) // block_docs)
        place = {i: draw(seed, "block", i) % n for i in ids}
        order = sorted(ids, key=lambda i: (draw(seed, "order", s or "", place[i], epochs), place[i], draw(seed, "doc", i, epochs), i))
        used, full = 0, True
        for k, i in enumerate(order):
            used += tokens[i]
            full = full and used <= rest
            # A document without tokens is drawn if it stands where the budget has not ended.
            out[i] = epochs + (full and rest > 0)
        del k
    return out


@pytest.mark.parametrize("block_docs", [4, 256])
def test_mixing(spark, docs, rows, none, block_docs):
    total = sum(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, *_ in rows)
    for budget in (total, 2.5 * total):
        mixed = mixing.mix_sources(docs, budget=budget, block_docs=block_docs, seed=3)  # exponent 1: shares as they are
        got = collections.Counter(r["doc_id"] for r in mixed.collect())
        want = brute_mix(rows, 1.0, budget, block_docs, 3)
        assert {i: n for i, n in want.items() if n} == dict(got)
    assert mixing.mix_sources(none, max_repetition=2.0, cover=True).count() == 0


def test_mixing_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), "en", "big" if i % 10 else f"s{i % 3}", "", 0) for i in range(600)]
    docs = frame(spark, rows)
    out = mixing.mix_sources(docs, target_entropy=0.8).groupBy("source").agg(F.sum("_tokens").alias("t")).collect()
    p = np.array([r["t"] for r in out]) / sum(r["t"] for r in out)
    assert abs(-(p * np.log(p)).sum() / np.log(4) - 0.8) < 0.02
    cover = mixing.mix_sources(docs, max_repetition=2.0, cover=True).groupBy("doc_id").count().agg(F.min("count"), F.max("count"), F.count("doc_id")).first()
    assert cover[0] == 1 and cover[1] == 2 and cover[2] == 600
    a = mixing.mix_sources(docs, target_entropy=0.8).select("doc_id", "_epoch").collect()
    b = mixing.mix_sources(docs.repartition(2), target_entropy=0.8).select("doc_id", "_epoch").collect()
    assert sorted(a) == sorted(b)


def test_mixing_permutations(spark):
    """Each epoch reads each document once, blocks whole, in an order of its own; inner column names are no trouble."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), "big" if i % 10 else f"s{i % 3}", "x", "y") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _epoch string, weight string")
    out = mixing.mix_sources(df, target_entropy=0.99, block_docs=16).collect()
    assert all(r["weight"] == "y" for r in out) and {type(r["_epoch"]) for r in out} == {int}
    source = {i: s for i, _, s, *_ in rows}
    orders = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (source[r["doc_id"]], r["_epoch"], r["_order"], r["_block"], r["_place"], r["doc_id"])):
        orders[source[r["doc_id"]], r["_epoch"]].append((r["_block"], r["doc_id"]))
    own = collections.Counter(source.values())
    small = [k for k in orders if k[0] != "big"]
    assert max(e for _, e in small) >= 2
    for (s, e), docs_ in orders.items():
        assert len(set(docs_)) == len(docs_) <= own[s]
        blocks = [b for b, _ in docs_]
        assert sum(x != y for x, y in zip(blocks, blocks[1:], strict=False)) == len(set(blocks)) - 1
        if (s, e + 1) in orders:
            assert len(docs_) == own[s] and docs_[: len(orders[s, e + 1])] != orders[s, e + 1]


# 4 and 5 ----------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, group_docs=40).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= sizes[i]
            want[i] = b
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_token_counts(spark, docs, rows, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_count.token_counts(docs, path))
    for i, t, *_ in rows:
        assert got[i]["n_tokens"] == len(sp.encode(t or "")) and got[i]["n_bytes"] == len((t or "").encode())
    assert token_count.token_counts(none, path).count() == 0
    odd = ["a  b   c ", " lead", "\n\nx", "x\n y", "<s> </s> <unk>", "　 é é", "123 4,5", "a\x00b\tc", "▁under ▁▁ x", "日本語 テキスト", "▁ ", " ▁", "a▁ b ▁\n▁ c"]
    rng = random.Random(17)
    odd += ["".join(rng.choice(["▁", " ", "\n", "a", "the", "é", ".", "▁▁", "  ", "ing", "\t", "１"]) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    frame_ = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(frame_, path).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(odd)}


# 1, 7 and 10 ------------------------------------------------------------------------------------------------------------


def two_languages(spark, n=400):
    rng = random.Random(8)
    words = {"aa": ["kato", "mira", "telu", "sora"], "bb": ["zwerg", "schlau", "brumm", "knack"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, prose(rng, 6, words[lang]), lang if i % 5 else None))
    return spark.createDataFrame([*rows, (n, None, "aa"), (n + 1, " 12 !", "bb"), (None, "kato mira", None)], "doc_id long, text string, lang string")


def test_language(spark, none):
    got = language_id.language_id(two_languages(spark)).collect()
    known = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 400}
    assert all(r["lang_pred"] == ("aa", "bb")[i % 2] and 0 <= r["score"] <= 1 for i, r in known.items())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in known.items())
    rest = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is None or r["doc_id"] >= 400}
    assert rest == {400: "und", 401: "und", None: "aa"}
    assert language_id.language_id(none).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(two_languages(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_by_definition(spark):
    """Escape by escape, byte by byte, for two texts of known counts."""
    texts = [("aa", "abracadabra"), ("bb", "banana")]
    trees = language_id.train_context_trees(spark.createDataFrame(texts, "lang string, text string"))
    counts = {}
    for lang, t in texts:
        c = collections.defaultdict(collections.Counter)
        padded = b"\n\n\n" + t.encode()
        for p in range(3, len(padded)):
            for k in range(4):
                c[padded[p - k : p]][padded[p]] += 1
        counts[lang] = c

    def bits(lang, text):
        total, padded = 0.0, b"\n\n\n" + text
        for p in range(3, len(padded)):
            for k in (3, 2, 1, 0):
                seen = counts[lang].get(padded[p - k : p])
                if seen:
                    n, q = sum(seen.values()), len(seen)
                    if padded[p] in seen:
                        total -= np.log2(seen[padded[p]] / (n + q))
                        break
                    total -= np.log2(q / (n + q))
            else:
                total += 8
        return total

    for text in (b"abra", b"bandana", b"", b"xyz!\xff", "é".encode()):
        data = np.frombuffer(text, np.uint8)
        got = language_id.code_lengths(trees, data, np.array([0, len(data)]))[0] / language_id.UNIT
        assert np.allclose(got, [bits("aa", text), bits("bb", text)], atol=1e-3 * (len(text) + 1))


def labelled(spark, n=300):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        junk, toxic = i % 4 == 0, i % 3 == 0
        text = prose(rng, 30) + (" %%%" * 8 if junk else "") + (" vilestword" if toxic else "")
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame([*rows, (n, None), (None, "w1 vilestword")], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (n, None, None), (0, 0, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark, none):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == int(i % 4 != 0) for i in range(300))
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_reads_no_held_out_label(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.quality_scores(docs, labels), quality.quality_scores(docs, flipped)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_toxicity(spark, none):
    docs, labels = labelled(spark)
    docs = docs.withColumn("_row", F.lit("clash"))
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 302 and all(r["_row"] == "clash" and len(r["_p"]) == 2 for r in got)
    for r in got:
        want = r["doc_id"] is None or (r["doc_id"] < 300 and r["doc_id"] % 3 == 0)
        assert (r["_p"][1] >= 0.5) == want
    assert toxicity.toxicity_scores(none.select("doc_id", "text"), labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == 302


def test_chain_by_definition(spark):
    """Probabilities by plain words and sums; each text's out-of-fold margin does not depend on its own fold's labels."""
    docs, labels = labelled(spark)
    cats = toxicity.CATEGORIES
    rows = quality.labelled_texts(docs, labels, "doc_id", "text", ["quality", "toxic"], "toxic", 12000, F.lit(True))
    sample = toxicity.gather(rows, "doc_id", "_text", cats)
    chain = toxicity.train_chain(sample, cats)

    def hashed(raw):
        return next(toxicity.text_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), (0, [], []))[2].tolist()

    def plain(text):
        words_ = {w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())}
        return words_ | {w[:n] + b"*" for w in words_ for n in toxicity.BEGINNINGS if len(w) > n}

    weight = {int(f): [link.weight[k] for link in chain.links] for k, f in enumerate(chain.features)}
    got = {r["doc_id"]: r["_p"] for r in toxicity.chain_probabilities(docs, chain, "text").collect()}
    assert len(chain.features) and any(w[1] > 0 for w in weight.values())
    for r in docs.collect()[::7]:
        features = hashed((r["text"] or "").encode())
        assert len(features) == len(set(features)) == len(plain(r["text"]))
        p = []
        for k, link in enumerate(chain.links):
            margin = sum(weight[f][k] for f in features if f in weight) + link.bias + sum(x * y for x, y in zip(link.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-(link.a * margin + link.b))))
        assert np.allclose(got[r["doc_id"]], p)

    none = np.zeros((len(sample.sets), 0))
    held = toxicity.out_of_fold("t", sample, 1, none)
    out = sample.fold == 0
    by_word = np.array([any(weight[int(sample.features[f])][1] > 0 for f in s) for s in sample.sets])
    assert (np.sign(held[by_word]) > 0).mean() > 0.9
    flipped = toxicity.Sample(sample.fold, [y.copy() for y in sample.positive], sample.sets, sample.features, sample.counts.copy())
    flipped.positive[1][out] = ~flipped.positive[1][out]
    flipped.counts[:, 0, 2] = flipped.counts[:, 0, 0] - flipped.counts[:, 0, 2]
    again = toxicity.out_of_fold("t", flipped, 1, none)
    assert np.allclose(again[out], held[out]) and not np.allclose(again[~out], held[~out])


def test_few_labels_suffice(spark):
    """Six texts of each class are enough for a perfect word, on a small table as on a large one."""
    docs = spark.createDataFrame([(i, "plain words stand here" + (" vilestword" if i % 2 else "")) for i in range(12)], "doc_id long, text string")
    got = toxicity.toxicity_scores(docs, docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))).collect()
    assert all((r["_p"][1] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got)


def test_solver_reaches_the_optimum():
    """The dual's value meets the primal's: no better weights of the hinge loss exist."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=120) * 0.5 > 0, 1.0, -1.0)
    c = np.where(y > 0, 0.4, 0.9)
    w = linear.dual_coordinate_descent([(np.arange(6), v) for v in x], y, 6, c, epochs=3000, tolerance=1e-6)

    def primal(w):
        return w @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w[:6] + w[6]))).sum()

    best = primal(w)
    for size in (1e-3, 1e-2, 0.1):
        for _ in range(300):
            assert primal(w + size * rng.normal(size=7)) >= best - 1e-6


def test_repeated_labels_and_long_texts(spark):
    docs, labels = labelled(spark)
    twice = labels.union(labels.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")))
    a, b = (sorted(map(str, quality.quality_scores(docs, x).collect())) for x in (twice, twice.repartition(7)))
    assert a == b
    long = docs.union(spark.createDataFrame([(9_000, "word and word " * 1_500_000)], "doc_id long, text string"))
    assert quality.quality_scores(long, labels).where("doc_id = 9000 and score between 0 and 1").count() == 1
    assert toxicity.toxicity_scores(long, labels).where("doc_id = 9000 and _p[1] < 0.5").count() == 1


# 6 ----------------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(30):
        centre = rng.normal(size=32)
        for _ in range(rng.integers(1, 6)):
            rows.append((centre + rng.normal(size=32) * rng.choice([0.01, 0.1, 0.25])).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], [0.0] * 32, None, [], [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31]
    ids = [7 * i % 1009 for i in range(len(rows))]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, label int").repartition(4)
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in zip(ids, rows, strict=True) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {(a, b) for a in good for b in good if a < b and float(good[a] @ good[b]) >= 0.95}
    n = collections.Counter(x for p in links for x in p)
    want = brute_components(links, ids)
    got = by_id(vector_dedup.near_vectors(df), "vec_id")
    assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in ids} == {i: (n[i], want[i], want[i] == i) for i in ids}
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_repeated_ids_of_vectors(spark):
    """Three rows in, three out; an id with two vectors is one vertex."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, None), (5, [0.0, 1.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0])]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    assert {(r["n_links"], r["component_id"]) for r in got if r["vec_id"] in (1, 2)} <= {(1, 1), (2, 1)}
    assert len({(r["n_links"], r["component_id"]) for r in got if r["vec_id"] == 5}) == 1
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]


@pytest.mark.parametrize("dims", [1, 64, 768, 1536, 3000])
def test_recall_of_vectors(spark, dims):
    """Pairs planted just above the threshold are found, whatever the dimension; none below it links."""
    rng = np.random.default_rng(dims)
    rows = []
    for k in range(150):
        x = rng.normal(size=dims)
        x /= np.linalg.norm(x)
        away = rng.normal(size=dims)
        away -= (away @ x) * x
        rows.append(x)
        if dims > 1:
            c = rng.uniform(0.95, 0.96) if k % 3 else rng.uniform(0.93, 0.9499)
            rows.append(c * x + math.sqrt(1 - c * c) * away / np.linalg.norm(away))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    all_ = np.array(rows)
    near = all_ @ all_.T / np.linalg.norm(all_, axis=1)[:, None] / np.linalg.norm(all_, axis=1)[None] >= 0.95
    want = (near.sum(1) - 1).tolist()
    got = by_id(vector_dedup.near_vectors(df), "vec_id")
    assert [got[i]["n_links"] for i in range(len(rows))] == want


def test_hadamard_rotation():
    x = np.random.default_rng(2).normal(size=(3, 3000))
    y = vector_dedup.Rotation(3000, 4096, 5).turn(x)
    assert np.allclose(x @ x.T, y @ y.T)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    turn = vector_dedup.rotation(16, vector_dedup.CODE_BITS, 3)
    assert np.allclose(turn @ turn.T, np.eye(16))
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.2 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    factor = np.abs(y @ turn).sum(1) / np.sqrt(vector_dedup.CODE_BITS)
    estimate, error = vector_dedup.estimates(*vector_dedup.quantised(x @ turn), np.packbits(y @ turn > 0, axis=1), factor)
    off = estimate - (x * y).sum(1)
    assert abs(off.mean()) < 0.005 and (np.abs(off) <= error).mean() > 0.999
