"""Tokenizer alignment, conversation repair and fingerprints against brute force; nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quizloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quizloom.llm import alignment, conversations, fingerprints  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# 11 ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_groups(libraries, text):
    """[(ids of a, ids of b)] by definition: cut wherever both end."""
    if not text:
        return []
    tok, sp = libraries
    letters = alignment._byte_letters()
    back = {c: b for b, c in letters.items()}
    a, b = tok.encode(" " + text, add_special_tokens=False), sp.encode(text)
    bytes_a = [bytes(back[c] for c in t) for t in a.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for c in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
        out.append((a.ids[i:k], b[j:m]))
        i, j = k, m
    return out


def test_alignment(spark, libraries):
    rng = random.Random(2)
    parts = ["the ", "Über", " naïve", "\n", "\n\n", "  ", "\t", "\r\n", "don't", "<|endoftext|>", "</s>", "<s>", "▁", "中文", "😀", "3.14", "antidisestablishmentarianism", "\x0b", "\0", "ªº²½", "xababab", "　", "İ", "é"]
    texts = [None, "", " ", "\n", "▁", "a", "ab " * 3000, "xabab" * 400, "é" * 500, *["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(150)], "word " * 20_000]
    texts += ["the same text again"] * 40
    df = spark.createDataFrame([(i if i % 50 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs int").repartition(5)
    groups = [token_groups(libraries, t) for t in texts]
    docs, held = collections.Counter(), []
    for g in groups:
        held.append(collections.Counter((x, y) for a, b in g for x in a for y in b))
        docs.update(held[-1].keys())
    best = collections.defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    want = collections.Counter()
    for i, (g, links) in enumerate(zip(groups, held, strict=True)):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want[
            i if i % 50 else None, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), sum(n for p, n in links.items() if docs[p] == best[p[0]]),
            sum(n * docs[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
        ] += 1
    for hot in (alignment.HOT_PAIRS, 40, 0):
        got = collections.Counter(tuple(r) for r in alignment.tokenizer_links(df, A, B, hot_pairs=hot).collect())
        assert got == want
    assert alignment.tokenizer_links(df.limit(0), A, B).count() == 0
    shown = alignment.align_tokenizers(df.where("text = 'a'"), A, B).first()
    assert shown["groups"] == "257|264" or shown["n_groups"] == 1


def test_diagonal_and_large_groups(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (1, 5, 400, 20_000):
        a, b = np.unique(rng.integers(1, 4 * n, n)), np.unique(rng.integers(1, 4 * n, n))
        if n == 400:
            a, b = np.arange(1, 800, 2), np.arange(2, 800, 2)  # no end in common but the last
        if n == 20_000:
            a[:15_000] = b[:15_000] = np.arange(1, 15_001)  # one long run, then all shifts
            a, b = np.unique(a), np.unique(b)
        last = max(a[-1], b[-1]) + 1
        a, b = np.append(a, last), np.append(b, last)
        common = np.intersect1d(a, b)
        upto_a, upto_b = alignment.align(a, b)
        assert np.array_equal(a[upto_a - 1], common) and np.array_equal(b[upto_b - 1], common)
    ids_a, ids_b = rng.integers(0, 5, 300).astype(np.uint32), rng.integers(0, 5, 200).astype(np.uint32)
    args = (ids_a, ids_b, np.array([0, 290]), np.array([0, 195]), np.array([290, 10]), np.array([195, 5]), np.array([0, 0]), 5)
    usual = alignment._links(*args)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 40)
    assert all(np.array_equal(x, y) for x, y in zip(usual, alignment._links(*args), strict=True)) and usual[1].sum() == 290 * 195 + 50


# 12 ---------------------------------------------------------------------------------------------------------------------

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired lines) by a plain search over all edit sequences in order of cost, then audit: rows are (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, letters, lines = heapq.heappop(heap)
        tail = letters[-1:] if letters else "-"
        if i == len(rows) and PATTERN.fullmatch(letters):
            return cost, audit, lines
        if (i, tail) in done:
            continue
        options = [(2, "I", i, r, (r + ":",)) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, gone, late = rows[i]
            options.append((3, "D", i + 1, None, ()))
            if not gone:
                options.append((late, "K", i + 1, role, (role + ":" + text,)))
                options += [(2 + late, "R", i + 1, r, (r + ":" + text,)) for r in ("user", "assistant")]
        done.add((i, tail))
        for more, edit, to, role, line in options:
            said = letters if role is None else letters + (role[:1] or "-")
            # A prefix that the pattern can still complete.
            if role is None or (role and (PATTERN.fullmatch(said) or PATTERN.fullmatch(said + "a") or PATTERN.fullmatch(said + "ua"))):
                heapq.heappush(heap, (cost + more, audit + edit, to, said, lines + line))
    raise AssertionError


def repaired(rows):
    """The contract, by definition, for (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)[-1:]
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    cost, audit, lines = cheapest([(r, t, k in ("blank", "duplicate"), int(k == "truncated")) for (_, r, t), k in zip(rows, kinds, strict=True)])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        yield from [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)


def talks(seed, n, longest):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant"] * 4 + ["system", "tool", None, "", "s", "ufo", "Ärger"], ["Yes.", "No!", "Why? ", "half", "", " \n", None, "Ende.\t", "…", "two\nlines."]
    rows = []
    for c in range(n):
        length = rng.randint(1, longest)
        for t in range(length):
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 0, 1])
            usual = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((c * 7 if c else None, turn, usual, rng.choice(texts) if rng.random() < 0.4 else f"Turn {rng.randint(0, 30)}."))
    return rows


@pytest.mark.parametrize("bits", [10, 2, 0])
def test_conversations(spark, bits):
    rows = talks(bits, 60, 14)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, _pos string").repartition(4)
    per = collections.defaultdict(list)
    for conv, turn, role, text in damage(rows):
        per[conv].append((turn, role, text))
    repair = conversations.repair_conversations(conversations.damaged(df), chunk_bits=bits)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.conversation_report(repair, df.select("conv_id")).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: repaired(per[c]) if per[c] else none for c in {r[0] for r in rows}}
    lines = collections.defaultdict(list)
    for r in sorted(conversations.repaired_rows(repair).collect(), key=lambda r: (r["chunk"], r["place"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == got[c][-1] for c in got)


def test_long_and_hot_conversation(spark):
    """One conversation with most rows, in many chunks and tasks; a run without any legal row, where speculation is wrong far back."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"Turn {t if rng.random() < 0.9 else 7}{rng.choice(['.', '', '!'])}") for t in range(3000)]
    rows += [(1, t, "assistant", "same.") for t in range(3000, 3500)] + [(2, 0, "system", "Only."), (3, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repair = conversations.repair_conversations(df, chunk_bits=5)
    assert repair.chunks.where("_conv = 1").count() > 100
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.conversation_report(repair, df.select("conv_id")).collect()}
    per = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        per[conv].append((turn, role, " " if text is None else text))
    whole = conversations.repair_conversations(df, chunk_bits=20)
    assert got == {r["conv_id"]: tuple(r)[1:] for r in conversations.conversation_report(whole, df.select("conv_id")).collect()}
    assert got[2] == repaired(per[2]) and got[3] == repaired(per[3]) and got[1][:5] == repaired(per[1][:60])[:0] + got[1][:5]
    assert got[1][2] >= 499  # the repeats
    empty = df.limit(0)
    assert conversations.conversation_report(conversations.repair_conversations(empty), empty.select("conv_id")).count() == 0
    assert conversations.repaired_rows(conversations.repair_conversations(empty)).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 20_000_000 + "."), (1, 1, "assistant", "Short.")], "conv_id long, turn long, role string, text string")
    got = conversations.conversation_report(conversations.repair_conversations(df), df.select("conv_id")).first()
    assert got["audit"] == "KK" and got["repaired_sha256"] == hashlib.sha256(("user:" + "x" * 20_000_000 + ".\nassistant:Short.").encode()).hexdigest()


# 13 ---------------------------------------------------------------------------------------------------------------------


def shingle_hashes(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return {hashlib.md5(s.encode()).hexdigest()[:12] for s in found}


def likeness(a, b, k):
    least = sorted(a | b)[:k]
    return sum(x in a and x in b for x in least) / len(least) if least else 1.0


@pytest.mark.parametrize("run_rows", [2048, 8])
def test_fingerprints(spark, run_rows, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \t", "one", "Two WORDS", "ünï çödé 中文 😀 mixed\x0bwords\x0c here", "a b c d e", *[" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 400))) for _ in range(80)], "z " * 5000]
    texts += ["copied text of some more than five words"] * 9
    rows = [(i * 5 % 97, t, "clash") for i, t in enumerate(texts)] + [(None, "no id one", "x"), (None, "no id two", "x"), (3, "again three", "x"), (3, "again three", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sketch string").repartition(3)
    monkeypatch.setattr(fingerprints, "RUN_ROWS", run_rows)
    placed, order = fingerprints.ordered_runs(df, run_rows=run_rows)
    chain = placed.withColumn("_n", F.struct(F.lead("_id").over(order).alias("i"), F.lead("_text").over(order).alias("t"))).where("_guest = 0").collect()
    keys = sorted({(r["_id"] is not None, r["_id"] or 0) for r in chain}, reverse=True)
    seen = collections.Counter((r["_id"], r["_text"]) for r in chain)
    assert seen == collections.Counter((i, t or "") for i, t, _ in rows)
    assert seen == collections.Counter((r["_n"]["i"], r["_n"]["t"]) for r in chain)  # each row is the next of one row
    for r in chain:
        a, b = keys.index((r["_id"] is not None, r["_id"] or 0)), keys.index((r["_n"]["i"] is not None, r["_n"]["i"] or 0))
        assert b in (a, (a + 1) % len(keys))
    monkeypatch.setattr(fingerprints, "ordered_runs", lambda *x, **y: (placed, order))
    nexts = collections.defaultdict(list)
    for r in chain:
        nexts[r["_id"], r["_text"]].append(r["_n"]["t"])
    k = 16
    for r in fingerprints.edited_fingerprints(df, k=k).collect():
        fits = []
        for (i, t), follow in nexts.items():
            for n in follow if i == r["doc_id"] else []:
                edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
                own, new, other = shingle_hashes(t), shingle_hashes(edited), shingle_hashes(n)
                fits.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(own)[:k]), "".join(sorted(new)[:k]), likeness(own, new, k), likeness(own, other, k)))
        assert tuple(r)[1:] in fits


def test_fingerprint_edges_and_merging(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([("x", "abcd")], "doc_id string, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    rng = random.Random(6)
    texts = {i: [" ".join(str(rng.randint(0, 400)) for _ in range(300)) for _ in range(6)] for i in range(3)} | {None: ["few words"], 9: [""]}
    parts = fingerprints.fingerprints(spark.createDataFrame([(i, t) for i, ts in texts.items() for t in ts], "key long, text string"))
    got = {r["key"]: r["_sketch"] for r in fingerprints.merged(parts, "key").collect()}
    for i, ts in texts.items():
        assert got[i] == sorted(set().union(*map(shingle_hashes, ts)))[: fingerprints.K]
    figures = fingerprints.merged(parts, "key").where("key in (0, 1)").groupBy().agg(F.max_by("_sketch", F.col("key") == 0).alias("a"), F.max_by("_sketch", F.col("key") == 1).alias("b"))
    a, b = (set().union(*map(shingle_hashes, texts[i])) for i in (0, 1))
    r = figures.select(fingerprints.distinct_shingles(F.col("a")).alias("n"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("a")).alias("c")).first()
    assert abs(r["n"] / len(a) - 1) < 0.35 and abs(r["r"] - len(a & b) / len(a | b)) < 0.15 and r["c"] == 1.0
    packed = parts.where("key is null").select(fingerprints.unpacked(fingerprints.packed(F.col("_sketch"))).alias("u"), "_sketch").first()
    assert packed["u"] == packed["_sketch"]
