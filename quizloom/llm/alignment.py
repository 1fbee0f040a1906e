"""Alignment of two tokenizers over whole texts, by diagonal run skipping, and the links between their ids.

Both tokenizers cut the same bytes, so each gives a rising array of byte ends. Places where both end cut a text into groups.
At a group's end the alignment looks along the diagonal (the shift between the two indices as it stands): blocks of ends are
compared there, each twice as long as the one before, and whole stretches of one-to-one groups are jumped. Where the diagonal
breaks, a window of ends is merged locally, which gives the irregular groups and the new shift.

Three passes over Spark: texts to groups and pairs (staged), pairs to counts of documents, and counts back to documents. Pairs
that very many documents hold (a bounded table, proven by a histogram of the counts) are looked up in the workers; all others
are joined by a shuffle. Both give the same figures.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import bounded_batches, staged
from quizloom.llm.packing import _byte_letters

_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Characters for which the byte-level pattern is applied here; a text with any other goes to the library whole.
_PLAIN = re.compile(f"[\t\n\r\x20-\x7e{_LETTER}]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+(?!\\S)|\\s+")
_UNITS = re.compile(r" *[^ \n]+| +|\n")
#: Pre-tokens whose ids a worker remembers for each tokenizer, and the longest that is remembered (bytes).
REMEMBERED, LONGEST = 500_000, 64
#: Bytes of text whose ends are aligned at once (a longer text is alone).
SLICE = 1 << 19
#: Links that are written out at once; a group with more is counted by its distinct ids.
LINKS_AT_ONCE = 1 << 20
#: Pairs that are looked up in the workers, at most: 17 bytes each.
HOT_PAIRS = 1 << 18


#: Stands for ids that do not give their text back.
STRANGE = b"\xff\xff\xff\xff"


def whole(ids: list[int], table: list[bytes], text: str) -> bytes:
    return np.array(ids, "<u4").tobytes() if b"".join(map(table.__getitem__, ids)) == text.encode() else STRANGE


class _ByteLevel(dict):
    """Pre-token (text) to ids of a byte-level BPE file, little-endian 32 bits; special strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        back = {c: b for b, c in self.letters.items()}
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()

    def __missing__(self, token: str) -> bytes:
        shown = token if token.isascii() and " " not in token and token.isprintable() else "".join(map(self.letters.__getitem__, token.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        ids = np.array(ids, "<u4").tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == token.encode() else STRANGE
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of space + text."""
        text = " " + text
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, _WORDS.findall(text)))
        return whole(self.tokenizer.encode(text, add_special_tokens=False).ids, self.bytes, text)


class _Pieces(dict):
    """Unit (text) to ids of a sentencepiece BPE model; no merge crosses a unit, see token_count."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        self.mark = [sp.piece_to_id("▁")]

    def __missing__(self, unit: str) -> bytes:
        if unit[0] == " " and len(unit) > 1:
            ids = self.sp.encode(unit[1:])
        else:
            ids = self.mark if unit == " " else self.sp.encode("\n" + unit)[2:] if unit != "\n" else self.sp.encode("\n")[1:]
        found = np.array(ids, "<u4").tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == unit.encode() else STRANGE
        if len(unit) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of the text, before which the library puts a space."""
        if "▁" in text or "\0" in text:
            return whole(self.sp.encode(text), self.bytes, " " + text)
        return b"".join(map(self.__getitem__, _UNITS.findall(" " + text)))


class Tokenizers:
    """Both tokenizers of a worker, with each id's bytes and its decimal text before each kind of separator."""

    def __init__(self, a_file: str, b_file: str):
        from quizloom.llm.token_count import prove

        prove(b_file)  # raises if merges could cross units
        self.a, self.b = _ByteLevel(a_file), _Pieces(b_file)
        self.a_length = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b.bytes], np.int64)
        self.n_b = len(self.b.bytes)
        n = max(len(self.a.bytes), self.n_b)
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(n)]
        self.n = n

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if the text has no tokens by contract (null, empty, or bytes that differ)."""
        if not text:
            return None
        a, b = np.frombuffer(self.a.encode(text), "<u4"), np.frombuffer(self.b.encode(text), "<u4")
        return None if max(a.max(), b.max()) == 0xFFFFFFFF else (a, b)


_held: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    if (a_file, b_file) not in _held:
        _held[a_file, b_file] = Tokenizers(a_file, b_file)
    return _held[a_file, b_file]


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rising arrays of ends with the same last value: how many of a and of b lie up to the end of each group."""
    n = len(a)
    i = j = 0
    found_a, found_b = [], []
    probe, window = 16, 64
    while i < n:
        m = min(probe, n - i, len(b) - j)
        same = a[i : i + m] == b[j : j + m]
        run = m if same.all() else int(same.argmin())
        if run:
            found_a.append(np.arange(i + 1, i + run + 1))
            found_b.append(np.arange(j + 1, j + run + 1))
            i, j = i + run, j + run
        if run == m:
            probe, window = probe * 2, 64
            continue
        # The diagonal breaks here: merge a window of both until it holds a common end, then go on at its last one.
        window = min(window * 2, 4096) if run < 16 else 64
        probe, wide = 16, window
        while True:
            here, there = a[i : i + wide], b[j : j + wide]
            at = np.searchsorted(there, here)
            hit = np.flatnonzero(there[np.minimum(at, len(there) - 1)] == here)
            if len(hit):
                break
            wide *= 4
        found_a.append(i + hit + 1)
        found_b.append(j + at[hit] + 1)
        i, j = int(found_a[-1][-1]), int(found_b[-1][-1])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _links(a, b, begin_a, begin_b, size_a, size_b, doc, n_b) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document << 40 | a's id * n_b + b's id) over the links of all groups, sorted, with how often each is linked."""
    many = size_a * size_b
    keys, counts = [], []
    wide = many > LINKS_AT_ONCE
    for g in np.flatnonzero(wide):
        ids_a, often_a = np.unique(a[begin_a[g] : begin_a[g] + size_a[g]], return_counts=True)
        ids_b, often_b = np.unique(b[begin_b[g] : begin_b[g] + size_b[g]], return_counts=True)
        keys.append(((doc[g] << 40) + ids_a.astype(np.int64)[:, None] * n_b + ids_b.astype(np.int64)[None, :]).ravel())
        counts.append((often_a[:, None] * often_b[None, :]).ravel())
    groups = np.flatnonzero(~wide)
    upto = np.cumsum(many[groups])
    at = 0
    while at < len(groups):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
        g = groups[at:to]
        of_a = np.repeat(g, size_a[g])  # the group of each of these tokens of a
        token_a = begin_a[of_a] + _within(size_a[g])
        of_link = np.repeat(np.arange(len(of_a)), size_b[of_a])
        token_b = begin_b[of_a[of_link]] + _within(size_b[of_a])
        key = (doc[of_a[of_link]] << 40) + a[token_a[of_link]].astype(np.int64) * n_b + b[token_b].astype(np.int64)
        key, often = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(often)
        at = to
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return key, total


def _aligned(tok: Tokenizers, texts: list, digest: bool):
    """Per text: ids of a, ids of b, groups, links, groups as text; and over all texts their pairs and how often, with the offsets."""
    encoded = [tok.encode(t) for t in texts]
    n_a = np.array([len(e[0]) if e else 0 for e in encoded], np.int64)
    n_b = np.array([len(e[1]) if e else 0 for e in encoded], np.int64)
    none = np.zeros(0, np.uint32)
    a = np.concatenate([none, *[e[0] for e in encoded if e]])
    b = np.concatenate([none, *[e[1] for e in encoded if e]])
    upto_a, upto_b = align(np.cumsum(tok.a_length[a]), np.cumsum(tok.b_length[b]))
    size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    begin_a, begin_b = upto_a - size_a, upto_b - size_b
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    doc = np.searchsorted(ends_a, begin_a, "right")  # texts end where groups end, as their bytes are equal
    n_groups = np.bincount(doc, minlength=len(texts))
    n_links = np.bincount(doc, size_a * size_b, minlength=len(texts)).astype(np.int64)

    # Groups as text: each id with the separator behind it, in the places where they stand.
    code = np.zeros(len(a) + len(b), np.int64)
    mark_a = np.zeros(len(a), np.int64)
    mark_a[upto_a - 1] = tok.n
    code[np.arange(len(a)) + np.repeat(begin_b, size_a)] = a + mark_a
    mark_b = np.zeros(len(b), np.int64)
    mark_b[upto_b - 1] = 2 * tok.n
    code[np.arange(len(b)) + np.repeat(upto_a, size_b)] = b + mark_b
    shown, code, ends = tok.shown.__getitem__, code.tolist(), (ends_a + ends_b).tolist()
    said, at = [], 0
    for to in ends:
        text = "".join(map(shown, code[at:to]))[:-1]
        said.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
        at = to

    key, often = _links(a, b, begin_a, begin_b, size_a, size_b, doc, tok.n_b)
    offsets = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << 40)
    return n_a, n_b, n_groups, n_links, said, key & ((1 << 40) - 1), often, offsets


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size > SLICE:
            if k > at:
                yield at, k
                at, size = k, len(t)
    if at < len(texts):
        yield at, len(texts)


def align_tokenizers(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False) -> DataFrame:
    """Per row of ``df``: id, n_a, n_b, n_groups, n_links, groups, pairs and pair_links.

    ``a_file`` is a byte-level BPE file, given space + text; ``b_file`` a sentencepiece BPE model, which adds the space itself.
    Special strings in a text are ordinary text. ``groups`` is ``a1,a2|b1;a3|b2,b3``, ids in order (its SHA-256 with ``digest``);
    ``pairs`` are the distinct linked id pairs, as a's id * size of b's vocabulary + b's id, ``pair_links`` how often each is linked.
    A text that is null or empty, or whose bytes either tokenizer does not give back (such as one with U+2581), has no tokens:
    zeros, an empty ``groups``, no pairs. Rows with equal or null ids each give their row. Nothing is shuffled; a worker holds half a megabyte
    of text at once, or one longer text. A group of more than a million links is counted by its distinct ids.
    """
    bounded_batches(df.sparkSession)
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_file, b_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in _slices(texts):
                n_a, n_b, n_groups, n_links, said, pairs, often, offsets = _aligned(tok, texts[at:to], digest)
                offsets = pa.array(offsets, pa.int32())
                columns = [batch.column(0).slice(at, to - at), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(often, pa.int64()))], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, pair_links array<long>"
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(work, schema)


def pair_documents(aligned: DataFrame) -> DataFrame:
    """(pair, docs): how many rows of ``aligned`` hold each pair. Workers add up a bounded run of rows before anything is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            pair, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs.astype(np.int64))], names=["pair", "docs"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size > 1 << 21:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return aligned.select("pairs").mapInArrow(add, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _hot(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A number of documents that at most ``most`` pairs reach, and those pairs (sorted), their counts and whether each is its id's best.

    The number comes from a histogram of the counts in eighths of powers of two: some 500 rows to the driver.
    """
    steps = {r["step"]: (r["n"], r["least"]) for r in counts.groupBy(F.floor(F.log2("docs") * 8).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least")).collect()}
    total, floor = 0, 1 << 62
    for step in sorted(steps, reverse=True):
        total += steps[step][0]
        if total > most:
            break
        floor = steps[step][1]
    rows = counts.where(F.col("docs") >= floor).toArrow().sort_by("pair")
    columns = [rows.column(c).to_numpy() for c in ("pair", "docs", "best")]
    return floor, columns[0].astype(np.int64), columns[1].astype(np.int64), columns[2].astype(np.int64)


def tokenizer_links(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", *, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens).

    A pair's count is the number of rows that hold it linked; ``n_best`` counts links whose count is the highest of their a's id
    (ties included), ``count_sum`` adds the counts over all links. ``hot_pairs`` bounds the table that workers look pairs up
    in; it never changes results. See align_tokenizers() for nulls, empty and long texts. An empty table gives none.
    """
    spark = df.sparkSession
    n_b = _vocabulary(b_file)
    found = staged(align_tokenizers(df, a_file, b_file, id_col, text_col, digest=True).withColumn("_row", F.monotonically_increasing_id()), "alignment")
    docs = staged(pair_documents(found), "alignment-pairs")
    # One row an id of a at most, so bounded by its vocabulary; Spark sees the size of the counts and decides on the join.
    of_a = F.floor(F.col("pair") / F.lit(n_b))
    highest = docs.groupBy(of_a.alias("_a")).agg(F.max("docs").alias("_most"))
    counts = docs.join(F.broadcast(highest), of_a == F.col("_a")).select("pair", "docs", (F.col("docs") == F.col("_most")).cast("long").alias("best"))
    floor, *table = _hot(counts, hot_pairs)
    shared = spark.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs_of, best_of = shared.value
        for batch in batches:
            rows = batch.num_rows
            values, often = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            of_row = np.repeat(np.arange(rows), np.diff(batch.column(1).offsets.to_numpy()))
            at = np.minimum(np.searchsorted(pair, values), max(len(pair) - 1, 0))
            known = pair[at] == values if len(pair) else np.zeros(len(values), bool)
            hit = at[known]
            sums = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(sums[0], of_row[known], often[known] * best_of[hit])
            np.add.at(sums[1], of_row[known], often[known] * docs_of[hit])
            rest = ~known
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of_row[rest], minlength=rows))]), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(x[rest], pa.int64())) for x in (values, often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *left], names=["_row", "_best", "_sum", "_pairs", "_often"])

    looked = found.select("_row", "pairs", "pair_links").mapInArrow(look_up, "_row long, _best long, _sum long, _pairs array<long>, _often array<long>")
    looked = staged(looked, "alignment-looked-up")
    rest = looked.select("_row", F.explode(F.arrays_zip("_pairs", "_often")).alias("_l")).select("_row", F.col("_l._pairs").alias("pair"), F.col("_l._often").alias("_often"))
    rest = rest.join(counts.where(F.col("docs") < floor), "pair").select("_row", (F.col("_often") * F.col("best")).alias("_best"), (F.col("_often") * F.col("docs")).alias("_sum"))
    sums = looked.select("_row", "_best", "_sum").unionAll(rest).groupBy("_row").agg(F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum"))
    out = found.select("_row", F.col(id_col), "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "_row")
    return out.select(F.col(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def _vocabulary(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
