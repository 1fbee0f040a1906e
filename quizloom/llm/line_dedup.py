"""Near-duplicate lines across a corpus by a deletion-neighbourhood join.

Two lines are near if one word inserted, deleted or replaced turns one into the other (words in lower case, white space
ignored). Each line's variants with one word left out are hashed; lines that share a variant meet by an equi-join on the
hash, the edit distance of each pair so found is verified on the texts, and of near lines the earliest stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import PrimeSums, WordSums, bounded_batches, mixed, slices, spaces, spans, staged, utf8, words

#: Lines of fewer words have no near lines: one word is too much of them.
LEAST_WORDS = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER_AZ = {c: c + 32 for c in range(65, 91)}


#: A block of rows has about so many bytes; a longer text is cut behind line feeds, so that only a single longer line is held whole.
BLOCK_BYTES = 1 << 18


def _blocks(data: np.ndarray, offsets: np.ndarray, most: int):
    """(first row, bytes, offsets of the rows there, place of the first line) of blocks of about ``most`` bytes."""
    for a, z in slices(offsets, most):
        at, end, place = int(offsets[a]), int(offsets[z]), 0
        if end - at <= most:
            yield a, data[at:end], offsets[a : z + 1] - at, 0
            continue
        while at < end:
            to = at + most
            while to < end:
                feeds = np.flatnonzero(data[to : to + most] == 10)
                if len(feeds):
                    to += int(feeds[0]) + 1
                    break
                to += most
            to = min(to, end)
            yield a, data[at:to], np.array([0, to - at]), place
            place += int(np.count_nonzero(data[at:to] == 10))
            at = to


def _lines(data: np.ndarray, offsets: np.ndarray):
    """By blocks: (bytes of the block, row, place among the row's lines, first word, word end, WordSums, byte start, byte end, row starts) of each line."""
    for a, own, ends, place0 in _blocks(data, offsets, BLOCK_BYTES):
        begins = ends[:-1]
        start, _, hashes = words(own, begins)
        feeds = np.flatnonzero(own == 10)
        # A line begins after a feed and at the start of each row; empty rows begin where the next does.
        first = np.concatenate([begins, feeds + 1])
        row = np.concatenate([np.arange(len(begins)), np.searchsorted(begins, feeds, "right") - 1])
        order = np.lexsort((first, row))
        first, row = first[order], row[order]
        place = place0 + np.arange(len(row)) - np.searchsorted(row, row)
        last = np.append(first[1:], len(own))
        w0, w1 = np.searchsorted(start, first), np.searchsorted(start, last)
        # Of a row that ends with a feed, the last line is empty; it starts where the next row does.
        w1 = np.where(first >= ends[row + 1], w0, w1)
        yield own, a + row, place, w0, w1, WordSums(hashes), first, last, begins


def _repeat(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the index of each item's owner, and its number among the owner's."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def shared_words(m: np.ndarray) -> np.ndarray:
    """Up to half of m words, rounded down to a multiple of 4 so that neighbouring lengths mostly agree; at least 1."""
    return np.maximum(m // 8 * 4, np.minimum(m // 2, 3))


def _line_keys(least_words: int, exact_words: int):
    """(doc, place, line hashes, half keys) of each line that counts; lines of fewer than ``least_words`` words have no half keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, row, place, w0, w1, sums, _, _, begins in _lines(*utf8(b.column(1))):
                n = w1 - w0
                k = np.flatnonzero(n >= exact_words)
                if not len(k):
                    continue
                check = PrimeSums(own, *spans(~spaces(own), begins))
                w0, w1, n = w0[k], w1[k], n[k]
                # Of two near lines the shorter has m words, n or n - 1 for a line of n; they agree in their first or in their last
                # shared_words(m) words. Mostly that is one number for n and n - 1.
                keys, used = [], []
                for tag, m in ((1, n), (2, n), (1, n - 1), (2, n - 1)):
                    h = shared_words(m)
                    keys.append(mixed((sums.run(w0, w0 + h) if tag == 1 else sums.run(w1 - h, w1)) + np.uint64(tag)))
                    used.append((n >= least_words) & (np.ones(len(k), bool) if m is n else h != shared_words(n)))
                used = np.stack(used, 1)
                halves = np.stack(keys, 1).view(np.int64)[used]
                ends = pa.array(np.concatenate([[0], np.cumsum(used.sum(1))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row[k])), pa.array(place[k]), pa.array(sums.run(w0, w1).view(np.int64)), pa.array(check.run(w0, w1)), pa.ListArray.from_arrays(ends, pa.array(halves))],
                    names=["doc", "place", "line", "check", "halves"],
                )

    return make


def _variants(least_words: int):
    """Of each row (doc, text, marks): keys of the marked lines (kind 2, with their text) and of their variants with one word left out (0 and 1).

    A mark is 4 times the line's place, plus 1 if it shares its beginning with another line, plus 2 for its end. What is shared is
    whole, so a word is left out only elsewhere (of equal words in a row any one may go, and one stands elsewhere).
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            wanted, marks = b.column(2).value_lengths().to_numpy(), b.column(2).flatten().to_numpy()
            pairs = np.repeat(np.arange(len(wanted)), wanted) * (1 << 32) + (marks >> 2)
            order = np.argsort(pairs)
            pairs, sides = pairs[order], (marks & 3)[order]
            for own, row, place, w0, w1, sums, first, last, _ in _lines(data, offsets):
                k = np.flatnonzero(np.isin(row * (1 << 32) + place, pairs))
                if not len(k):
                    continue
                side = sides[np.searchsorted(pairs, row[k] * (1 << 32) + place[k])]
                w0, w1 = w0[k], w1[k]
                n = w1 - w0
                h = shared_words(n - 1)
                begin, end = np.where(side == 1, h, 0), np.where(side == 2, n - h, n)
                owner, i = _repeat(end - begin)
                i = i + begin[owner]
                rest = sums.without(w0[owner], w1[owner], w0[owner] + i)
                # The place and what is left: all lines with one such key differ in that word alone.
                swap = mixed(rest + (i.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                keys = np.concatenate([swap, rest, sums.run(w0, w1)]).view(np.int64)
                kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(owner), len(owner), len(k)])
                owners = np.concatenate([owner, owner, np.arange(len(k))])
                texts = pa.array([None] * (2 * len(owner)) + [own[first[j] : last[j]].tobytes().decode("utf8", "replace") for j in k], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row[k][owners])), pa.array(place[k][owners]), pa.array(keys), pa.array(kinds), texts], names=["doc", "place", "key", "kind", "line_text"]
                )

    return make


def within_one_edit(a: str, b: str) -> bool:
    """Whether one word inserted, deleted or replaced at most turns one line into the other."""
    x, y = _words_of(a), _words_of(b)
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    j = 0
    while j < min(len(x), len(y)) - i and x[-1 - j] == y[-1 - j]:
        j += 1
    return len(x) - i - j <= 1 and len(y) - i - j <= 1


def _words_of(line: str) -> list[str]:
    return _WORD.findall(line.translate(_LOWER_AZ))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [within_one_edit(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(b.columns[:2], names=["doc", "place"]).filter(pa.array(good, pa.bool_()))


def _order(doc: str, place: str) -> Column:
    """Document and place as one number, in the order of the corpus."""
    return (F.col(doc).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(place).cast("decimal(10,0)")).cast("decimal(31,0)")


#: A line with more than this part of all lines is hot; so there are fewer than 1,000 hot lines, whatever the input.
HOT_PART = 0.001


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, exact_words: int = 1) -> DataFrame:
    """(doc, place) of each line that repeats an earlier line of the corpus, exactly or but for one word.

    Earlier means a smaller id, or the same id and a smaller place. A line goes if any earlier line is near it, whether or
    not that one goes too: of a chain of edits only the first line stays, as each line's like is in the corpus one step before. Lines of
    fewer than ``least_words`` words are near none; those of ``exact_words`` words or more (1: all that are not blank) go if they
    repeat an earlier line exactly. Exact repeats are told by two unlike hashes of 64 and 31 bits, near ones by their words. Rows with a null id
    or text take no part. Rows that share an id share its lines' places, and are judged alike. A single line is held whole by one
    task; longer texts are cut behind line feeds.

    At scale: exact repeats meet by a grouping with sums combined before the shuffle; copies of hot lines are marked where they are read. Two lines one word apart agree in their
    first or their last half, so only lines that share a half with another line (again a combined grouping) get variants. A
    variant's group is never compared pairwise: lines that leave the same rest at the same place are all near each
    other, and lines that become another line are near that one; so the earliest of a group, combined before the
    shuffle, decides for all its members, however many.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_text")).where("doc is not null and _text is not null")
    keys = docs.mapInArrow(_line_keys(least_words, max(1, exact_words)), "doc long, place long, line long, check long, halves array<long>")
    keys = staged(keys, "lines").withColumn("at", _order("doc", "place"))
    same = ["line", "check"]
    lines = staged(keys.groupBy(*same).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-lines")
    repeated = lines.where("n > 1").select(*same, "first", "n")
    floor = max(64, int(keys.count() * HOT_PART))
    hot = F.broadcast(repeated.where(F.col("n") > floor).select(*same, F.col("first").alias("hot_first")))
    marked = keys.select("doc", "place", *same, "at").join(hot, same, "left")
    exact = marked.where("at > hot_first").select("doc", "place")
    rest = marked.where("hot_first is null").join(repeated.where(F.col("n") <= floor).select(*same, "first"), same).where("at > first").select("doc", "place")
    exact = exact.union(rest)

    halves = keys.select("line", F.posexplode("halves").alias("_i", "half")).select("line", "half", (F.col("_i") % 2 + 1).alias("side"))
    shared = halves.groupBy("half").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x != y").select("half")
    suspects = halves.join(shared, "half", "left_semi").groupBy("line").agg(F.bit_or("side").alias("side"))
    place = F.pmod("first", F.lit(1 << 32).cast("decimal(31,0)"))
    suspects = lines.join(suspects, "line").select(((F.col("first") - place) / F.lit(1 << 32)).cast("decimal(20,0)").cast("long").alias("doc"), (place.cast("long") * 4 + F.col("side")).alias("mark"))
    suspects = suspects.groupBy("doc").agg(F.collect_set("mark").alias("marks"))
    variants = docs.join(suspects, "doc").select("doc", "_text", "marks").mapInArrow(_variants(least_words), "doc long, place long, key long, kind byte, line_text string")
    variants = staged(variants, "variants").withColumn("at", _order("doc", "place"))

    least = [F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"m{k}") for k in (0, 1, 2)]
    met = variants.groupBy("key").agg(*least, F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo != hi").drop("lo", "hi")
    earlier = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = variants.select("doc", "place", "at", "key", "kind").join(met, "key").withColumn("earlier", earlier).where("earlier < at").groupBy("doc", "place", "at").agg(F.min("earlier").alias("earlier"))
    texts = variants.where("kind = 2").select("at", "line_text")
    pairs = pairs.join(texts, "at").join(texts.select(F.col("at").alias("earlier"), F.col("line_text").alias("earlier_text")), "earlier")
    near = pairs.select("doc", "place", "line_text", "earlier_text").mapInArrow(_verified, "doc long, place long")
    return exact.union(near).distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, exact_words: int = 1) -> DataFrame:
    """All columns of ``df``, with the text without the lines that repeated_lines() finds, and _lines, _gone (lines before, and left out).

    Columns _lines and _gone of ``df`` are replaced, others stay whatever their names. Null ids and null texts stay as they
    are (null texts have 0 lines). A text whose lines are all gone is empty; what to
    do with its row is the caller's choice. Rows with equal ids are judged alike. An empty table gives an empty result.
    """
    gone = repeated_lines(df, id_col, text_col, least_words, exact_words).groupBy("doc").agg(F.collect_list("place").alias("_places"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    out = rows.join(gone, F.col("_doc") == F.col("doc"), "left")
    lines = F.split("_text", "\n", -1)
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), F.col("_places")))
    # The one-element array binds the split lines to a name; else the text would be split again for each line.
    kept = F.get(F.transform(F.array(lines), lambda split: F.transform(left, lambda i: F.get(split, i.cast("int")))), F.lit(0))
    text = F.when(F.col("_places").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    own = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns if c not in ("_lines", "_gone")]
    return out.select(*own, n.cast("long").alias("_lines"), F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("_gone"))
