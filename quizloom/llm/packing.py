"""Packing of documents into fixed sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters for which the pre-tokens are found here; a text with any other goes to the library whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]*")
_LETTER = "a-zß-öø-ſ"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 1_000_000


def _byte_letters() -> dict[int, str]:
    """Byte to the character that stands for it in byte-level vocabularies: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder(dict):
    """Texts to little-endian 32-bit ids, as the library's encode(text, add_special_tokens=False) gives them.

    The tokenizer lower-cases, cuts at a pattern and merges each pre-token alone, so ids are remembered by pre-token.
    For texts of ASCII and Latin letters, without special strings, the pattern is applied here; any other text
    (other scripts, combining marks, special strings) is encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, token: str) -> bytes:
        shown = token if token.isascii() else "".join(map(self.letters.__getitem__, token.encode()))
        ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _PRE_TOKEN.findall(text.lower())))


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: largest items first, each into the first bin with room.

    The bins' free room stands in the leaves of a tournament tree, each inner node has the larger of its two; the first bin
    with room is found from the root in as many steps as the tree is high.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = array("q", [capacity]) * (2 * leaves)
    bins = [0] * n
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        need, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i] = at - leaves
        room[at] -= need
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
    return bins


_PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


def pack_documents(
    df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 1, group_docs: int = 2048, seed: int = 0
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (then ``end_id``) are cut into whole sequences of ``capacity`` and a rest. Documents are dealt to
    random groups (by a hash of id and text hash) of about ``group_docs``; in each group the rests are packed by
    first_fit_decreasing(). Sequence ids are the group's number times 2**32 plus the bin's. A null or empty text is
    ``end_id`` alone. Rows with equal ids, or none, are packed each. An empty table gives no piece. Group sizes follow
    the parameter, not the input, and what is shuffled is a few integers a piece, never texts or ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows, start, length, crc, total = array("q"), array("q"), array("q"), array("q"), array("q")
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    to = min(n, at + capacity)
                    rows.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(ids[4 * at : 4 * to])), total.append(n)
            take = pa.array(np.frombuffer(rows, np.int64)) if rows else pa.array([], pa.int64())
            columns = [b.column(0).take(take), b.column(2).take(take), *(pa.array(np.frombuffer(x, np.int64) if x else [], pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_deal", "start", "length", "ids_crc32", "doc_tokens"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_deal", "doc_id", "start"], kind="stable").reset_index(drop=True)
        bins = np.array(first_fit_decreasing(group["length"].tolist(), capacity), np.int64)
        number = np.unique(bins, return_inverse=True)[1]
        group["sequence_id"] = (group["_group"].to_numpy() << 32) + number
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    groups = max(1, -(-df.count() // group_docs))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_deal"))
    pieces = rows.mapInArrow(cut, f"doc_id {kind}, _deal long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = pieces.withColumn("_group", F.pmod(F.col("_deal"), F.lit(groups)))
    out = pieces.groupBy("_group").applyInPandas(pack, _PIECES.format(kind=kind) + ", sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
