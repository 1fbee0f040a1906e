"""Token counts of whole texts under a sentencepiece BPE model, with a whole-token shortcut.

The library counts a text by merging its characters. Two facts about the vocabulary, proved from the model before any text
is read, make that additive over short pre-tokens: no piece has the space mark behind another character, and no piece of
several characters holds a line feed; so no merge crosses those places (the library writes a space as the space mark, so a
literal U+2581 in a text is a space here too). Further, the strings of the vocabulary that
encode alone as one token are listed once; a pre-token among them counts 1 without any merge, and only the rest is merged
by the library (and remembered, up to a bound).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
#: Pre-tokens that a worker remembers besides the proven ones: some 130 bytes each.
REMEMBERED = 1_000_000


def prove(model_file: str) -> list[str]:
    """The pre-tokens that are one token, by encoding each string of the vocabulary alone; raises if merges could cross pre-tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    for _, piece in pieces:
        if "▁" in piece.lstrip("▁") or (len(piece) > 1 and "\n" in piece):
            raise ValueError(f"merges can cross pre-tokens: {piece!r}")
    if sp.encode("a  b\n c", out_type=str)[:2] != ["▁a", "▁"] or len(sp.encode("\n")) != 2:
        raise ValueError("this model's normaliser changes white space; pre-tokens are not additive")
    marked = [(i, p) for i, p in pieces if p.startswith("▁")]
    bare = [(i, p) for i, p in pieces if not p.startswith("▁")]
    alone = sp.encode([p[1:].replace("▁", " ") for _, p in marked], num_threads=1)
    behind = sp.encode(["\n" + p for _, p in bare], num_threads=1)
    proven = [p.replace("▁", " ") for (i, p), ids in zip(marked, alone, strict=True) if ids == [i]]
    return proven + [p for (i, p), ids in zip(bare, behind, strict=True) if ids[2:] == [i]]


class _Counts(dict):
    """Pre-token to tokens."""

    def __init__(self, model_file: str, proven: list[str]):
        import sentencepiece

        super().__init__(dict.fromkeys(proven, 1))
        self.sp, self.proven = sentencepiece.SentencePieceProcessor(model_file=model_file), proven
        self["\n"] = len(self.sp.encode("\n")) - 1

    def __missing__(self, unit: str) -> int:
        # The library puts one space mark before any text: that is the unit's own, or else goes with the line feed.
        n = len(self.sp.encode(unit[1:])) if unit[0] == " " and len(unit) > 1 else 1 if unit == " " else len(self.sp.encode("\n" + unit)) - 2
        if len(self) > REMEMBERED + len(self.proven):
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
            self["\n"] = len(self.sp.encode("\n")) - 1
        self[unit] = n
        return n


_held: dict[str, _Counts] = {}


def _counter(model_file: str, proven: list[str]) -> _Counts:
    if model_file not in _held:
        _held[model_file] = _Counts(model_file, proven)
    return _held[model_file]


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens (no begin or end), over_limit.

    Special strings in a text are ordinary characters, as the library has it by default. A null or empty text has 0 bytes
    and 0 tokens. Rows with equal or null ids each give their row. No shuffle: one pass over id and text. ``model_file``
    is opened on the executors; the list of proven strings (at most the vocabulary) goes with the task.
    """
    proven = df.sparkSession.sparkContext.broadcast(prove(model_file))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(model_file, proven.value)
        get, cut = counts.__getitem__, _PRE_TOKEN.findall
        for b in batches:
            n = [sum(map(get, cut(" " + t.replace("▁", " ")))) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
