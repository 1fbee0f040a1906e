"""Language identification by prediction by partial matching (PPM).

For each language a context tree of bytes (orders 0 to 3) is counted over labelled texts. A byte costs -log2 of its
frequency in the longest known context, or the escape of that context (method C: distinct followers count as escapes) and
then its cost in the next shorter one, down to one of 256. A text goes to the language that codes it in the fewest bits. The
statistics are frozen after training, so each cost is a constant: all costs stand in one table of fixed-point
numbers, and a text's code length is an exact integer sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import fold_of, slices, utf8

ORDER = 3
#: Bits are counted in units of 2**-16.
UNIT = 1 << 16
_PAD = 10  # what stands before a text: as if each began a line


@dataclass
class ContextTrees:
    languages: list[str]
    symbol: np.ndarray  # byte to symbol; all bytes that training has not seen share the last one, as they cost the same
    base: np.ndarray  # symbols of an order-3 context, as one number, to the first row of its costs
    cost: np.ndarray  # a row for each known context and symbol: units by language


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ORDER pad bytes before each, and the place of each byte there."""
    n = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(n) + 1), n)
    out = np.full(len(data) + ORDER * len(n), _PAD, np.uint8)
    out[at] = data
    return out, at


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, most_docs: int, train: Column | None = None) -> DataFrame:
    """At most about ``most_docs`` labelled rows, as many of each language, chosen by a hash of the id: (lang, text)."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if train is not None:
        rows = rows.where(train)
    n = {r["lang"]: r["count"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()}
    part = F.lit(0.0)
    for lang, count in n.items():
        part = F.when(F.col(lang_col).cast("string") == lang, F.lit(min(1.0, most_docs / len(n) / count))).otherwise(part)
    rows = rows.where(F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) < part * (1 << 30))
    return rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def train_context_trees(rows: DataFrame) -> ContextTrees | None:
    """Count (lang, text) rows where they lie; only n-gram counts of the bounded sample come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            parts = []
            for lang in dict.fromkeys(langs):
                data, at = _padded(*utf8(b.column(1).filter(pa.array(langs == lang))))
                code = np.zeros(len(at), np.int64)
                for k in range(ORDER + 1):
                    code |= data[at - k].astype(np.int64) << (8 * k)
                    grams, n = np.unique(code, return_counts=True)
                    parts.append(pd.DataFrame({"lang": lang, "k": k, "gram": grams, "n": n}))
            if parts:
                yield pa.RecordBatch.from_pandas(pd.concat(parts), preserve_index=False)

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, k long, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return None
    languages = sorted(counted["lang"].unique())
    seen = np.union1d(counted[counted["k"] == 0]["gram"].unique(), [_PAD]).astype(np.int64)
    size = len(seen) + 1
    symbol = np.full(256, size - 1, np.int64)
    symbol[seen] = np.arange(size - 1)
    grams = counted["gram"].to_numpy()
    # As numbers in base ``size``, the oldest byte first.
    index = np.zeros(len(counted), np.int64)
    for back in range(ORDER, -1, -1):
        index = index * size + np.where(back <= counted["k"].to_numpy(), symbol[(grams >> (8 * back)) & 255], 0)
    counted["index"] = index
    top = counted[counted["k"] == ORDER]
    contexts = np.unique(top["index"].to_numpy() // size)  # of order 3, seen in any language
    n_short = size ** (ORDER - 1)
    n_short_rows = n_short * size
    base = np.arange(size**ORDER, dtype=np.int64) % n_short * size  # an unknown context is read as its order-2 suffix
    base[contexts] = n_short_rows + np.arange(len(contexts)) * size
    cost = np.empty((n_short_rows + len(contexts) * size, len(languages)), np.int32)
    for k_lang, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        lengths = np.full((1, size), 8.0)  # bits of each symbol in the empty context of order -1
        for k in range(ORDER + 1):
            rows_k = own[own["k"] == k]
            ctx, sym, n = rows_k["index"].to_numpy() // size, rows_k["index"].to_numpy() % size, rows_k["n"].to_numpy().astype(float)
            if k < ORDER:
                longer = np.arange(size**k)
                shorter = lengths[longer % max(1, len(lengths))].copy()
                place = ctx
            else:
                shorter = lengths[contexts % len(lengths)].copy()
                place = np.searchsorted(contexts, ctx)
            total = np.bincount(place, n, len(shorter))
            distinct = np.bincount(place, minlength=len(shorter))
            known = total > 0
            shorter[known] += -np.log2(distinct[known] / (total + distinct)[known])[:, None]
            shorter[place, sym] = -np.log2(n / (total + distinct)[place])
            if k == ORDER - 1:
                cost[:n_short_rows, k_lang] = np.rint(shorter.reshape(-1) * UNIT)
            if k == ORDER:
                cost[n_short_rows:, k_lang] = np.rint(shorter.reshape(-1) * UNIT)
            lengths = shorter
    return ContextTrees(languages, symbol, base.astype(np.int32), cost)


def code_lengths(trees: ContextTrees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Units of code length of each text by language."""
    out = np.zeros((len(offsets) - 1, len(trees.languages)), np.int64)
    size = int(trees.symbol.max()) + 1
    for a, z in slices(offsets):
        own = offsets[a : z + 1] - offsets[a]
        padded, at = _padded(data[offsets[a] : offsets[z]], own)
        s = trees.symbol[padded].astype(np.int32)
        context = (s[at - 3] * size + s[at - 2]) * size + s[at - 1]
        costs = trees.cost[trees.base[context] + s[at]]
        full = np.flatnonzero(np.diff(own))
        if len(full):
            out[a + full] = np.add.reduceat(costs, own[full], axis=0, dtype=np.int64)
    return out


def identify(df: DataFrame, trees: ContextTrees | None, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, ``keep``, lang_pred, score: the language of the least code length, and its posterior under equal priors."""
    held = df.sparkSession.sparkContext.broadcast(trees)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for b in batches:
            n = b.num_rows
            if trees is None:
                lang, score = pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))
            else:
                units = code_lengths(trees, *utf8(b.column(1))) / UNIT
                best = units.argmin(1)
                share = np.exp2(-np.minimum(units - units.min(1, keepdims=True), 1000))
                lettered = np.array(b.column(2).to_pylist(), bool)
                lang = pa.array(np.where(lettered, np.array(trees.languages, object)[best], "und"), pa.string())
                score = pa.array(np.where(lettered, 1 / share.sum(1), 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], lang, score], names=[id_col, *keep, "lang_pred", "score"])

    text = F.col(text_col)
    rows = df.select(F.col(id_col), text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_lettered"), *keep)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [id_col, *keep])
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 6000) -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text modulo 3 is 1), lang_pred, score.

    Trained on at most about ``most_docs`` rows with a language that are not held out, as many of each language; predictions see the text alone.
    A null text, an empty one and one without a letter are ``und`` with score 0; so is all if nothing can be learned from.
    Ties go to the first language by name. Rows with equal or null ids each give their row; null ids are never held out.
    """
    train = F.coalesce(fold_of(id_col), F.lit(0)) != 1
    trees = train_context_trees(training_rows(df, id_col, text_col, lang_col, most_docs, train))
    rows = df.select(id_col, text_col).withColumn("held_out", F.coalesce(fold_of(id_col) == 1, F.lit(False)))
    return identify(rows, trees, id_col, text_col, ["held_out"])
