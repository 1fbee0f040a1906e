"""Quality scores by naive Bayes support vectors.

Indicators of hashed byte n-grams are scaled by the log ratio of their counts in the two classes; a linear hinge-loss model is fitted to
the scaled indicators by dual coordinate descent; a logistic curve over out-of-fold margins makes scores of margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import bounded_batches, fold_of, slices, utf8
from quizloom.llm.linear import dual_coordinate_descent, platt

#: N-gram lengths in bytes, and the number of indicators they are hashed to.
LENGTHS, BUCKETS = (2, 4), 1 << 18


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The set of hashed n-grams of each text (of its whole bytes)."""
    last = np.zeros(BUCKETS, np.int64)
    for a, z in slices(offsets):
        own = data[offsets[a] : offsets[z]].astype(np.uint64)
        codes = []
        for n in LENGTHS:
            code = np.full(max(len(own) - n + 1, 0), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + own[k : k + len(code)]
            codes.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64))
        for k in range(a, z):
            at, to = offsets[k] - offsets[a], offsets[k + 1] - offsets[a]
            found = np.concatenate([c[at : max(at, to - n + 1)] for c, n in zip(codes, LENGTHS, strict=True)])
            # One place of each distinct value, without sorting: the last to write its number there.
            order = np.arange(len(found))
            last[found] = order
            yield found[last[found] == order]


@dataclass
class QualityModel:
    weight: np.ndarray  # by n-gram, already times its log ratio
    bias: float
    a: float
    b: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = np.array([self.weight[f].sum() for f in features(data, offsets)]) + self.bias if len(offsets) > 1 else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.a * raw + self.b, -50, 50)))


def labelled_texts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], balance: str, most_docs: int, train: Column) -> DataFrame:
    """Texts with labels: at most about ``most_docs`` rows, half of each value of ``balance``, chosen by a hash of the id.

    Of repeated labels of an id the least value of each column counts.

    The chosen ids are picked from the labels alone, which are narrow; they are at most about ``most_docs`` rows, so they are broadcast
    to the texts, which are not shuffled.
    """
    usable = labels.select(F.col(id_col).alias("_id"), *label_cols).where(F.col("_id").isNotNull() & F.col(balance).isNotNull())
    usable = usable.groupBy("_id").agg(*[F.min(c).alias(c) for c in label_cols]).withColumnRenamed("_id", id_col).where(train)
    n = {r[balance]: r["count"] for r in usable.groupBy(balance).count().collect()}
    part = F.lit(0.0)
    for value, count in n.items():
        part = F.when(F.col(balance) == value, F.lit(min(1.0, most_docs / len(n) / count))).otherwise(part)
    chosen = usable.where(F.pmod(F.xxhash64(F.lit("labels"), F.col(id_col)), F.lit(1 << 20)) < part * (1 << 20))
    return df.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col).select(id_col, "_text", *label_cols)


def log_ratios(rows: list[np.ndarray], positive: np.ndarray, size: int) -> np.ndarray:
    counts = np.ones((2, size))
    for at, y in zip(rows, positive, strict=True):
        counts[int(y), at] += 1
    counts /= np.array([[(~positive).sum() + 2.0], [positive.sum() + 2.0]])
    return np.log(counts[1] / counts[0])


def _sent(found: np.ndarray) -> bytes:
    """A set of n-grams as 4 bytes each, or, where that is shorter, as a bitmap: BUCKETS / 8 bytes at most."""
    if len(found) < BUCKETS // 32:
        return np.sort(found).astype("<u4").tobytes()
    bits = np.zeros(BUCKETS, np.uint8)
    bits[found] = 1
    return np.packbits(bits).tobytes()


def _received(raw: bytes) -> np.ndarray:
    if len(raw) < BUCKETS // 8:
        return np.frombuffer(raw, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def train_quality(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_docs: int, train: Column) -> QualityModel | None:
    """Features are taken where the texts lie; the bounded sample's feature sets (32 KB a text at most) come to the driver, where the solver runs."""
    sample = labelled_texts(df, labels, id_col, text_col, [label_col], label_col, most_docs, train)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_sent(f) for f in features(*utf8(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2).cast(pa.int64()), pa.array(found, pa.binary())], names=["id", "y", "f"])

    got = sample.mapInArrow(take, "id string, y long, f binary").toPandas().sort_values("id", kind="stable")
    positive = got["y"].to_numpy() == 1
    if not len(got) or positive.all() or not positive.any():
        return None
    rows = [_received(f) for f in got["f"]]

    def fit(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights by feature, and the log ratios in them, from the rows ``own``."""
        ratio = log_ratios([rows[i] for i in own], positive[own], BUCKETS)
        scaled = [(rows[i], ratio[rows[i]]) for i in own]
        scale = 1 / max(1e-9, float(np.mean([v @ v for _, v in scaled]))) ** 0.5
        cost = np.where(positive[own], len(own) / 2 / max(1, positive[own].sum()), len(own) / 2 / max(1, (~positive[own]).sum()))
        w = dual_coordinate_descent([(at, v * scale) for at, v in scaled], np.where(positive[own], 1.0, -1.0), BUCKETS, cost)
        w[:-1] *= ratio * scale
        return w, ratio

    folds = np.arange(len(rows)) % 3
    held = np.zeros(len(rows))
    for k in range(3):
        own = np.flatnonzero(folds != k)
        if positive[own].all() or not positive[own].any():
            continue
        w, _ = fit(own)
        held[folds == k] = [w[rows[i]].sum() + w[-1] for i in np.flatnonzero(folds == k)]
    w, _ = fit(np.arange(len(rows)))
    a, b = platt(held, np.where(positive, 1, -1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), a, b)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = 4000) -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text modulo 3 is 1), score (0 to 1, high: label 1), predicted (0 or 1).

    Labels of held-out ids are never read. At most about ``most_docs`` labelled texts are learned from, half of each
    class; of repeated labels of an id the least counts, null labels none. A null text is scored as an empty one. Without labels of both
    classes each score is 0.5. Rows with equal or null ids each give their row; null ids are never held out.
    """
    bounded_batches(df.sparkSession)
    model = train_quality(df, labels, id_col, text_col, label_col, most_docs, F.coalesce(fold_of(id_col), F.lit(0)) != 1)
    held = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = held.value.scores(*utf8(b.column(2))) if held.value else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score.astype(float))], names=[id_col, "held_out", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.coalesce(fold_of(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
