"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each sees the words of the text and the probabilities of
the categories before it. In training those probabilities are out-of-fold predictions, so that a later model learns from
what it will get. Words are runs of letters (any byte beyond ASCII is one), A-Z as a-z; they are seen whole and by their first
bytes, so that inflected forms share evidence, and are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import ByteSums, bounded_batches, mixed, slices, spans, staged, utf8
from quizloom.llm.linear import dual_coordinate_descent, platt
from quizloom.llm.quality import labelled_texts

#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: A feature counts if several training texts have it and the log-likelihood ratio (G) of its counts in the two classes reaches this:
#: by chance one in a thousand does. Five texts of either class are enough for that.
LEAST_TEXTS, LEAST_G = 3, 10.8
FOLDS = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By blocks of whole texts: (number of the first, text number there, feature) of each distinct feature of each text."""
    for a, z in slices(offsets):
        own, begins = data[offsets[a] : offsets[z]], offsets[a:z] - offsets[a]
        start, end = spans(_LETTER[own], begins)
        if not len(start):
            continue
        sums, row = ByteSums(own), np.searchsorted(begins, start, "right") - 1
        found = [(row, sums.run(start, end))]
        for n in BEGINNINGS:
            longer = np.flatnonzero(end - start > n)
            found.append((row[longer], mixed(sums.run(start[longer], start[longer] + n) + np.uint64(n))))
        row, feature = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((feature, row))
        row, feature = row[order], feature[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
        yield a, row[fresh], feature[fresh]


@dataclass
class Link:
    """One category's model over the telling features of the sample."""

    name: str
    weight: np.ndarray  # by feature
    bias: float
    earlier: np.ndarray  # by category before
    a: float = 1.0
    b: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -50, 50)))


@dataclass
class Chain:
    features: np.ndarray  # sorted hashes
    links: list[Link]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of probabilities along the chain for each text."""
        n = len(offsets) - 1
        sums = np.zeros((n, len(self.links)))
        if len(self.features):
            weight = np.stack([link.weight for link in self.links], 1)
            for a, row, feature in text_features(data, offsets):
                at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
                known = self.features[at] == feature
                for k in range(len(self.links)):
                    some = np.bincount(row[known], weight[at[known], k])
                    sums[a : a + len(some), k] += some
        out = np.zeros((n, 0))
        for k, link in enumerate(self.links):
            out = np.column_stack([out, link.probability(sums[:, k] + link.bias + out @ link.earlier)])
        return out


def _g(a, b, n1, n0):
    """G of the tables of texts with (a of n1, b of n0) and without a feature."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p = (a + b) / max(n1 + n0, 1)
    total = np.zeros_like(a)
    for seen, expected in ((a, n1 * p), (b, n0 * p), (n1 - a, n1 * (1 - p)), (n0 - b, n0 * (1 - p))):
        total += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return 2 * total


@dataclass
class Sample:
    """The bounded training sample: of each text its fold, its labels and which of the telling features it has; and the features' counts."""

    fold: np.ndarray
    positive: list[np.ndarray]  # by category
    sets: list[np.ndarray]  # places in features
    features: np.ndarray  # sorted hashes
    counts: np.ndarray  # by feature, fold and 0 (texts) or 1 + category (texts with that label)


def _telling(counts: np.ndarray, totals: np.ndarray, category: int, out: int | None) -> np.ndarray:
    """Which features tell a category from the rest, by the texts outside fold ``out``."""
    inside = [k for k in range(FOLDS) if k != out]
    n, n1 = totals[inside, 0].sum(), totals[inside, 1 + category].sum()
    seen, a = counts[:, inside, 0].sum(1), counts[:, inside, 1 + category].sum(1)
    return (seen >= LEAST_TEXTS) & (_g(a, seen - a, n1, n - n1) > LEAST_G)


def gather(sample: DataFrame, id_col: str, text_col: str, categories: list[tuple[str, str, int]]) -> Sample:
    """Count features where the texts lie, sum the counts by feature, keep those that tell any category in any folds, and only then fetch which text has which.

    What comes to the driver is the telling features and their places by text, not the texts' words.
    """
    names = [f"y{k}" for k in range(len(categories))]
    labels = [F.coalesce((F.col(c) == yes).cast("int"), F.lit(0)).alias(y) for y, (_, c, yes) in zip(names, categories, strict=True)]
    rows = staged(sample.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(FOLDS)).cast("int").alias("fold"), *labels), "toxic-sample")
    width = 1 + len(names)
    totals = np.zeros((FOLDS, width), np.int64)
    for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in names]).collect():
        totals[r["fold"]] = [r["n"], *(r[y] for y in names)]
    counted = [f"c{k}" for k in range(FOLDS * width)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(1).to_numpy()
            marks = np.stack([np.ones(b.num_rows, np.int64), *(c.to_numpy() for c in b.columns[2:])], 1)
            for a, row, feature in text_features(*utf8(b.column(0))):
                distinct, place = np.unique(feature, return_inverse=True)
                found = np.zeros((len(distinct), FOLDS, width), np.int32)
                np.add.at(found, (place, fold[a + row]), marks[a + row])
                columns = found.reshape(len(distinct), -1)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *(pa.array(columns[:, k].copy()) for k in range(columns.shape[1]))], names=["f", *counted])

    summed = rows.select("text", "fold", *names).mapInArrow(count, "f long, " + ", ".join(f"{c} int" for c in counted)).groupBy("f").agg(*[F.sum(c).alias(c) for c in counted])
    summed = summed.where(sum(F.col(f"c{k * width}") for k in range(FOLDS)) >= LEAST_TEXTS)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([c.to_numpy() for c in b.columns[1:]], 1).reshape(-1, FOLDS, width)
            good = np.zeros(len(counts), bool)
            for c in range(width - 1):
                for out in (None, *range(FOLDS)):
                    good |= _telling(counts, totals, c, out)
            yield b.filter(pa.array(good))

    kept = summed.mapInArrow(test, summed.schema).toPandas()
    features = kept["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(features)
    features, counts = features[order], kept[counted].to_numpy(np.int64).reshape(-1, FOLDS, width)[order]
    held = rows.sparkSession.sparkContext.broadcast(features)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            n, has = np.zeros(b.num_rows, np.int64), [np.zeros(0, np.int64)]
            for a, row, feature in text_features(*utf8(b.column(1))):
                at = np.searchsorted(known, feature)
                ok = known[np.minimum(at, len(known) - 1)] == feature if len(known) else np.zeros(len(at), bool)
                some = np.bincount(row[ok])
                n[a : a + len(some)] += some
                has.append(at[ok])
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(has), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], found], names=["id", "fold", *names, "has"])

    got = rows.select("id", "text", "fold", *names).mapInArrow(pick, "id string, fold int, " + "".join(f"{y} int, " for y in names) + "has array<int>").toPandas().sort_values("id", kind="stable")
    return Sample(got["fold"].to_numpy(), [(got[y] == 1).to_numpy() for y in names], [np.array(h, np.int64) for h in got["has"]], features, counts)


def fit(name: str, sample: Sample, category: int, before: np.ndarray, out: int | None) -> Link:
    """One linear model from the texts outside fold ``out``: telling features scaled by their log ratios, and the earlier probabilities."""
    n_features, n_before = len(sample.features), before.shape[1]
    own = np.flatnonzero(sample.fold != (-1 if out is None else out))
    positive = sample.positive[category][own]
    n1, n0 = int(positive.sum()), int((~positive).sum())
    if not n1 or not n0:
        return Link(name, np.zeros(n_features), 30.0 if n1 else -30.0, np.zeros(n_before))
    inside = [k for k in range(FOLDS) if k != out]
    totals = np.zeros((FOLDS, 2 + category), np.int64)
    totals[inside[0], 0], totals[inside[0], 1 + category] = n1 + n0, n1
    good = np.flatnonzero(_telling(sample.counts, totals, category, out)) if n_features else np.zeros(0, np.int64)
    seen, a = sample.counts[good][:, inside, 0].sum(1), sample.counts[good][:, inside, 1 + category].sum(1)
    scale = (np.log((a + 0.5) / (n1 + 1)) - np.log((seen - a + 0.5) / (n0 + 1))) / 3.0
    number = np.full(n_features + 1, -1)
    number[good] = np.arange(len(good))
    rows = []
    for i in own:
        at = number[sample.sets[i]]
        at = at[at >= 0]
        rows.append((np.concatenate([at, len(good) + np.arange(n_before)]), np.concatenate([scale[at], before[i]])))
    cost = np.where(positive, (n1 + n0) / 2 / n1, (n1 + n0) / 2 / n0)
    w = dual_coordinate_descent(rows, np.where(positive, 1.0, -1.0), len(good) + n_before, cost)
    weight = np.zeros(n_features)
    weight[good] = w[: len(good)] * scale
    return Link(name, weight, float(w[-1]), w[len(good) : -1])


def out_of_fold(name: str, sample: Sample, category: int, before: np.ndarray) -> np.ndarray:
    """Each text's margin by the model that has not seen its fold."""
    held = np.zeros(len(sample.sets))
    for out in range(FOLDS):
        link = fit(name, sample, category, before, out)
        for i in np.flatnonzero(sample.fold == out):
            held[i] = link.weight[sample.sets[i]].sum() + link.bias + before[i] @ link.earlier
    return held


def train_chain(sample: Sample, categories: list[tuple[str, str, int]]) -> Chain:
    """Models in the order of the chain; each learns from the out-of-fold probabilities of those before it."""
    before, links = np.zeros((len(sample.sets), 0)), []
    for c, (name, _, _) in enumerate(categories):
        held = out_of_fold(name, sample, c, before)
        link = fit(name, sample, c, before, None)
        link.a, link.b = platt(held, np.where(sample.positive[c], 1, -1)) if len(held) else (1.0, 0.0)
        links.append(link)
        before = np.column_stack([before, link.probability(held)])
    return Chain(sample.features, links)


def chain_probabilities(df: DataFrame, chain: Chain, text_col: str) -> DataFrame:
    """All columns of ``df`` and ``_p``, the probabilities along the chain. Only the text goes to the Python workers."""
    held = df.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf("array<double>")
    def probabilities(text: pa.Array) -> pa.Array:
        found = held.value.probabilities(*utf8(text))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "_p"], probabilities(F.col(text_col).cast("string")).alias("_p"))


#: The chain over the labels at hand: low quality first, then toxicity.
CATEGORIES = [("low_quality", "quality", 0), ("toxic", "toxic", 1)]


def toxicity_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: list[tuple[str, str, int]] = CATEGORIES, balance: str = "toxic",
    most_docs: int = 12000, train: Column | None = None,
) -> DataFrame:
    """All columns of ``df`` and ``_p``: an array with the probability of each category of the chain, the last being the chain's aim.

    A column ``_p`` of ``df`` is replaced. At most about ``most_docs`` labelled texts are learned from, half of each value of ``balance``; null labels of other
    categories count as no; of repeated labels of an id the least counts. A null text is an empty one. Without labels (or with one class) a category's probability is
    near that class. One pass over the texts, no shuffle of them; rows with equal or null ids each give their row. An empty
    table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    columns = list(dict.fromkeys(c for _, c, _ in categories))
    sample = labelled_texts(df, labels, id_col, text_col, columns, balance, most_docs, train if train is not None else F.lit(True))
    return chain_probabilities(df, train_chain(gather(sample, id_col, "_text", categories), categories), text_col)
