"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

Each unit vector is rotated at random into at least CODE_BITS dimensions and kept as the signs there (its code) and the inner product of
the rotated vector with its own code (its correction factor). The code's inner product with another rotated vector (kept in
8 bits a coordinate), divided by the factor, estimates the cosine without bias, with an error bound that the factor
gives. Vectors meet in buckets: bands of the signs of further rotations, so many that a pair at the threshold shares a band with a
chosen probability. The pairs that meet bring only codes; those whose upper confidence bound reaches the threshold fetch their
vectors and are computed anew in double precision; only these can link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import mixed, staged
from quizloom.llm.components import components

#: Bits of a code; vectors of more dimensions have codes of their next power of two.
CODE_BITS = 512
#: Standard errors of the estimate that a pair may fall short of the threshold by and still be computed exactly.
ERRORS = 4.5
#: Up to so many dimensions a rotation is a matrix; beyond, sign flips and Hadamard transforms, which need no matrix.
MATRIX_DIMS = 2048
#: Numbers held at once while a batch of vectors is rotated.
_HELD = 1 << 20


def code_bits(dims: int) -> int:
    return max(CODE_BITS, 1 << max(0, dims - 1).bit_length())


def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """dims orthonormal rows in ``bits`` dimensions: a random rotation of vectors padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dims)))
    return (q * np.sign(np.diag(r))).T


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix, by halves."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Rotation:
    """A random rotation of vectors of ``dims`` components, padded with zeros, in ``bits`` dimensions."""

    def __init__(self, dims: int, bits: int, seed: int):
        self.bits, self.matrix = bits, rotation(dims, bits, seed) if dims <= MATRIX_DIMS else None
        self.flips = None if self.matrix is not None else np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, bits))

    def turn(self, unit: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return unit @ self.matrix
        x = np.pad(unit, ((0, 0), (0, self.bits - unit.shape[1])))
        for signs in self.flips:
            x = _hadamard(x * signs)
        return x


def band_plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a band, about log2(16 n), so that unrelated vectors rarely meet; and bands, so that a pair at the threshold misses all with probability ``miss``."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) + 4)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and those as unit vectors of ``dims`` components in double precision (shorter ones end in zeros)."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(n)])
    bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
    ok = (n > 0) & (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
    out = np.zeros((int(ok.sum()), dims))
    row = np.repeat(np.cumsum(ok) - 1, n)
    own = np.repeat(ok, n)
    out[row[own], (np.arange(len(flat)) - np.repeat(ends[:-1], n))[own]] = flat[own]
    out /= np.abs(out).max(1, keepdims=True) if len(out) else 1.0
    return ok, out / np.sqrt((out * out).sum(1, keepdims=True))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    raw = np.ascontiguousarray(rows)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * (raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1))
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """The matrix of a column of bytes of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def quantised(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated vectors in 8 bits a coordinate, and each one's step."""
    step = np.maximum(np.abs(turned).max(1), 1e-300) / 127
    return np.rint(turned / step[:, None]).astype(np.int8), step


def _encode(dims: int, seed: int, bits: int, bands: int):
    size = code_bits(dims)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = Rotation(dims, size, seed)
        further = [Rotation(dims, size, seed + 1 + k) for k in range(-(-bands * bits // size))]
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        most = max(1, _HELD // size)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                b = batch.slice(at, most)
                ok, unit = unit_rows(b.column(1), dims)
                turned = turn.turn(unit)
                query, step = quantised(turned)
                signs = np.concatenate([r.turn(unit) > 0 for r in further], axis=1)[:, : bands * bits].reshape(-1, bands, bits)
                keys = mixed((signs * weights).sum(2, dtype=np.uint64) + salt)
                ends = pa.array(np.arange(len(unit) + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).filter(pa.array(ok)), _binary(unit), _binary(np.packbits(turned > 0, axis=1)), pa.array(np.abs(turned).sum(1) / math.sqrt(size)), _binary(query), pa.array(step), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).reshape(-1)))],
                    names=["v", "unit", "code", "factor", "query", "step", "bands"],
                )

    return make


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, v) of a task: the pairs of each run, by distance in the run, so that memory holds one run and its pairs one step at a time."""
    held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(key, v):
        found, size = [], 0
        for d in range(1, len(key)):
            same = key[d:] == key[:-d]
            if not same.any():
                break
            found.append(np.stack([v[:-d][same], v[d:][same]], 1))
            size += len(found[-1])
            if size > 1 << 18:
                yield np.unique(np.concatenate(found), axis=0)
                found, size = [], 0
        if found:
            yield np.unique(np.concatenate(found), axis=0)

    def batch(p) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    for b in batches:
        key, v = np.concatenate([held_k, b.column(0).to_numpy()]), np.concatenate([held_v, b.column(1).to_numpy()])
        last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
        yield from map(batch, pairs(key[:last], v[:last]))
        held_k, held_v = key[last:], v[last:]
    yield from map(batch, pairs(held_k, held_v))


def estimates(query: np.ndarray, step: np.ndarray, code: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated vectors (quantised) with coded ones, and how far each may be off."""
    size = query.shape[1]
    signs = np.unpackbits(code, axis=1, count=size).astype(np.int8) * 2 - 1
    estimate = np.einsum("ij,ij->i", query, signs, dtype=np.int64) * step / math.sqrt(size) / factor
    error = ERRORS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (size - 1)) + step / 2 * math.sqrt(size) / factor
    return estimate, error


def _likely(threshold: float):
    """Rows (a, b, query_a, step_a, code_b, factor_b): the pairs whose upper confidence bound reaches the threshold."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                estimate, error = estimates(_matrix(b.column(2), np.int8), b.column(3).to_numpy(), _matrix(b.column(4), np.uint8), b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(estimate + error >= threshold))

    return make


def _decide(threshold: float):
    """Rows (a, b, unit_a, unit_b): those whose cosine in double precision reaches the threshold."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                exact = (_matrix(b.column(2), np.float64) * _matrix(b.column(3), np.float64)).sum(1)
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(exact >= threshold))

    return make


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.95, miss: float = 1e-4, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    Two vectors link when they meet and their cosine, in double precision, is at least ``threshold``; a pair at the
    threshold is missed with probability ``miss``, a closer one more rarely. Identical vectors are one class: they
    link with each other, and are compared once. component_id is the smallest id reachable by links; kept marks it. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing and are kept. Vectors of fewer dimensions than the longest end in zeros.
    Rows with a null id get null component and are not kept. An id that is repeated is one vertex: of its usable vectors one
    (the first by digest) counts, and each of its rows gets the same values. Other columns play no part. An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    vectors = df.select(F.col(id_col).cast("long").alias("v"), F.col(vector_col).alias("_x")).where("v is not null")
    shape = vectors.agg(F.max(F.size("_x")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    dims, n = max(1, shape["dims"] or 1), shape["n"]
    bits, bands = band_plan(n, threshold, miss)
    digest = F.sha2(F.concat_ws(",", F.transform("_x", lambda e: F.coalesce(e.cast("string"), F.lit("~")))).cast("binary"), 256)
    usable = F.coalesce((F.size("_x") > 0) & ~F.exists("_x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("_x", lambda e: e != 0), F.lit(False))
    keyed = staged(vectors.groupBy("v").agg(F.min(F.when(usable, digest)).alias("digest")), "digests")
    classes = staged(keyed.where("digest is not null").groupBy("digest").agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    heads = vectors.withColumn("digest", F.when(usable, digest)).join(classes.select(F.col("rep").alias("v"), "digest"), ["v", "digest"], "left_semi").dropDuplicates(["v"]).select("v", "_x")
    codes = staged(heads.mapInArrow(_encode(dims, seed, bits, bands), "v long, unit binary, code binary, factor double, query binary, step double, bands array<long>"), "codes")
    buckets = codes.select(F.explode("bands").alias("key"), "v").repartition("key").sortWithinPartitions("key", "v")
    pairs = buckets.mapInArrow(_pairs, "a long, b long").distinct()
    coded = pairs.join(codes.select(F.col("v").alias("a"), "query", "step"), "a").join(codes.select(F.col("v").alias("b"), "code", "factor"), "b")
    likely = coded.select("a", "b", "query", "step", "code", "factor").mapInArrow(_likely(threshold), "a long, b long")
    sides = likely.join(codes.select(F.col("v").alias("a"), F.col("unit").alias("unit_a")), "a").join(codes.select(F.col("v").alias("b"), F.col("unit").alias("unit_b")), "b")
    links = staged(sides.select("a", "b", "unit_a", "unit_b").mapInArrow(_decide(threshold), "a long, b long"), "links")

    joined = components(links)
    copies = classes.select(F.col("rep").alias("b"), "copies")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    classes = classes.join(counts, "rep", "left").join(joined.withColumnRenamed("v", "rep"), "rep", "left")
    per_id = keyed.join(classes, "digest", "left").select(F.col("v").alias("_v"), (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "rep", "v").alias("component_id"))
    out = df.select(F.col(id_col)).join(per_id, F.col(id_col).cast("long") == F.col("_v"), "left")
    return out.select(F.col(id_col).cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col(id_col).cast("long") == F.col("component_id"), F.lit(False)).alias("kept"))
