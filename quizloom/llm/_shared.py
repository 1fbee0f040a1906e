"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where the session names none (tests in local mode) is a folder of this machine made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch on its way to a Python worker, where the session names no bound: rows may be very long.
BATCH_BYTES = "2m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, unless it has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fold_of(id_col: str) -> Column:
    """crc32 of the id written as text, modulo 3; null ids have no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


#: Bytes of texts that a Python worker works on at once: its arrays take some 50 times that.
SLICE_BYTES = 1 << 18


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Runs of rows whose bytes together stay near ``most``; a longer row is a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


# Odd multipliers of the polynomial hashes below, with their inverses modulo 2**64.
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps between batches; those for a single longer text are made anew.
HELD_POWERS = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n + n // 4, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if len(held) <= HELD_POWERS:
            _powers[base] = held
    return held[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class ByteSums:
    """Hashes of any run of bytes (A-Z as a-z) in constant time."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, len(data)), out=self.total[1:])
        self.shift = powers(inverse(_BYTE_BASE), len(data))

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.shift[start] + (end - start).astype(np.uint64))


def spans(inside: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes; none crosses a place in ``begins``, where a row begins."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(inside) + 1, bool)  # whether a run that has this byte can't go on from the one before
    np.logical_not(inside[:-1], out=fresh[1:-1])
    fresh[begins[begins < len(inside)]] = True
    return np.flatnonzero(inside & fresh[:-1]), np.flatnonzero(inside & (fresh[1:] | np.append(~inside[1:], True))) + 1


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return _SPACE[data]


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of these bytes, A-Z as a-z.

    ``begins``: where the rows begin that stand here one after the other; no word crosses such a place.
    """
    start, end = spans(~_SPACE[data], begins)
    return start, end, ByteSums(data).run(start, end) if len(start) else np.zeros(0, np.uint64)


class WordSums:
    """Hashes of any run of words in constant time: prefix sums of word hash times a power of the word's place."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * powers(_WORD_BASE, max(self.n, 1))[: self.n], out=self.total[1:])
        self.back = powers(inverse(_WORD_BASE), self.n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The sum over words start .. end - 1, moved to place 0."""
        return (self.total[end] - self.total[start]) * self.back[start]

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end) + (np.asarray(end) - np.asarray(start)).astype(np.uint64))

    def without(self, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """As run(), for the words start .. end - 1 but ``gone``."""
        left = (self.total[gone] - self.total[start]) * self.back[start]
        right = (self.total[end] - self.total[gone + 1]) * self.back[start + 1]
        return mixed(left + right + (end - start - 1).astype(np.uint64))


_PRIME, _PRIME_BASES = (1 << 31) - 1, (48271, 69621)
_prime_powers: dict[int, np.ndarray] = {}


def prime_powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**31 - 1, by doubling."""
    held = _prime_powers.get(base)
    if held is None or len(held) < n:
        held = np.ones(1, np.int64)
        while len(held) < max(n, 1 << 16):
            held = np.concatenate([held, held * pow(base, len(held), _PRIME) % _PRIME])
        if n <= HELD_POWERS:
            _prime_powers[base] = held
    return held[:n]


class PrimeSums:
    """A second, unlike hash (31 bits, modulo a prime) of any run of words, given the bytes and where the words start and end; A-Z as a-z."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.bytes = self._sums(_LOWER[data].astype(np.int64) + 1, 0)
        self.words = self._sums(self._run(self.bytes, 0, start, end) + 1, 1)

    @staticmethod
    def _sums(values: np.ndarray, which: int) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values % _PRIME * prime_powers(_PRIME_BASES[which], max(len(values), 1))[: len(values)] % _PRIME, out=total[1:])
        return total

    @staticmethod
    def _run(total: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = prime_powers(pow(_PRIME_BASES[which], -1, _PRIME), len(total))
        return (total[end] - total[start]) % _PRIME * back[start] % _PRIME

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._run(self.words, 1, start, end)
