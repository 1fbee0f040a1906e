"""Similarity self-join of documents on word shingles (Jaccard), exact, with signature trees.

1. One pass over the texts makes each document's set of shingle hashes, a digest of the set, a bitmap of it, and its prefix: of the set in
   one fixed order (shingles frequent in a bounded sample last, else by hash), so many first ones that two sets at the threshold
   must share one of them.
2. Documents with equal sets are one class; only the classes' smallest ids go on.
3. Classes meet in runs, one for each shingle of their prefixes. A run of a few classes is a single leaf: its pairs of fitting sizes
   are candidates if their bitmaps leave enough overlap, and are verified on their whole sets.
4. Over each longer run a signature tree is built: leaves hold sizes and bitmaps, inner nodes the range of sizes, the OR of
   the bitmaps and the largest number of elements that a set has beyond its bits. A dual traversal drops pairs of nodes whose
   largest possible overlap is too small, or that lie in one group of candidates already. What comes out is each class's
   group, one row a class, never the pairs.
5. Groups of all runs that share a class are one component of candidates; every link that meets in a long run lies in one. The
   classes of a component are dealt into blocks by ranges of sizes and by hash, and all pairs of blocks that can
   fit are compared on whole sets, each pair of blocks by a task of its own: it counts each class's links and names the least
   class that it reaches.
6. Links of both kinds make the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import WordSums, mixed, slices, staged, utf8, words
from quizloom.llm.components import components

#: Bits of a document's bitmap: the power of two from twice its set's size, within these bounds. Lengths that differ are made
#: equal by OR-ing the longer one's parts, as places are hashes modulo the length.
LEAST_BITS, MOST_BITS = 1024, 1 << 17
#: Runs of at most this many classes are one leaf, compared pair by pair.
SHORT_RUN = 24
#: A longer run, or a component of candidates, is dealt to several tasks by blocks of about so many classes and elements of sets at most.
BLOCK_ROWS, BLOCK_ELEMENTS = 512, 1 << 18
#: Documents of the sample whose frequent shingles come last in the order; it steers balance only, never the result.
SAMPLE_DOCS = 3000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: n consecutive words, or all words where there are fewer."""
    for a, z in slices(offsets):
        start, _, hashes = words(data[offsets[a] : offsets[z]], offsets[a:z] - offsets[a])
        sums = WordSums(hashes)
        bounds = np.searchsorted(start, offsets[a : z + 1] - offsets[a])
        all_ = sums.run(np.arange(max(len(hashes) - n + 1, 0)), np.arange(n, len(hashes) + 1)) if len(hashes) >= n else np.zeros(0, np.uint64)
        for k in range(z - a):
            w0, w1 = int(bounds[k]), int(bounds[k + 1])
            if w1 - w0 >= n:
                yield np.unique(all_[w0 : w1 - n + 1])
            elif w1 > w0:
                yield sums.run(np.array([w0]), np.array([w1]))
            else:
                yield np.zeros(0, np.uint64)


def least_overlap(size: np.ndarray | int, percent: int):
    """Of a set of this size, how many elements any set at the threshold must share with it at least."""
    return -(-np.asarray(size) * percent // 100)


def frequent_shingles(df: DataFrame, id_col: str, text_col: str, n: int) -> np.ndarray:
    """Shingles that several documents of a sample have (of about SAMPLE_DOCS documents, by a hash of the id), the rarest first."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    total = df.count()
    if total > SAMPLE_DOCS:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("shingles"), F.col(id_col)), F.lit(1 << 30)) < int(SAMPLE_DOCS / total * (1 << 30)))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(*utf8(b.column(0)), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])

    counted = rows.select(text_col).mapInArrow(take, "s long").groupBy("s").count().where("count >= 3").toPandas().sort_values(["count", "s"])
    return counted["s"].to_numpy(np.int64).view(np.uint64)


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that together stand for it."""
    if not len(s):
        return 0, 0
    folded = mixed(s)
    return int(np.bitwise_xor.reduce(folded)), int(np.add.reduce(mixed(folded + np.uint64(1))))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's bitmap as 64-bit words."""
    n = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length())) if len(s) else LEAST_BITS
    bits = np.zeros(n, np.uint8)
    bits[(mixed(s) >> np.uint64(40)).astype(np.int64) % n] = 1
    return np.packbits(bits).view(np.uint64)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))


def _prepare(percent: int, n: int, frequent):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        order = np.argsort(common)
        ranked = common[order]

        def prefix(s: np.ndarray) -> np.ndarray:
            keep = len(s) - int(least_overlap(len(s), percent)) + 1 if len(s) else 0
            if not len(ranked) or not len(s):
                return s[:keep]
            at = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
            known = ranked[at] == s
            if not known.any():
                return s[:keep]
            return s[np.lexsort((s, np.where(known, order[at] + 1, 0)))[:keep]]

        for b in batches:
            data, offsets = utf8(b.column(1))
            for a, z in slices(offsets, 1 << 20):
                size, ids, prefixes, maps = [], [], [], []
                for s in shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], n):
                    size.append(len(s)), ids.append(digests(s)), prefixes.append(prefix(s)), maps.append(bitmap(s).tobytes())
                both = np.array(ids, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(size, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(maps, pa.binary()), _lists(prefixes)], names=["doc", "size", "d1", "d2", "bits", "prefix"]
                )

    return make


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal values in sorted ``keys``."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    cut = np.flatnonzero(fresh)
    return cut, np.append(cut[1:], len(keys[0]))


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _meet(percent: int):
    """Sorted rows (shingle, doc, size) of a task: pairs (a, b) of its short runs; of a long run its rows (b null)."""

    def short_pairs(key, doc, size) -> np.ndarray:
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, SHORT_RUN):
            same = key[d:] == key[:-d]
            if not same.any():
                break
            same &= (doc[d:] != doc[:-d]) & fits(size[d:], size[:-d], percent)
            found.append(np.stack([doc[:-d][same], doc[d:][same]], 1))
        both = np.concatenate(found)
        return np.unique(np.stack([both.min(1), both.max(1)], 1), axis=0) if len(both) else both

    def out(pairs, key, doc, size) -> pa.RecordBatch:
        n = len(pairs)
        nulls = pa.nulls(n, pa.int64())
        columns = [pa.array(np.concatenate([pairs[:, 0], doc])), pa.concat_arrays([pa.array(pairs[:, 1].copy()), pa.nulls(len(doc), pa.int64())]), pa.concat_arrays([nulls, pa.array(key)]), pa.concat_arrays([nulls, pa.array(size)])]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "shingle", "size"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = [np.zeros(0, np.int64)] * 3, None  # rows of a short run that may go on; the long run that may go on
        for b in batches:
            key, doc, size = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True))
            if not len(key):
                continue
            start, end = _runs(key)
            long = end - start > SHORT_RUN
            long[0] |= going is not None and key[0] == going
            upto = len(key) if long[-1] else start[-1]
            going = key[-1] if long[-1] else None
            in_long = np.repeat(long, end - start)[:upto]
            own = [x[:upto] for x in (key, doc, size)]
            yield out(short_pairs(*(x[~in_long] for x in own)), *(x[in_long] for x in own))
            held = [x[upto:] for x in (key, doc, size)]
        yield out(short_pairs(*held), *[np.zeros(0, np.int64)] * 3)

    return make


def bit_counts(x: np.ndarray) -> np.ndarray:
    """Set bits of each row of 64-bit words."""
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap OR-ed down to so many 64-bit words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _possible(percent: int):
    """Rows (a, b, size_a, bits_a, size_b, bits_b): the pairs (a, b) whose bitmaps leave the threshold possible."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            sizes = [b.column(k).to_numpy() for k in (2, 4)]
            (x, x_at), (y, y_at) = (_words_of(b.column(k)) for k in (3, 5))
            n = [np.diff(at) for at in (x_at, y_at)]
            for own, other in {tuple(p) for p in np.stack(n, 1).tolist()}:
                rows = np.flatnonzero((n[0] == own) & (n[1] == other))
                for some in np.array_split(rows, max(1, len(rows) * max(own, other) >> 17)):
                    sides = [w[at[some][:, None] + np.arange(k)] for w, at, k in ((x, x_at, own), (y, y_at, other))]
                    least = min(own, other)
                    p, q = (np.bitwise_or.reduce(s.reshape(len(some), -1, least), axis=1) for s in sides)
                    size_p, size_q = (s[some] for s in sizes)
                    most = bit_counts(p & q) + np.minimum(size_p - bit_counts(p), size_q - bit_counts(q))
                    ok[some] = (100 + percent) * most >= percent * (size_p + size_q)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return make


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a column of bitmaps one after the other, and the n + 1 places where they begin."""
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes(), np.uint64), (ends - ends[0]) // 8


class Groups:
    """Disjoint groups of 0 .. n - 1; a group's label is its least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Make the members i[k] and j[k] one group; whether anything changed."""
        changed, parent = False, np.arange(len(self.label))
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                return changed
            changed = True
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]


class SignatureTree:
    """Levels of nodes over sets: size ranges, OR of the bitmaps, and how many elements a set of the node has beyond its bits at most.

    Leaves stand in the order of their bitmaps, so that like sets are neighbours and the ORs stay sparse.
    """

    WIDTH = 4

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        first = bits[:, : min(4, bits.shape[1])].byteswap()
        self.order = np.lexsort(tuple(first[:, k] for k in range(first.shape[1] - 1, -1, -1)))
        size, bits = size[self.order], bits[self.order]
        self.levels = [(size, size, bits, size - bit_counts(bits))]
        self.visited = 0
        while len(self.levels[-1][0]) > 1:
            low, high, ors, beyond = self.levels[-1]
            cut = np.arange(0, len(low), self.WIDTH)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(ors, cut, axis=0), np.maximum.reduceat(beyond, cut)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether any set below node i can link with one below node j: no set shares more with another than the bits that both ORs have, and what it has beyond its own bits."""
        low, high, ors, beyond = self.levels[level]
        self.visited += len(i)
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        at = np.flatnonzero(ok)
        a, b = i[at], j[at]
        most = np.minimum(bit_counts(ors[a] & ors[b]) + np.minimum(beyond[a], beyond[b]), np.minimum(high[a], high[b]))
        ok[at] = (100 + percent) * most >= percent * (low[a] + low[b])
        return ok

    def groups(self, percent: int, matter: np.ndarray | None = None, block: int = 1 << 12) -> Groups:
        """Groups of sets that possible pairs join (by places in the input); a pair counts if one of its sets has ``matter``."""
        n = len(self.order)
        groups, matter = Groups(n), np.ones(n, bool) if matter is None else matter[self.order]

        def test(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if level == 0:
                i, j = (x[matter[i] | matter[j]] for x in (i, j))
            ok = self.possible(level, i, j, percent)
            return i[ok], j[ok]

        for d in range(1, min(n, self.WIDTH + 1)):  # neighbours first: then most pairs lie in one group
            groups.join(*test(0, np.arange(n - d), np.arange(d, n)))
        bounds = self._bounds(groups.label)
        stack = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while stack:
            level, i, j = stack.pop()
            least, most = bounds[level]
            apart = (least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j])
            i, j = test(level, i[apart], j[apart])
            if not len(i):
                continue
            if level == 0:
                if groups.join(i, j):
                    bounds = self._bounds(groups.label)
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(i), block // self.WIDTH**2):
                own = slice(at, at + block // self.WIDTH**2)
                a = (self.WIDTH * i[own, None] + np.arange(self.WIDTH)).repeat(self.WIDTH, 1)
                b = np.tile(self.WIDTH * j[own, None] + np.arange(self.WIDTH), (1, self.WIDTH))
                keep = (a < below) & (b < below) & (a <= b if level > 1 else a < b)
                stack.append((level - 1, a[keep], b[keep]))
        out = Groups(n)
        out.join(self.order, self.order[groups.label])
        return out

    def _bounds(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By level, the least and largest label below each node."""
        out = [(label, label)]
        while len(out[-1][0]) > 1:
            cut = np.arange(0, len(out[-1][0]), self.WIDTH)
            out.append((np.minimum.reduceat(out[-1][0], cut), np.maximum.reduceat(out[-1][1], cut)))
        return out


def run_groups(size: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """The group of each set of a run. Sets that can link have bitmaps of one length, or one twice as long as the other's: a tree for each length."""
    n, out = np.array([len(m) for m in maps]), Groups(len(maps))
    for least in np.unique(n):
        own = np.flatnonzero((n == least) | (n == 2 * least))
        if len(own) > 1:
            tree = SignatureTree(size[own], np.stack([folded(maps[k], least) for k in own]))
            label = tree.groups(percent, n[own] == least).label
            out.join(own, own[label])
    return out.label


def _trees(percent: int):
    """Rows (shingle, p, s, q, t, doc, size, bits) of a task, sorted: of each run, rows (a, b) of a class and the least class of its group."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            doc, place = np.unique(run["doc"].to_numpy(), return_index=True)
            words_, at = _words_of(run["bits"].combine_chunks())
            label = run_groups(run["size"].to_numpy()[place], [words_[at[k] : at[k + 1]] for k in place], percent)
            joined = label != np.arange(len(doc))
            return doc[label[joined]], doc[joined]

        def ended(runs: list[pa.Table]) -> pa.RecordBatch:
            found = [of(run) for run in runs]
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            both = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        names = ("shingle", "p", "s", "q", "t")
        held: list[pa.Table] = []  # the pieces of the run that may go on
        for b in batches:
            table = pa.Table.from_batches([b])
            if not table.num_rows:
                continue
            start, end = _runs(*(table[n].to_numpy() for n in names))
            pieces = [table.slice(s, e - s) for s, e in zip(start, end, strict=True)]
            if held and all(held[0][n][0] == pieces[0][n][0] for n in names):
                held.append(pieces.pop(0))
            if pieces:
                yield ended(([pa.concat_tables(held)] if held else []) + pieces[:-1])
                held = [pieces[-1]]
        if held:
            yield ended([pa.concat_tables(held)])

    return make


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Numbers of common elements of each set of ``a`` with each of ``b``."""
    (x, at), (y, to) = ((np.concatenate([*s, np.zeros(0, np.int64)]), np.repeat(np.arange(len(s)), [len(k) for k in s])) for s in (a, b))
    common = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.int64)
    x_in, y_in = np.isin(x, common), np.isin(y, common)
    x, at, y, to = np.searchsorted(common, x[x_in]), at[x_in], np.searchsorted(common, y[y_in]), to[y_in]
    x_order, y_order = np.argsort(x), np.argsort(y)
    x, at, y, to = x[x_order], at[x_order], y[y_order], to[y_order]
    for k in range(0, len(common), columns):
        sides = []
        for value, row, n in ((x, at, len(a)), (y, to, len(b))):
            own = slice(*np.searchsorted(value, [k, k + columns]))
            side = np.zeros((n, columns), np.float32)
            side[row[own], value[own] - k] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _block_links(percent: int):
    """Of a pair of blocks, rows (rep, n, low): how many of the other block's classes each class links with, and the least class that it reaches there."""

    def make(rows: pa.Table) -> pa.Table:
        doc, place = np.unique(rows["doc"].to_numpy(), return_index=True)  # rows that repeat an id count once
        side = rows["side"].to_numpy()[place]
        lists = rows["own"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [flat[ends[k] : ends[k + 1]] for k in place]
        size = np.array([len(x) for x in sets])
        one = all(rows[x][0] == rows[y][0] for x, y in (("p", "q"), ("s", "t")))
        i = np.flatnonzero(side == 0)
        j = i if one else np.flatnonzero(side == 1)
        n = overlaps([sets[k] for k in i], [sets[k] for k in j])
        linked = 100 * n >= percent * (size[i][:, None] + size[j][None, :] - n)
        count, groups = np.zeros(len(doc), np.int64), Groups(len(doc))
        if one:
            np.fill_diagonal(linked, False)
        else:
            count[j] = linked.sum(0)
        count[i] = linked.sum(1)
        x, y = np.nonzero(linked)
        groups.join(i[x], j[y])
        return pa.table({"rep": pa.array(doc), "n": pa.array(count), "low": pa.array(doc[groups.label])}).filter(pa.array(count > 0))

    return make


def in_blocks(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """``rows`` (group, doc, size, ...) once for each pair of blocks that it belongs to, with (p, s, q, t, side).

    A group of at most BLOCK_ROWS classes and BLOCK_ELEMENTS elements is one block. A larger one is dealt by ranges of sizes (p) and,
    in each, by a hash (s). Sizes of sets that link differ by a factor of 100 / percent at most, so their logarithms to a slightly
    larger base differ by less than 1: only blocks of the same range or the next are paired.
    """
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_elements"))
    large = size.where((F.col("_n") > BLOCK_ROWS) | (F.col("_elements") > BLOCK_ELEMENTS)).select(group, F.lit(True).alias("_large"))
    rows = rows.join(large, group, "left").withColumn("p", F.when(F.col("_large"), F.floor(F.log("size") / (math.log(100 / percent) + 1e-9))).otherwise(F.lit(0).cast("long")))
    parts = rows.where("_large").groupBy(group, "p").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).alias("m"))
    parts = parts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("p", "m"))).alias("_parts"))
    rows = rows.drop("_large").join(parts, group, "left")
    own = F.coalesce(F.element_at("_parts", F.col("p")), F.lit(1).cast("long"))
    dealt = rows.withColumns({"_own": own, "s": F.pmod(F.xxhash64(F.lit("block"), "doc"), own)})
    numbers = "if({0} is null, array(), sequence(0L, {0} - 1))".format
    pairs = f"""concat(transform({numbers("_own")}, t -> struct(p as p, least(s, t) as s, p as q, greatest(s, t) as t, int(t < s) as side)),
        transform({numbers("element_at(_parts, p + 1)")}, t -> struct(p as p, s as s, p + 1 as q, t as t, 0 as side)), transform({numbers("element_at(_parts, p - 1)")}, t -> struct(p - 1 as p, t as s, p as q, s as t, 1 as side)))"""
    kept = [c for c in rows.columns if c not in ("p", "_parts")]
    return dealt.withColumn("_pairs", F.expr(pairs)).select(*kept, F.inline("_pairs"))


#: Bits of the filter that keeps documents without candidates out of the shuffle: about 16 for each wanted id, within these bounds.
LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 26


def only_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(doc, _text) whose id is in wanted(doc, d1, rep), with d1 and rep; an id with several wanted sets meets each of them.

    A bitmap of two hashes of the wanted ids (8 MB at most) lets few others through, so that not all texts are shuffled for the
    exact join behind it. Where ids are too many for it, it lets more through, and the join does more.
    """
    n = wanted.count()
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (16 * n).bit_length()))
    places = [F.pmod(F.xxhash64(F.lit(k), "doc"), F.lit(bits)) for k in range(2)]
    words_ = wanted.select(F.explode(F.array(*places)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).toPandas()
    filter_ = np.zeros(bits >> 6, np.uint64)
    filter_[words_["word"].to_numpy(np.int64)] = words_["bits"].to_numpy(np.int64).view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(filter_)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for c in b.columns[2:]:
                at = c.to_numpy()
                ok &= (held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["doc", "_text"]).filter(pa.array(ok))

    own = docs.select(F.col("doc").cast("long").alias("doc"), "_text").where("doc is not null")
    return own.select("doc", "_text", *[p.alias(f"h{k}") for k, p in enumerate(places)]).mapInArrow(sift, "doc long, _text string").join(wanted, "doc")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc, own): under the number rep the whole sets of the documents of wanted(doc, d1, rep); of an id's texts the one with this digest."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            d1 = b.column(2).to_numpy().view(np.uint64)
            for a, z in slices(offsets, 1 << 20):
                found = list(shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], n))
                right = np.array([digests(s)[0] == d for s, d in zip(found, d1[a:z].tolist(), strict=True)], bool)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), _lists(found)], names=["doc", "own"]).filter(pa.array(right))

    return only_wanted(docs, wanted).select("rep", "_text", "d1").mapInArrow(whole, "doc long, own array<long>")


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, percent: int = 75, count_links: bool = True) -> DataFrame:
    """Per row: id, n_shingles, class_id, component_id, and, if asked to ``count_links``, n_links between classes.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct shingles. class_id
    is the smallest id with the very same set; n_links is the number of all other classes that this class links with; component_id is the smallest id reachable by links. A null or
    blank text has an empty set and is alone. Rows with a null id have n_shingles and null ids. Rows that
    repeat an id and its text are judged alike; an id with more than one text is in the class of each. Other columns play no
    part. An empty table gives an empty result. Shingles and sets are compared by 64-bit and 128-bit hashes. Ids must be integers
    (or strings of them): any other type is refused at the call.
    """
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise TypeError(f"{id_col} must hold integers, not {kind}")
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"))
    frequent = df.sparkSession.sparkContext.broadcast(frequent_shingles(docs, "doc", "_text", shingle_words))
    sets = staged(docs.mapInArrow(_prepare(percent, shingle_words, frequent), f"doc {kind}, size long, d1 long, d2 long, bits binary, prefix array<long>"), "shingles")
    # A class is told by its set, not by an id: its number is drawn once, with the table, and goes through the join in place of an id.
    classes = sets.where("size > 0 and doc is not null").groupBy("d1", "d2", "size").agg(F.min(F.col("doc").cast("long")).alias("id"))
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    heads = sets.withColumn("id", F.col("doc").cast("long")).drop("doc").join(classes, ["id", "d1", "d2", "size"]).withColumnRenamed("rep", "doc")
    rows = heads.select(F.explode("prefix").alias("shingle"), "doc", "size").repartition("shingle").sortWithinPartitions("shingle", "doc")
    met = staged(rows.mapInArrow(_meet(percent), "a long, b long, shingle long, size long"), "met")
    maps = heads.select("doc", "bits")

    # Long runs: groups of candidates, and the components that these make over all runs.
    long_rows = in_blocks(met.where("b is null").select("shingle", F.col("a").alias("doc"), "size").distinct(), "shingle", percent)
    keys = ["shingle", "p", "s", "q", "t"]
    grown = long_rows.select(*keys, "doc", "size").join(maps, "doc").select(*keys, "doc", "size", "bits").repartition(*keys).sortWithinPartitions(*keys)
    near = components(grown.mapInArrow(_trees(percent), "a long, b long"))
    near = staged(near.select(F.col("v").alias("doc"), F.col("component").alias("part")), "candidates")

    # Short runs: pairs that do not lie in one such component.
    part_a, part_b = near.toDF("a", "part_a"), near.toDF("b", "part_b")
    pairs = met.where("b is not null").select("a", "b").distinct()
    pairs = pairs.join(part_a, "a", "left").join(part_b, "b", "left").where("part_a is null or part_b is null or part_a != part_b").select("a", "b")
    size = heads.select("doc", "size", "bits")
    pairs = pairs.join(size.toDF("a", "size_a", "bits_a"), "a").join(size.toDF("b", "size_b", "bits_b"), "b")
    pairs = staged(pairs.select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(_possible(percent), "a long, b long").distinct(), "pairs")

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).union(near.select("doc")).distinct()
    ends = staged(ends.join(classes.select(F.col("rep").alias("doc"), "id", "d1"), "doc").select(F.col("id").alias("doc"), "d1", F.col("doc").alias("rep")), "ends")
    own = staged(whole_sets(docs, ends, shingle_words), "sets")

    both = pairs.join(own.select(F.col("doc").alias("b"), F.col("own").alias("own_b")), "b").join(own.select(F.col("doc").alias("a"), F.col("own").alias("own_a")), "a")
    shared = F.size(F.array_intersect("own_a", "own_b")).cast("long")
    links = both.select("a", "b", shared.alias("n"), (F.size("own_a").cast("long") + F.size("own_b")).alias("sum")).where(f"100 * n >= {percent} * (sum - n)")
    links = staged(links.select("a", "b").distinct(), "links")
    dealt = in_blocks(near.join(classes.select(F.col("rep").alias("doc"), "size"), "doc"), "part", percent)
    blocks = dealt.join(own, "doc").select("part", "p", "s", "q", "t", "side", "doc", "own").groupBy("part", "p", "s", "q", "t").applyInArrow(_block_links(percent), "rep long, n long, low long")
    blocks = staged(blocks, "block-links")
    joined = components(links.union(blocks.select("low", "rep")))

    joined = joined.withColumnRenamed("v", "rep")
    least = joined.join(classes.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("_least"))
    classes = classes.join(joined.join(least, "component").select("rep", F.col("_least").alias("component")), "rep", "left")
    if count_links:
        counted = links.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("n")).union(blocks.select("rep", "n"))
        classes = classes.join(counted.groupBy("rep").agg(F.sum("n").alias("n_links")), "rep", "left")
    out = sets.select("doc", "size", "d1", "d2").join(classes, ["d1", "d2", "size"], "left")
    doc = F.col("doc").cast("long")
    return out.select(
        F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.when(doc.isNotNull(), F.coalesce("id", doc)).alias("class_id"),
        F.when(doc.isNotNull(), F.coalesce("component", "id", doc)).alias("component_id"), *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []),
    )
