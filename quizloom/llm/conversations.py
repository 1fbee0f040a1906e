"""Repair of conversation structure: the cheapest edits of each conversation's rows, by a rank-convergence parallel Viterbi.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Four states know how far that is (nothing yet, the system
row, a user row, an assistant row), and the cost of the rest of a conversation from each state is a vector, found from
the back. A conversation of any length is cut into chunks of rows that are worked on at once: each chunk starts from a
speculative vector; in fix-up passes a chunk runs anew from the vector that the chunk behind it has found, until its vectors differ
from those of the run before by a constant only, from where on that run was right. Passes go on while a chunk's first vector
changes. Constants, added up, are the costs; forward tracing by vectors takes the least edit in ASCII order.

Positions come from a range sort, so a conversation with a third of all rows spreads over many tasks; only small figures a chunk
are ever ordered by conversation in one task, and the rows once more where the report hashes a conversation's whole text,
which is sequential by nature (a stream, held in no memory).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm._shared import bounded_batches, staged

#: A chunk has at most 2 ** CHUNK_BITS rows.
CHUNK_BITS = 10
_SPACE = " \t\n\x0b\x0c\r"
#: State behind the next row that the pattern asks for (user, or assistant behind a user), by state.
NEXT = (2, 2, 3, 2)
#: State behind a kept row by its role's initial; any other is not allowed.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Cost of what has to be inserted where no row is left, by state.
END = (0, 2 * INSERT, INSERT, 0)


@functools.lru_cache(1 << 16)
def behind(vector: tuple[int, ...], code: str) -> tuple[tuple[int, ...], int]:
    """The vector in front of a row, given the one behind it, with its least value taken off; and that value.

    ``code``: x for a row that must go, else the initial (o for other roles), in upper case if its text is truncated.
    """
    late = TRUNCATED if code.isupper() else 0
    cost = [DELETE + v for v in vector]
    if code != "x":
        kept = KEPT[code.lower()]
        for q in range(4):
            cost[q] = min(cost[q], REROLE + late + vector[NEXT[q]], late + vector[kept[q]] if q in kept else 1 << 60)
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    least = min(cost)
    return tuple(c - least for c in cost), least


@functools.lru_cache(1 << 16)
def edits(vector: tuple[int, ...], code: str, state: int) -> tuple[str, int]:
    """The edits at a row (insertions, then what becomes of the row) that are least in ASCII order among the cheapest, and the state behind it."""
    front, least = behind(vector, code)
    late = TRUNCATED if code.isupper() else 0
    kept = KEPT.get(code.lower(), {})
    said = ""
    while True:
        cost = front[state] + least
        if DELETE + vector[state] == cost:
            return said + "D", state
        if INSERT + front[NEXT[state]] + least == cost:
            said, state = said + "I", NEXT[state]
        elif state in kept and late + vector[kept[state]] == cost:
            return said + "K", kept[state]
        else:
            return said + "R", NEXT[state]


def run_back(codes: str, vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector in front of all rows and its constant."""
    total = 0
    for code in reversed(codes):
        vector, least = behind(vector, code)
        total += least
    return vector, total


def fix_up(codes: str, old: tuple[int, ...], new: tuple[int, ...], front: tuple[int, ...], total: int) -> tuple[tuple[int, ...], int]:
    """run_back() from ``new``, given what it gave from ``old``: ends where both runs' vectors differ by a constant only."""
    change = 0
    for k in range(len(codes) - 1, -1, -1):
        if old == new:
            return front, total + change
        old, a = behind(old, codes[k])
        new, b = behind(new, codes[k])
        change += b - a
    return new, total + change


def trace(codes: str, tail: tuple[int, ...], last: bool, state: int) -> tuple[str, int]:
    """All edits of a chunk from this state, and the state behind it."""
    vectors = [tail]
    for code in reversed(codes):
        vectors.append(behind(vectors[-1], code)[0])
    said = []
    for k, code in enumerate(codes):
        done, state = edits(vectors[len(codes) - k - 1], code, state)
        said.append(done)
    return "".join(said) + ("I" * (END[state] // INSERT) if last else ""), state


class Repair(NamedTuple):
    """Rows (_conv, _turn, _role, _text, _pos, _chunk) in order of _pos; chunks (_conv, _chunk, audit, _enter, figures) with the edits of their rows."""

    rows: DataFrame
    chunks: DataFrame


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with the faults of the contract, by crc32(``conv_id:turn``) modulo 20: 0 row gone, 1 text emptied, 2 without ``[.!?]``, 3 row twice, 4 role user.

    A null role, text, or part of the key is one space.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    draw = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col(text_col).cast("string"), blank)
    rows = df.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), draw.alias("_draw"),
        F.when(draw == 4, "user").otherwise(F.coalesce(F.col(role_col).cast("string"), blank)).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("_draw > 0")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_draw", "_copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def repair_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, chunk_bits: int = CHUNK_BITS) -> Repair:
    """The cheapest edits of each conversation, taken by turn (nulls first; rows of one turn by role, then text).

    A row is blank (no character but white space), else duplicate (role and text seen earlier in the conversation), else truncated
    (last such character none of ``.!?``). Keeping costs 0, another role (user or assistant) 2, deletion 3 and is a must for blank
    and duplicate rows, an inserted row with empty text 2; a truncated row that stays costs 1. A null role or text is one space; a
    role that begins with no s, u or a (an empty one too) can't be kept. Null ids are one conversation. An empty table gives none;
    other columns play no part. Texts are shuffled once, by ranges.
    """
    bounded_batches(df.sparkSession)
    blank = F.lit(" ")
    rows = df.select(F.col(id_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("_role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("_text"))
    rows = rows.withColumn("_begin", F.substring("_text", 1, 16))
    rows = rows.repartitionByRange("_conv", "_turn", "_role", "_begin").sortWithinPartitions("_conv", "_turn", "_role", "_begin", "_text").drop("_begin")
    left = F.rtrim(F.col("_text"), F.lit(_SPACE))
    rows = rows.withColumns({
        "_pos": F.monotonically_increasing_id(), "_same": F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text")), 256),
        "_blank": left == "", "_late": ~F.substring(left, -1, 1).isin(".", "!", "?"),
    })
    rows = staged(rows.withColumn("_chunk", F.shiftright("_pos", chunk_bits)), "conversation-rows")

    light = rows.select("_conv", "_chunk", "_pos", "_same", "_blank", "_late", _initial(F.col("_role")).alias("_initial"))
    again = light.groupBy(F.col("_conv").alias("_of"), F.col("_same").alias("_key")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    light = light.join(again, F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_same") == F.col("_key")), "left")
    twice = ~F.col("_blank") & (F.col("_pos") > F.coalesce("_first", "_pos"))
    code = F.when(F.col("_blank") | twice, "x").when(F.col("_late"), F.upper("_initial")).otherwise(F.col("_initial"))
    light = light.select("_conv", "_chunk", "_pos", "_initial", code.alias("_code"), *[c.cast("long").alias(n) for n, c in (("blank", F.col("_blank")), ("duplicate", twice), ("truncated", ~F.col("_blank") & ~twice & F.col("_late")))])
    at = F.array_sort(F.collect_list(F.struct("_pos", "_code", "_initial")))
    chunks = light.groupBy("_conv", "_chunk").agg(at.alias("_at"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    in_order = Window.partitionBy("_conv").orderBy("_chunk")
    chunks = chunks.select(
        "_conv", "_chunk", F.array_join("_at._code", "").alias("_codes"), F.array_join("_at._initial", "").alias("_initials"), "blank", "duplicate", "truncated",
        F.row_number().over(in_order).alias("_no"), F.lead(F.col("_at")[0]["_initial"]).over(in_order).alias("_then"),
    )
    chunks = staged(chunks.withColumn("_last", F.col("_then").isNull()), "conversation-chunks")
    return Repair(rows, _traced(_converged(chunks)))


_VECTORS = "_tail array<int>, _front array<int>, _total long, _changed boolean"


def _converged(chunks: DataFrame) -> DataFrame:
    """Chunks with the right vectors behind (_tail) and in front (_front) of them and the constant between (_total)."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tails = [END if last else (0, 0, 0, 0) for last in b["_last"]]
            found = [run_back(c, t) for c, t in zip(b["_codes"], tails, strict=True)]
            yield b.assign(_tail=[list(t) for t in tails], _front=[list(f) for f, _ in found], _total=[n for _, n in found], _changed=True)

    def rerun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for codes, tail, front, total, given in zip(b["_codes"], b["_tail"], b["_front"], b["_total"], b["_given"], strict=True):
                old, new, front = tuple(tail), tuple(given) if given is not None else tuple(tail), tuple(front)
                now, total = fix_up(codes, old, new, front, total)
                found.append((list(new), list(now), total, now != front))
            yield b.drop(columns="_given").assign(**{c: [f[k] for f in found] for k, c in enumerate(("_tail", "_front", "_total", "_changed"))})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", " + _VECTORS
    found = staged(chunks.mapInPandas(start, schema), "conversation-vectors")
    single = found.where("_last and _no = 1")
    many = found.where("not (_last and _no = 1)")
    while True:
        # A chunk takes the vector of the chunk behind it where that one changed; in the first pass all do.
        given = many.where("_changed").select(F.col("_conv").alias("_of"), (F.col("_no") - 1).alias("_to"), F.col("_front").alias("_given"))
        if given.isEmpty():
            return single.unionByName(many)
        many = staged(many.join(given, F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_no") == F.col("_to")), "left").drop("_of", "_to").mapInPandas(rerun, schema), "conversation-vectors")


def _traced(chunks: DataFrame) -> DataFrame:
    """Chunks with their edits (audit), the state in front of them (_enter), the pairs of neighbours that the pattern forbids and their share of the cost."""

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_conv": b["_conv"], "_no": b["_no"], "_exits": [[trace(c, tuple(t), False, q)[1] for q in range(4)] for c, t in zip(b["_codes"], b["_tail"], strict=True)]})

    def enters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = 0
        for b in batches:
            found = []
            for no, to in zip(b["_no"], b["_exits"], strict=True):
                state = 0 if no == 1 else state
                found.append(state)
                state = int(to[state])
            yield pd.DataFrame({"_of": b["_conv"], "_at": b["_no"], "_enter": found})

    def audits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [trace(c, tuple(t), bool(last), int(q))[0] for c, t, last, q in zip(b["_codes"], b["_tail"], b["_last"], b["_enter"], strict=True)]
            then = [i + (t or "") for i, t in zip(b["_initials"], b["_then"], strict=True)]
            illegal = [sum(x[k : k + 2] not in ("su", "ua", "au") for k in range(len(x) - 1)) for x in then]
            cost = [total + (int(front[0]) if no == 1 else 0) for total, front, no in zip(b["_total"], b["_front"], b["_no"], strict=True)]
            yield b[["_conv", "_chunk", "_enter", "blank", "duplicate", "truncated"]].assign(audit=found, illegal=illegal, cost=cost)

    conv = chunks.schema["_conv"].dataType.simpleString()
    first = chunks.where("_no = 1").withColumn("_enter", F.lit(0))
    # The exits of a chunk from each of its four states, composed along each conversation: a stream of a few numbers a chunk.
    maps = chunks.where("not (_last and _no = 1)").select("_conv", "_no", "_codes", "_tail").mapInPandas(exits, f"_conv {conv}, _no int, _exits array<int>")
    states = maps.repartition("_conv").sortWithinPartitions("_conv", "_no").mapInPandas(enters, f"_of {conv}, _at int, _enter int").where("_at > 1")
    later = chunks.where("_no > 1").join(states, F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_no") == F.col("_at"))).drop("_of", "_at")
    schema = f"_conv {conv}, _chunk long, _enter int, blank long, duplicate long, truncated long, audit string, illegal long, cost long"
    return staged(first.unionByName(later).mapInPandas(audits, schema), "conversation-edits")


class _Editor:
    """Applies a chunk's edits to its rows, one after the other."""

    def __init__(self):
        self.audit, self.at, self.state = "", 0, 0

    def begin(self, audit: str, state: int) -> None:
        self.audit, self.at, self.state = audit, 0, state

    def inserted(self) -> Iterator[str]:
        """The roles of rows that are inserted here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._asked()

    def row(self, role: str) -> str | None:
        """The row's role, or None if it is deleted."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        if edit == "R":
            return self._asked()
        self.state = KEPT[role[0]][self.state]
        return role

    def _asked(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = NEXT[self.state]
        return role


def _stream(repair: Repair) -> DataFrame:
    """Each chunk's edits and then its rows, as rows of one kind."""
    none = F.lit(None)
    heads = repair.chunks.select("_conv", "_chunk", F.lit(-1).cast("long").alias("_pos"), none.cast("string").alias("_role"), none.cast("string").alias("_text"), "audit", "_enter")
    return heads.unionByName(repair.rows.select("_conv", "_chunk", "_pos", "_role", "_text", none.cast("string").alias("audit"), none.cast("int").alias("_enter")))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, chunk, role, text, audit of a chunk that begins here or None) for each repaired row; role is None where only a chunk begins."""
    edit, conv, chunk = _Editor(), None, None
    for b in batches:
        for c, k, pos, role, text, audit, enter in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
            if pos < 0:
                for r in edit.inserted():
                    yield conv, chunk, r, "", None
                conv, chunk = c, k
                edit.begin(audit, enter)
                yield conv, chunk, None, None, audit
                continue
            for r in edit.inserted():
                yield conv, chunk, r, "", None
            stays = edit.row(role)
            if stays is not None:
                yield conv, chunk, stays, text, None
    for r in edit.inserted():
        yield conv, chunk, r, "", None


def repaired_rows(repair: Repair) -> DataFrame:
    """(conv_id, chunk, place, role, text): the repaired conversations' rows, in order of chunk and place. Each chunk is rebuilt by itself."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, size = [], 0, 0
        for conv, chunk, role, text, audit in _lines(batches):
            if role is None:
                place = 0
                continue
            held.append((conv, chunk, place, role, text))
            place, size = place + 1, size + len(text)
            if size > 1 << 20 or len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    conv = repair.rows.schema["_conv"].dataType
    names, kinds = ["conv_id", "chunk", "place", "role", "text"], [to_arrow_type(conv), pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows = _stream(repair).repartition("_conv", "_chunk").sortWithinPartitions("_conv", "_chunk", "_pos")
    return rows.mapInArrow(rebuild, f"conv_id {conv.simpleString()}, chunk long, place long, role string, text string")


def conversation_report(repair: Repair, ids: DataFrame) -> DataFrame:
    """Per distinct id of ``ids`` (its only column): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    An id without rows has zeros, an empty audit and the hash of the empty text. Texts are hashed in a stream by conversation,
    so memory holds a conversation's edits (one letter a row, as they are returned), never its texts.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, said, out, hashed = False, None, [], [], None

        def closed():
            return (conv, "".join(said), hashed.hexdigest())

        for c, _, role, text, audit in _lines(batches):
            if audit is not None:
                if not open_ or c != conv:
                    if open_:
                        out.append(closed())
                    open_, conv, said, hashed, begun = True, c, [], hashlib.sha256(), False
                said.append(audit)
            else:
                hashed.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if open_:
            out.append(closed())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    name = ids.columns[0]
    conv = repair.rows.schema["_conv"].dataType
    names, kinds = ["_conv", "audit", "repaired_sha256"], [to_arrow_type(conv), pa.string(), pa.string()]
    told = _stream(repair).repartition("_conv").sortWithinPartitions("_conv", "_chunk", "_pos").mapInArrow(digest, f"_conv {conv.simpleString()}, audit string, repaired_sha256 string")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    figures = repair.chunks.groupBy(F.col("_conv").alias("_c")).agg(*[F.sum(c).alias(c) for c in counts])
    # Distinct turns are made so before they are counted, in two steps, so that a long conversation is no task's own.
    turns = repair.rows.groupBy("_conv", "_turn").agg(F.lit(1)).groupBy(F.col("_conv").alias("_t")).agg((F.max("_turn") - F.min("_turn") + 1 - F.count("_turn")).alias("gaps"))
    out = ids.select(F.col(name).alias("_id")).distinct()
    for table, key in ((told, "_conv"), (figures, "_c"), (turns, "_t")):
        out = out.join(table, F.col("_id").eqNullSafe(F.col(key)), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *counts]]
    return out.select(F.col("_id").alias(name), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
