"""Streams with keyed state: what a key has seen stays with it, so a micro-batch reads its own rows and the state of the keys that it touches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quizloom.operators.review import FIRST_EASE, review_step

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000_000


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started within keep their state in the store that keyed state needs; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def review_schedules(attempts: DataFrame) -> DataFrame:
    """The stream of (user_id, question_id, interval_days, ease, lapses, due_at), a row for each pair that a micro-batch touched; due_at is null off the schedule.

    The set of a pair's attempts is the state of a streaming aggregation, and the schedule is sm2_schedule()'s fold over it, so late attempts find
    their place and equal ones count once. A pair that is touched is folded anew, whatever its number of attempts; no key needs a call to Python.
    """
    attempt = F.struct(F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("attempt_id").cast("long").alias("id"), F.col("verdict"))
    start = F.struct(F.lit(False).alias("active"), F.lit(0.0).alias("interval"), F.lit(FIRST_EASE).alias("ease"), F.lit(0).alias("lapses"), F.lit(None).cast("long").alias("due"))
    seen = attempts.groupBy("user_id", "question_id").agg(F.collect_set(attempt).alias("_h"))
    folded = seen.withColumn("_s", F.aggregate(F.array_sort("_h"), start, lambda s, a: review_step(s, a, F.lit(_DAY))))
    due = F.timestamp_micros(F.when(F.col("_s.active"), F.col("_s.due")))
    return folded.select("user_id", "question_id", F.col("_s.interval").alias("interval_days"), F.round("_s.ease", 6).alias("ease"), F.col("_s.lapses").alias("lapses"), due.alias("due_at"))


class Lockouts:
    """Of some users the events that the watermark has not passed, and the failures of the trailing minutes. Whole seconds are settled in order once the watermark is behind them; a success forgets the failures.

    The state goes to the worker and back with a micro-batch's rows, and users are settled together in arrays, so neither events nor users cost calls of their own.
    """

    def __init__(self, threshold: int, minutes: int, user: str):
        self.threshold, self.seconds = threshold, 60 * minutes
        self.state = f"user array<{user}>, at array<long>, id array<long>, failed array<boolean>, recent_user array<{user}>, recent array<long>"

    def settle(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        *held, who, recent = state.get if state.exists else ([],) * 6
        held = [pd.DataFrame(dict(zip(("user_id", "at", "event_id", "failed"), held, strict=True)))] if held[0] else []
        events = pd.concat([*held, *([] if state.hasTimedOut else [r[["user_id", "at", "event_id", "failed"]] for r in rows])] or [pd.DataFrame({"user_id": [], "at": [], "event_id": [], "failed": []})], ignore_index=True)
        second = events["at"].to_numpy(np.int64) // 1_000_000
        ready = (second + 1) * 1000 - 1 < passed  # a second's last millisecond
        left = events[~ready]
        ready[sum(map(len, held)) :] = False  # what comes late is neither held nor settled
        found, who, recent = self._counted(events[ready], who, recent)
        kept = (recent + self.seconds) * 1000 >= passed
        who, recent = who[kept], recent[kept]
        if len(left) or len(recent):
            state.update((left["user_id"].tolist(), left["at"].tolist(), left["event_id"].tolist(), left["failed"].tolist(), who.tolist(), recent.tolist()))
            # Failures that no event to come can count are forgotten too.
            state.setTimeoutTimestamp(int((left["at"].min() // 1_000_000 + 1) * 1000 - 1 if len(left) else (recent.max() + self.seconds + 1) * 1000))
        elif state.exists:
            state.remove()
        if len(found):
            yield found

    def _counted(self, events: pd.DataFrame, who: list, recent: list) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """(rows, users, seconds of their failures since the last success) of events that all are there up to their last second, and of such failures before."""
        n = len(recent)
        users, names = pd.factorize(pd.concat([pd.Series(who, dtype=object), events["user_id"].astype(object)], ignore_index=True), use_na_sentinel=False)
        at = np.concatenate([np.asarray(recent, np.int64) * 1_000_000, events["at"].to_numpy(np.int64)])
        ids = np.concatenate([np.arange(n), events["event_id"].to_numpy(np.int64)])
        failed = np.concatenate([np.ones(n, bool), events["failed"].to_numpy() == True])  # noqa: E712 - null is no failure
        new = np.arange(len(at)) >= n
        columns = [x[np.lexsort((failed, ids, at, new, users))] for x in (users, new, at, ids, failed)]
        once = np.ones(len(at), bool)
        once[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
        users, new, at, ids, failed = (x[once] for x in columns)
        # A run of failures: from a user's first event, or a success, up to the next.
        first = np.ones(len(users), bool)
        first[1:] = users[1:] != users[:-1]
        run = np.cumsum(first | ~failed)
        last = run == run[np.append(np.flatnonzero(first)[1:], len(users)) - 1][np.cumsum(first) - 1] if len(users) else first
        users, new, at, ids, run, last = (x[failed] for x in (users, new, at, ids, run, last))
        second = at // 1_000_000
        place = run * (1 << 40) + second
        failures = np.searchsorted(place, place, "right") - np.searchsorted(place, place - self.seconds, "right")
        hit = new & (failures >= self.threshold)
        name = names.to_numpy() if hasattr(names, "to_numpy") else np.asarray(names)
        return pd.DataFrame({"user_id": name[users[hit]], "event_id": ids[hit], "at": at[hit], "failures": failures[hit]}), name[users[last]], second[last]


def lockouts(events: DataFrame, threshold: int = 8, minutes: int = 15, watermark: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """(user_id, event_id, ts, failures) of a stream (user_id, event_id, ts, failed): the rows of failed_attempt_lockouts(), each once the watermark has passed its second.

    Unlike a count by window, a success clears what came before it. Events that come after the watermark has passed them are left out. Users are
    kept in ``buckets`` by a hash; a micro-batch reads and writes what waits in those that it touches, for a key of its own costs each user milliseconds.
    """
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("_bucket")
    rows = events.select(bucket, "user_id", F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("at"), "failed").withWatermark("ts", watermark)
    kind = events.schema["user_id"].dataType.simpleString()
    of = Lockouts(threshold, minutes, kind)
    out = rows.groupBy("_bucket").applyInPandasWithState(of.settle, f"user_id {kind}, event_id long, at long, failures long", of.state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "failures")
