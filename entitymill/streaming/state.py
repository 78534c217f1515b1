"""Per-key rules online, in one running stream whose state lies in a store on disk.

Batches come in order of time, and rows of a batch go in time order of their
key, so the decisions are those of the batch rules. A timer ends what can't
matter for any later row: the last accepted times of a user once the youngest
left the window, an entry of the cache once its time to live is over.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ordered import allow
from ..operators.usage import LIMIT, OWNERS, TTL, WIDTH, cache_entities

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of users: each is one value of the state, read and written once in a batch.
BUCKETS = 1024


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _in_order(pdfs: Iterator[pd.DataFrame]) -> Iterator:
    """The rows of one key in one micro-batch, by time; the number of files of a batch bounds them."""
    return pd.concat(list(pdfs)).sort_values(["us", "event_id"]).itertuples(index=False)


class _Timed(StatefulProcessor):
    """A processor with at most one timer a key, at the end of all that its state is for."""

    def init(self, handle) -> None:
        self.handle = handle

    def wake(self, us: int) -> None:
        """Sets the key's timer to the first millisecond after ``us``; an earlier one goes."""
        at = us // 1000 + 1
        for old in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            if old == at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class _Limit(_Timed):
    """The users of one bucket, whose last accepted times are one packed value: a batch reads and writes the state once for all of them."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle) -> None:
        super().init(handle)
        self.logs = handle.getValueState("logs", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.logs.get()
        logs: dict[int, deque] = {}
        for user, us in np.frombuffer(kept[0], np.int64).reshape(-1, 2).tolist() if kept else ():
            logs.setdefault(user, deque()).append(us)
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])
        users, times = pdf["user_id"].tolist(), pdf["us"].tolist()
        allowed = [u > 0 and (u in OWNERS or allow(logs.setdefault(u, deque()), us, self.limit, self.width)) for u, us in zip(users, times)]
        # later rows are no earlier than these, so users whose times have all left the window go
        pairs = [(u, us) for u, log in logs.items() if log and log[-1] > times[-1] - self.width for us in log]
        self.logs.update((np.array(pairs, np.int64).tobytes(),))
        self.wake(max((us for _, us in pairs), default=times[-1]) + self.width)
        yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.logs.clear()
        return iter(())


class _Cache(_Timed):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        super().init(handle)
        self.ends = handle.getMapState("ends", "own string", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ends = {own[0]: us[0] for own, us in self.ends.iterator()} if self.ends.exists() else {}
        before, out = dict(ends), []
        for r in _in_order(rows):
            us = int(r.us)
            hit = r.own in ends and us <= ends[r.own]
            if not hit:
                ends[r.own] = us + self.ttl
                if r.id_key:
                    ends[r.id_key] = us + self.ttl
            out.append((r.event_id, r.own, hit))
        for own, us in ends.items():
            if before.get(own) != us:
                self.ends.updateValue((own,), (us,))
        self.wake(max(ends.values()))
        yield pd.DataFrame(out, columns=["event_id", "key", "cache_hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ends.clear()
        return iter(())


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", "0 seconds")


def rate_limit_stream(events: DataFrame, limit: int = LIMIT, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """Same decisions as the batch rule; the state is the last accepted times of each user, at most ``limit`` of them, by hashed buckets of users.

    Requests without a user are refused without a row here.
    """
    keep_state_on_disk(events.sparkSession)
    # without nulls the keys stay exact integers
    known = _timed(events.where("user_id is not null"))
    known = known.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    return known.groupBy("bucket").transformWithStateInPandas(_Limit(limit, width), "event_id long, user_id long, allowed boolean", "append", "eventTime")


def ttl_hits_stream(looked_up: DataFrame, ttl: int = TTL) -> DataFrame:
    """Cache hits of routed probes of all kinds, as the batch rule has them: a fetch by alias restarts the id's own entry.

    The state of an entity holds the ends of its entries, one for each key that was asked for.
    """
    keep_state_on_disk(looked_up.sparkSession)
    rows = _timed(cache_entities(looked_up))
    return rows.groupBy("entity").transformWithStateInPandas(_Cache(ttl), "event_id long, key string, cache_hit boolean", "append", "eventTime")
