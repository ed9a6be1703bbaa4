"""Keyed streaming state with event-time timers: values that wait for support, and lapse without it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.window import Window

#: What the stateful operator needs of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Support(StatefulProcessor):
    """The waiting values of a bucket of keys, the times of their last support (milliseconds), and a timer for the first that lapses."""

    def __init__(self, names: list[str], gap: int):
        self.names, self.gap = names, gap

    def init(self, handle) -> None:
        self.handle = handle
        # columns of the keys that wait, and the timer that is set
        self.waiting = handle.getValueState("waiting", ", ".join(f"`{k}` array<bigint>" for k in self.names) + ", v array<string>, last array<bigint>, armed bigint")

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        held = self.waiting.get()
        *columns, armed = held if held is not None else [[]] * (len(self.names) + 2) + [None]
        names = [*self.names, "v", "last"]
        kinds = {k: object if k == "v" else "int64" for k in names}
        return pd.DataFrame({k: pd.Series(list(c), dtype=kinds[k]) for k, c in zip(names, columns, strict=True)}), armed

    def _keep(self, rows: pd.DataFrame, armed: int | None) -> None:
        due = int(rows["last"].min()) + self.gap + 1 if len(rows) else None
        if armed is not None and armed != due:
            self.handle.deleteTimer(armed)
        if due is not None and armed != due:
            self.handle.registerTimer(due)
        if due is None:
            self.waiting.clear()
        else:
            self.waiting.update((*[rows[c].tolist() for c in (*self.names, "v", "last")], due))

    def _told(self, rows: pd.DataFrame, event: str, at: pd.Series) -> pd.DataFrame:
        return rows[self.names].assign(event=event, value=rows["v"], at=at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, armed = self._held()
        new = pd.concat([r[[*self.names, "t", "v"]] for r in rows], ignore_index=True).assign(new=True)
        old = held.rename(columns={"last": "t"}).assign(new=False)
        # a key's held value comes first; it isn't later than what the watermark still lets in, unless it is of the same batch
        both = pd.concat([old, new], ignore_index=True) if len(old) else new
        both = both.sort_values([*self.names, "new", "t", "v"], ignore_index=True)
        same = lambda n: pd.concat([both[k] == both[k].shift(n) for k in self.names], axis=1).all(axis=1)
        after, more = same(1), same(-1)
        away = both["t"] - both["t"].shift(1)
        apart = after & (away > self.gap)
        starts = both["new"] & (~after | apart | (both["v"] != both["v"].shift(1)))
        ends = more & (both["t"].shift(-1) - both["t"] > self.gap)
        yield self._told(both[ends], "expired", both["t"][ends] + self.gap)
        yield self._told(both[starts], "started", both["t"][starts])
        self._keep(both[~more].rename(columns={"t": "last"}), armed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, armed = self._held()
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        lapsed = held["last"] + self.gap + 1 <= max(fired, now)
        if lapsed.any():
            yield self._told(held[lapsed], "expired", held["last"][lapsed] + self.gap)
            # a timer that fires is gone
            self._keep(held[~lapsed], None if armed == fired else armed)

    def close(self) -> None:
        pass


def stream_support(rows: DataFrame, key: list[str], gap: int, late: str = "0 seconds", buckets: int = 128) -> DataFrame:
    """key, event (started or expired), value, at: how each key's values come to wait and lapse in a stream.

    rows: key (long columns), ts (timestamp), t (the same in whole milliseconds)
    and v (text).  A value goes on waiting as long as it is seen again within
    gap; another value takes its place at once.  A timer tells of a lapse when
    the watermark passes it, whether the key is seen again or not.  Rows that
    come later than the watermark allows are dropped.  State is kept by bucket of
    keys in the store of STATE_STORE, which the session must name: a key by
    itself would ask the store five times a batch, so a bucket holds what waits
    of all its keys, and a task holds a bucket's rows of a batch.  The number of
    buckets must stay the same for a checkpoint.
    """
    # nulls are equal, and would make other keys of a bucket inexact in pandas
    nulls = [f"null_{i}" for i in range(len(key))]  # pandas gets other names for those that begin with _
    fields = ", ".join(f"`{k}` long" for k in (*key, *nulls))
    seen = rows.withWatermark("ts", late).select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket"), *[F.coalesce(k, F.lit(0)).alias(k) for k in key], *[F.col(k).isNull().cast("long").alias(n) for k, n in zip(key, nulls, strict=True)], "ts", "t", "v")
    told = seen.groupBy("_bucket").transformWithStateInPandas(_Support([*key, *nulls], gap), f"{fields}, event string, value string, at long", "Append", "EventTime")
    return told.select(*[F.when(F.col(n) == 0, F.col(k)).alias(k) for k, n in zip(key, nulls, strict=True)], "event", "value", "at")


def batch_support(rows: DataFrame, key: list[str], gap: int) -> DataFrame:
    """The same events of a whole table, in which everything lapses in the end."""
    w = Window.partitionBy(*key).orderBy("t", "v")
    away = F.col("t") - F.lag("t").over(w)
    marked = rows.select(*key, "t", "v", (away.isNull() | (away > gap) | (F.lag("v").over(w) != F.col("v"))).alias("starts"), (F.lead("t").over(w) - F.col("t")).alias("next"))
    lapses = F.col("next").isNull() | (F.col("next") > gap)
    events = F.array_compact(F.array(F.when(F.col("starts"), F.struct(F.lit("started").alias("event"), F.col("t").alias("at"))), F.when(lapses, F.struct(F.lit("expired").alias("event"), (F.col("t") + gap).alias("at")))))
    return marked.select(*key, F.explode(events).alias("e"), "v").select(*key, "e.event", F.col("v").alias("value"), "e.at")
