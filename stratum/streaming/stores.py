"""Keyed stores of items as streams with state: saves, removals, the latest item, and jobs that stall. The same for a batch.

An event is key, item, at (timestamp), seq, op ('save' or 'remove') and body. For each item the event of the greatest at and seq
counts, whenever it comes: later ones change it, earlier and repeated ones don't, and a removal stays as a tombstone, so
that a late save doesn't bring the item back. So a stream says what the batch says, however it is cut. The state of a key
is a map of items (so that one event reads and writes one item), the changes so far, and the latest item, which, when
removed, gives way to the next latest. A timer clears a tombstone when the watermark has passed it: nothing older comes.
Where the latest item and the number of items needn't be told with each change, `item_changes` keeps the same items as a
streaming aggregate, without a call from Python for each.

Defined results: events without key, item, at or seq are left out; ops beside 'save' and 'remove' are too; equal at and seq
of one item count once, with the greatest op and body; created is the first save after the last removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGE = "key string, change long, item string, present boolean, created timestamp, updated timestamp, body string, latest string, n_items long"
#: at and seq of the event that counts, whether it is a save, its body, and when it was saved since the last removal, in microseconds.
_ITEM = "at long, seq long, saved boolean, body string, saves array<long>, removed long"
RETAINED = "7 days"


#: The store that keeps state on disk, and its batches as what they change, not as files of their own.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def with_state(spark: SparkSession) -> None:
    """Maps, lists and timers need the store that keeps state on disk; a session that runs these streams asks for it."""
    for name, value in STATE.items():
        spark.conf.set(name, value)


def usable(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("item").cast("string").alias("item"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "op", "body")
    return rows.filter("key IS NOT NULL AND item IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL AND op IN ('save', 'remove')")


def _micros(value) -> int:
    return pd.Timestamp(value).value // 1000


def _time(value: int | None) -> pd.Timestamp | None:
    return None if value is None else pd.Timestamp(value * 1000)


def applied(old: tuple | None, at: int, seq: int, op: str, body: str | None) -> tuple:
    """An item after one more event: what counts is the greatest at and seq; saves not after the last removal don't count as its."""
    here, number, saved, text, saves, removed = old or (-(1 << 62), -1, False, None, [], -(1 << 62))
    if op == "remove":
        removed = max(removed, at)
    else:
        saves = sorted({*saves, at})
    saves = [s for s in saves if s >= removed]
    if (at, seq, op == "save", body or "") >= (here, number, saved, text or ""):
        here, number, saved, text = at, seq, op == "save", body if op == "save" else None
    return here, number, saved, text, list(saves), removed


class _Store(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", _ITEM)
        self.of_key = handle.getValueState("of_key", "changes long, latest string, latest_at long, n long")

    def _next_latest(self) -> tuple[str | None, int]:
        """The saved item with the greatest time, then name: read anew only when the latest is gone."""
        best: tuple[int, str] | None = None
        for (item,), own in self.items.iterator():
            if own[2]:
                best = max(best, (own[0], item)) if best else (own[0], item)
        return (best[1], best[0]) if best else (None, -(1 << 62))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes, latest, latest_at, n = self.of_key.get() if self.of_key.exists() else (0, None, -(1 << 62), 0)
        # each item is read once and written once a batch, whatever its events: a call of the store takes longer than all of them
        touched: dict[str, tuple | None] = {}
        states: dict[str, tuple | None] = {}
        for frame in rows:
            for item, at, seq, op, body in zip(frame["item"], frame["at"], frame["seq"], frame["op"], frame["body"]):
                if item not in touched:
                    old = self.items.getValue((item,))
                    touched[item] = states[item] = None if old is None else (*old[:4], list(old[4]), old[5])
                states[item] = applied(states[item], _micros(at), int(seq), op, body)
        changed = [item for item in sorted(touched) if touched[item] != states[item]]
        for item in changed:
            self.items.updateValue((item,), states[item])
        out = []
        for item in changed:
            before, now = touched[item], states[item]
            n += int(now[2]) - int(before is not None and before[2])
            if now[2] and (now[0], item) >= (latest_at, latest or ""):
                latest, latest_at = item, now[0]
            elif item == latest and not now[2]:
                latest, latest_at = self._next_latest()
            if not now[2]:
                self.handle.registerTimer(now[0] // 1000)
            changes += 1
            out.append((item, now, changes))
        self.of_key.update((changes, latest, latest_at, n))
        if out:
            yield pd.DataFrame(
                [(key[0], c, item, now[2], _time(min(now[4])) if now[2] and len(now[4]) else None, _time(now[0]), now[3] if now[2] else None, latest, n) for item, now, c in out],
                columns=["key", "change", "item", "present", "created", "updated", "body", "latest", "n_items"],
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark is beyond a removal: no older event comes, and its tombstone goes."""
        passed = expiredTimerInfo.getExpiryTimeInMs()
        for item in [i for (i,), own in self.items.iterator() if not own[2] and own[0] // 1000 <= passed]:
            self.items.removeKey((item,))
        return iter(())

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = RETAINED) -> DataFrame:
    """A stream's CHANGE rows: each item that a batch of events changed, as it is then, with the key's latest item and number of items."""
    rows = usable(events).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Store(), CHANGE, "Update", "EventTime")


def current(changed: DataFrame) -> DataFrame:
    """key, item, created, updated, body, is_latest of the items that are there after all changes."""
    last = changed.groupBy("key", "item").agg(F.max_by(F.struct("present", "created", "updated", "body"), "change").alias("now"))
    # the latest item is what the key's last change says
    newest = changed.groupBy(F.col("key").alias("of")).agg(F.max_by("latest", "change").alias("latest"))
    rows = last.filter("now.present").join(newest, F.col("key") == F.col("of"))
    return rows.select("key", "item", "now.created", "now.updated", "now.body", (F.col("item") == F.col("latest")).alias("is_latest"))


def _items(events: DataFrame) -> DataFrame:
    """key, item, present, created, updated, body of each item that events name, of a batch or as a streaming aggregate."""
    told = usable(events).groupBy("key", "item").agg(
        F.max(F.struct("at", "seq", (F.col("op") == "save").alias("saved"), F.when(F.col("op") == "save", F.coalesce("body", F.lit(""))).alias("b"), F.when(F.col("op") == "save", F.col("body")).alias("body"))).alias("now"),
        F.max(F.when(F.col("op") == "remove", F.col("at"))).alias("removed"), F.collect_set(F.when(F.col("op") == "save", F.col("at"))).alias("saves"),
    )
    created = F.array_min(F.filter("saves", lambda s: F.col("removed").isNull() | (s >= F.col("removed"))))
    return told.select("key", "item", F.col("now.saved").alias("present"), created.alias("created"), F.col("now.at").alias("updated"), F.col("now.body").alias("body"))


def _there(items: DataFrame) -> DataFrame:
    there = items.filter("present").select("key", "item", "created", "updated", "body")
    latest = there.groupBy("key").agg(F.max(F.struct("updated", "item")).alias("l")).select("key", F.col("l.item").alias("latest"))
    return there.join(latest, "key").select("key", "item", "created", "updated", "body", (F.col("item") == F.col("latest")).alias("is_latest"))


def stored(events: DataFrame) -> DataFrame:
    """The same rows from a batch of events."""
    return _there(_items(events))


ITEM_CHANGE = "key string, item string, present boolean, created timestamp, updated timestamp, body string, change long"


def item_changes(events: DataFrame) -> DataFrame:
    """A stream's ITEM_CHANGE rows without their change, the number of the batch: each item that a batch of events names, as it is then.

    The items' state is a streaming aggregate, which Spark reads and writes without Python, for streams whose readers find the
    latest item of a key themselves (`items_current`). No event is too late for it, and its tombstones stay.
    """
    return _items(events)


def items_current(changed: DataFrame) -> DataFrame:
    """What `current` gives, of ITEM_CHANGE rows; a batch that came twice counts once."""
    last = changed.groupBy("key", "item").agg(F.max_by(F.struct("present", "created", "updated", "body"), "change").alias("now"))
    return _there(last.select("key", "item", "now.*"))


PROGRESS = "job string, change long, stages long, done long, failed long, status string, updated timestamp"


class _Progress(StatefulProcessor):
    """Stages of a job by name, and a timer that is moved on with each event: one that expires says that the job stalls."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", "at long, seq long, status string")
        self.seen = handle.getValueState("seen", "changes long, at long")

    def _told(self, job: str, stalls: bool) -> pd.DataFrame:
        changes, at = self.seen.get()
        states = [own[2] for _, own in self.stages.iterator()]
        done, failed = states.count("done"), states.count("failed")
        status = "failed" if failed else "done" if done == len(states) else "stalled" if stalls else "running"
        self.seen.update((changes + 1, at))
        return pd.DataFrame([(job, changes + 1, len(states), done, failed, status, _time(at))], columns=["job", "change", "stages", "done", "failed", "status", "updated"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes, last = self.seen.get() if self.seen.exists() else (0, -(1 << 62))
        for frame in rows:
            for stage, at, seq, status in zip(frame["stage"], frame["at"], frame["seq"], frame["status"]):
                new = (_micros(at), int(seq), status)
                if not self.stages.containsKey((stage,)) or tuple(self.stages.getValue((stage,))) < new:
                    self.stages.updateValue((stage,), new)
                last = max(last, new[0])
        self.seen.update((changes, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.patience)
        yield self._told(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._told(key[0], True)

    def close(self) -> None:
        pass


def progress_changes(events: DataFrame, late: str = "1 hour", patience_ms: int = 3_600_000) -> DataFrame:
    """A stream's PROGRESS rows of events (job, stage, at, seq, status): after each batch, and when the watermark passes a job's last event by patience_ms."""
    rows = events.filter("job IS NOT NULL AND stage IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL AND status IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("job").transformWithStateInPandas(_Progress(patience_ms), PROGRESS, "Update", "EventTime")


def progress(events: DataFrame) -> DataFrame:
    """job, stages, done, failed, status, updated after all events of a batch, of which none stalls."""
    rows = events.filter("job IS NOT NULL AND stage IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL AND status IS NOT NULL")
    last = rows.groupBy("job", "stage").agg(F.max(F.struct("at", "seq", "status")).alias("now"))
    told = last.groupBy("job").agg(F.count("*").alias("stages"), F.count_if(F.col("now.status") == "done").alias("done"), F.count_if(F.col("now.status") == "failed").alias("failed"), F.max("now.at").alias("updated"))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("done") == F.col("stages"), "done").otherwise("running")
    return told.select("job", "stages", "done", "failed", status.alias("status"), "updated")
