"""State that lives in a stream, by key: numbered handles, selections of a message, refreshed views, jobs handed to a worker.

Each operator is a stateful processor with map state (one entry an item, so that an update rewrites one entry, not the
key's whole state) and, where time matters, event-time timers. A batch's rows of a key are applied in the order of their
update_id, however batches are cut; after a restart the checkpoint's state goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, mode: str = "None") -> DataFrame:
    # state of several named parts needs the store that keeps them apart
    rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=mode)


def _ordered(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    every = pd.concat(list(batches)).sort_values("update_id", kind="stable")
    return list(every[list(columns)].astype(object).where(every[list(columns)].notna(), None).itertuples(index=False, name=None))


def _frame(rows: list[tuple], out: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])


class _Handles(StatefulProcessor):
    out = "owner long, update_id long, handle string, value string, answer string"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getValueState("given", "n long")
        self.held = handle.getMapState("held", "handle string", "value string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n, out = self.given.get()[0] if self.given.exists() else 0, []
        for kind, payload, update in _ordered(rows, "kind", "payload", "update_id"):
            if kind == "put":
                n += 1
                self.held.updateValue((f"t{n:x}",), (payload,))
                self.held.removeKey((f"t{n - self.limit:x}",)) if n > self.limit else None
                out.append((key[0], update, f"t{n:x}", payload, "new"))
            elif kind == "get":
                value = self.held.getValue((payload,)) if payload and self.held.containsKey((payload,)) else None
                out.append((key[0], update, payload, value and value[0], "ok" if value else "stale"))
        self.given.update((n,))
        yield _frame(out, self.out)

    def close(self) -> None:
        pass


def handles(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """Short handles for long values, per owner (from_id): 'put' numbers its payload (t1, t2, ...), 'get' looks a handle up.

    Only the newest ``limit`` values are held: the oldest goes when another comes. Rows: owner, update_id, handle, value,
    answer ('new', 'ok', or 'stale' for a handle that isn't held any more or never was). Numbers are never given twice.
    """
    return _keyed(rows, ["from_id"], _Handles(limit), _Handles.out)


class _Selection(StatefulProcessor):
    out = "owner long, message long, update_id long, selected array<string>, answer string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getListState("shown", "name string")
        self.chosen = handle.getMapState("chosen", "name string", "yes boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        for kind, payload, names, update in _ordered(rows, "kind", "payload", "names", "update_id"):
            listed = [n for (n,) in self.shown.get()] if self.shown.exists() else None
            answer = "ok"
            if kind == "show":
                listed = list(dict.fromkeys(names if names is not None else []))
                self.shown.put([(n,) for n in listed])
                for (n,) in list(self.chosen.keys()):
                    if n not in set(listed):
                        self.chosen.removeKey((n,))
            elif listed is None:
                answer = "stale"
            elif kind == "close":
                self.shown.clear()
                self.chosen.clear()
                listed = []
            elif kind in ("all", "none"):
                self.chosen.clear()
                for n in listed if kind == "all" else []:
                    self.chosen.updateValue((n,), (True,))
            elif payload not in listed:
                answer = "unknown"
            elif self.chosen.containsKey((payload,)):
                self.chosen.removeKey((payload,))
            else:
                self.chosen.updateValue((payload,), (True,))
            picked = {n for (n,) in self.chosen.keys()} if listed else set()
            out.append((*key, update, [n for n in listed or [] if n in picked], answer))
        yield _frame(out, self.out)

    def close(self) -> None:
        pass


def selections(rows: DataFrame) -> DataFrame:
    """What is ticked off on each message (from_id, message): 'show' lists its ``names``, 'toggle' ticks or unticks the payload.

    'all', 'none' and 'close' do what they say; a message that is shown again keeps the ticks of names it still has. A
    row an update: the selection in the order shown, and 'ok', 'unknown' (a name that isn't listed) or 'stale' (a message
    that isn't shown).
    """
    return _keyed(rows, ["from_id", "message"], _Selection(), _Selection.out)


def _millis(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class _View(StatefulProcessor):
    out = "view string, update_id long, version long, items array<string>, rebuilt boolean"

    def __init__(self, ttl: float):
        self.ttl = int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.there = handle.getMapState("there", "item string", "yes boolean")
        self.built = handle.getValueState("built", "at long, version long")
        self.seen = handle.getListState("seen", "item string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        at, version = self.built.get() if self.built.exists() else (None, 0)
        items = [n for (n,) in self.seen.get()] if self.seen.exists() else None
        out = []
        for kind, payload, when, update in _ordered(rows, "kind", "payload", "at", "update_id"):
            now = _millis(when)
            if kind == "add":
                self.there.updateValue((payload,), (True,))
            elif kind == "remove":
                self.there.removeKey((payload,))
            elif kind == "ask":
                due = items is None or now - at >= self.ttl
                if due:
                    at, version, items = now, version + 1, sorted(n for (n,) in self.there.keys())
                    self.seen.put([(n,) for n in items])
                    self.handle.registerTimer(now + self.ttl)
                out.append((key[0], update, version, items, due))
        if at is not None:
            self.built.update((at, version))
        yield _frame(out, self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """The copy of an expired view is dropped; the next question builds it anew."""
        if self.built.exists() and self.built.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        yield _frame([], self.out)

    def close(self) -> None:
        pass


def refreshed_views(rows: DataFrame, ttl: float = 2.0, late: str = "0 seconds") -> DataFrame:
    """Views that are built when somebody asks, and again when the last build is ``ttl`` seconds old.

    Rows: view, update_id, at (event time), kind and payload: 'add' and 'remove' change what there is, 'ask' reads. What
    changes after a build shows after the next one only. A row an 'ask': the view's version and items, and whether it
    was built for it.
    """
    return _keyed(rows.withWatermark("at", late), ["view"], _View(ttl), _View.out, "EventTime")


class _Jobs(StatefulProcessor):
    out = "worker string, update_id long, job string, event string"

    def __init__(self, lease: float):
        self.lease = int(lease * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "first long, next long")
        self.waiting = handle.getMapState("waiting", "n long", "job string")
        self.running = handle.getValueState("running", "job string, until long")

    def _start(self, now: int) -> str | None:
        """The oldest job that waits, if no other runs."""
        first, following = self.numbers.get() if self.numbers.exists() else (0, 0)
        if self.running.exists() or first == following:
            return None
        job = self.waiting.getValue((first,))[0]
        self.waiting.removeKey((first,))
        self.numbers.update((first + 1, following))
        self.running.update((job, now + self.lease))
        self.handle.registerTimer(now + self.lease)
        return job

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        for kind, payload, when, update in _ordered(rows, "kind", "payload", "at", "update_id"):
            now = _millis(when)
            if kind == "submit":
                first, following = self.numbers.get() if self.numbers.exists() else (0, 0)
                self.waiting.updateValue((following,), (payload,))
                self.numbers.update((first, following + 1))
            elif kind in ("done", "failed") and self.running.exists() and self.running.get()[0] == payload:
                out.append((key[0], update, payload, kind))
                self.running.clear()
            elif kind in ("done", "failed"):
                out.append((key[0], update, payload, "ignored"))
            job = self._start(now)
            if job is not None:
                out.append((key[0], update, job, "start"))
        yield _frame(out, self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        out, now = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.running.exists() and self.running.get()[1] <= now:
            out.append((key[0], None, self.running.get()[0], "lost"))
            self.running.clear()
            job = self._start(now)
            if job is not None:
                out.append((key[0], None, job, "start"))
        yield _frame(out, self.out)

    def close(self) -> None:
        pass


def jobs(rows: DataFrame, lease: float = 900.0, late: str = "0 seconds") -> DataFrame:
    """Jobs handed to workers one at a time, in the order submitted.

    Rows: worker, update_id, at (event time), kind ('submit', 'done', 'failed'), payload (the job). A row an event:
    'start' when a job's turn comes, 'done' or 'failed' as reported (either way the next one starts), 'ignored' for a
    report of a job that doesn't run, 'lost' when none came within ``lease`` seconds.
    """
    return _keyed(rows.withWatermark("at", late), ["worker"], _Jobs(lease), _Jobs.out, "EventTime")
