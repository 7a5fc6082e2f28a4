"""State in streams, across restarts; snapshots; deliveries."""

import json
import threading

import pytest

from lectern.sources.snapshots import Conflict, SnapshotStore
from lectern.streaming import keyed, queue

SCHEMA = "update_id long, from_id long, message long, view string, worker string, at timestamp, kind string, payload string, names array<string>"


class Feed:
    """A stream of files, and a query that can be stopped and started again."""

    def __init__(self, spark, path, build):
        self.spark, self.path, self.build, self.n = spark, path, build, 0
        (path / "in").mkdir()

    def put(self, *rows):
        self.n += 1
        (self.path / "in" / f"{self.n}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def run(self):
        """All that has come since the last run, in a query of its own that ends."""
        rows = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))
        out = self.build(rows).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(str(self.path / "out")).orderBy("update_id").collect()


def test_handles_go_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda rows: keyed.handles(rows, 3))
    op = lambda n, kind, payload, owner=1: {"update_id": n, "from_id": owner, "kind": kind, "payload": payload}
    feed.put(op(2, "put", "b"), op(1, "put", "a"), op(3, "get", "t1"), op(4, "get", "t9"), op(5, "put", "x", 2))
    first = feed.run()
    assert [(r.owner, r.handle, r.value, r.answer) for r in first] == [(1, "t1", "a", "new"), (1, "t2", "b", "new"), (1, "t1", "a", "ok"), (1, "t9", None, "stale"), (2, "t1", "x", "new")]
    feed.put(op(6, "put", "é"), op(7, "put", "d"), op(8, "get", "t1"))
    feed.put(op(9, "get", "t2"), op(10, "get", "t3"), op(11, "get", None), op(12, "get", "t1", 2))
    rest = feed.run()[5:]
    assert [(r.handle, r.value, r.answer) for r in rest] == [("t3", "é", "new"), ("t4", "d", "new"), ("t1", None, "stale"), ("t2", "b", "ok"), ("t3", "é", "ok"), (None, None, "stale"), ("t1", "x", "ok")]


def test_selections_of_messages(spark, tmp_path):
    feed = Feed(spark, tmp_path, keyed.selections)
    op = lambda n, message, kind, payload=None, names=None: {"update_id": n, "from_id": 1, "message": message, "kind": kind, "payload": payload, "names": names}
    feed.put(op(1, 10, "toggle", "a"), op(2, 10, "show", names=["c", "a", "b", "a"]), op(3, 10, "toggle", "b"), op(4, 10, "toggle", "c"), op(5, 11, "show", names=["a"]))
    feed.run()
    feed.put(op(6, 10, "toggle", "b"), op(7, 10, "toggle", "z"), op(8, 11, "all"), op(9, 10, "show", names=["b", "c", "d"]), op(10, 10, "all"), op(11, 10, "none"), op(12, 11, "close"), op(13, 11, "toggle", "a"))
    got = [(r.message, r.selected, r.answer) for r in feed.run()]
    assert got == [
        (10, [], "stale"), (10, [], "ok"), (10, ["b"], "ok"), (10, ["c", "b"], "ok"), (11, [], "ok"), (10, ["c"], "ok"), (10, ["c"], "unknown"), (11, ["a"], "ok"),
        (10, ["c"], "ok"), (10, ["b", "c", "d"], "ok"), (10, [], "ok"), (11, [], "ok"), (11, [], "stale"),
    ]


def test_an_expired_view_is_built_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda rows: keyed.refreshed_views(rows, 2.0))
    op = lambda n, second, kind, payload=None: {"update_id": n, "view": "all", "at": f"2024-01-01T00:00:{second:06.3f}Z", "kind": kind, "payload": payload}
    feed.put(op(1, 0, "add", "b"), op(2, 1, "ask"), op(3, 1.5, "add", "a"), op(4, 2.9, "ask"))
    feed.put(op(5, 3, "ask"), op(6, 3.1, "ask"), op(7, 3.2, "remove", "b"))
    feed.run()
    feed.put(op(8, 20, "ask"), op(9, 21.9, "ask"), op(10, 22, "ask"))
    got = [(r.update_id, r.version, r["items"], r.rebuilt) for r in feed.run()]
    assert got == [(2, 1, ["b"], True), (4, 1, ["b"], False), (5, 2, ["a", "b"], True), (6, 2, ["a", "b"], False), (8, 3, ["a"], True), (9, 3, ["a"], False), (10, 4, ["a"], True)]


def test_jobs_run_one_at_a_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda rows: keyed.jobs(rows, 60.0))
    op = lambda n, second, kind, payload, worker="w": {"update_id": n, "worker": worker, "at": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "kind": kind, "payload": payload}
    feed.put(op(1, 0, "submit", "a"), op(2, 1, "submit", "b"), op(3, 2, "submit", "c"), op(4, 2, "submit", "z", "other"))
    feed.run()
    feed.put(op(5, 10, "done", "b"), op(6, 11, "failed", "a"), op(7, 12, "submit", "d"))
    feed.put(op(8, 300, "submit", "e", "other"))  # b never reports: its lease ends, and c begins
    feed.put(op(9, 301, "submit", "f", "other"))
    got = [(r.worker, r.job, r.event) for r in feed.run()]
    mine = [(j, e) for w, j, e in got if w == "w"]
    # a lost job's successor gets a lease of its own; how many have ended by now depends on the batches that have run
    whole = [("a", "start"), ("b", "ignored"), ("a", "failed"), ("b", "start"), ("b", "lost"), ("c", "start"), ("c", "lost"), ("d", "start"), ("d", "lost")]
    assert len(mine) >= 6
    assert sorted(mine) == sorted(whole[: len(mine)])
    assert ("other", "z", "start") in got


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "table"))
    assert store.current() == 0
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = spark.range(3)
    assert store.commit(rows) == 1
    held = store.read()
    assert store.commit(store.read().where("id > 0")) == 2  # made from the table itself
    assert (held.count(), store.read().count(), store.read(1).count()) == (3, 2, 3)
    with pytest.raises(Conflict):
        store.commit(rows, base=1)
    assert store.current() == 2
    (tmp_path / "table/_manifests/000000000003.json").write_text('{"folder": "snapsh')  # a writer that died
    assert store.current() == 2
    assert store.read().count() == 2
    assert store.commit(spark.range(7)) == 4
    store.vacuum(1)
    assert store.read().count() == 7
    assert len(list((tmp_path / "table").glob("snapshot-*"))) == 1
    assert SnapshotStore(spark, str(tmp_path / "table")).current() == 4


def test_a_reader_at_any_step_sees_a_whole_table(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "table"))
    store.commit(spark.range(1))
    seen, real = [], store._at

    def look(name):  # each path that the writer works with is a step
        if not look.busy:
            look.busy = True
            seen.append(SnapshotStore(spark, str(tmp_path / "table")).read().count())
            look.busy = False
        return real(name)

    look.busy = False
    monkeypatch.setattr(store, "_at", look)
    store.commit(spark.range(5))
    monkeypatch.undo()
    assert set(seen) <= {1, 5}
    assert len(seen) > 2
    assert store.read().count() == 5


def test_of_two_writers_one_loses(spark, tmp_path):
    path, out = str(tmp_path / "table"), []
    SnapshotStore(spark, path).commit(spark.range(1))
    stores = [SnapshotStore(spark, path) for _ in range(2)]
    wait = threading.Barrier(2)

    def write(store, n):
        df = spark.range(n)
        wait.wait()
        try:
            out.append(("won", store.commit(df, base=1), n))
        except Conflict:
            out.append(("lost", None, n))

    threads = [threading.Thread(target=write, args=(s, n)) for s, n in zip(stores, (10, 20), strict=True)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(o[0] for o in out) == ["lost", "won"]
    assert SnapshotStore(spark, path).read().count() == next(o[2] for o in out if o[0] == "won")


def test_an_epoch_is_delivered_once(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def deliver(batch):
        def send(frames):
            for df in frames:
                for item in df["item"]:
                    with open(sent / item, "a") as f:
                        f.write("x")
                yield df.assign(ok=True)

        return batch.select("item").mapInPandas(send, "item string, ok boolean")

    items = lambda *names: spark.createDataFrame([(n,) for n in names], "item string")
    for _ in range(2):
        queue.deliver_once(items("a", "b", "b"), 0, deliver, str(tmp_path / "led"), "item")
    queue.deliver_once(items("a", "b", "c"), 0, deliver, str(tmp_path / "led"), "item")  # a part had failed
    queue.deliver_once(items("a"), 1, deliver, str(tmp_path / "led"), "item")
    rows = spark.read.parquet(str(tmp_path / "led")).collect()
    assert sorted((r.epoch, r["item"], r.ok) for r in rows) == [(0, "a", True), (0, "b", True), (0, "c", True), (1, "a", True)]
    assert {p.name: p.read_text() for p in sent.iterdir()} == {"a": "xx", "b": "x", "c": "x"}
    for _ in range(2):
        queue.deliver_once(items("w"), 0, deliver, str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 1
    assert (sent / "w").read_text() == "x"
