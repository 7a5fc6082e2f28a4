import json

from pyspark.sql import functions as F

from lectern.sources import readers, sinks
from lectern.streaming import queue


def test_lexicon_rows(spark, tmp_path):
    f = tmp_path / "list.tsv"
    f.write_text("  # note\n\nword\tlevel\tpinyin\tgloss\n好\tL1\thǎo\tgood\n早\tL2\n好\tL3\thào\tlike\n")
    rows = readers.lexicon(spark, str(f), "graded").orderBy("line").collect()
    assert [(r.word, r.level, r.reading, r.gloss) for r in rows] == [("好", "L1", "hǎo", "good"), ("早", "L2", "", ""), ("好", "L3", "hào", "like")]
    assert {r.word: r.gloss for r in readers.glossary_map(readers.lexicon(spark, str(f), "x")).collect()} == {"好": "like", "早": ""}


def test_expressions(spark, tmp_path):
    f = tmp_path / "e.tsv"
    f.write_text("太…了\tL2\t\ttoo\t太.+了\n没关系\tL1\t\tnever mind\n")
    assert [(r.expression, r.regex) for r in readers.expressions(spark, str(f)).orderBy("line").collect()] == [("太…了", "太.+了"), ("没关系", None)]


def test_pages_last_line_wins(spark, tmp_path):
    f = tmp_path / "pages.jsonl"
    f.write_text("\n".join(json.dumps({"page": p, "width": w, "lines": [{"text": "a", "x0": 1.0}]}) for p, w in ((1, 5.0), (2, 6.0), (1, 7.0))))
    assert {(r.page, r.width) for r in readers.pages(spark, str(f)).collect()} == {(1, 7.0), (2, 6.0)}


def test_book_settings_and_files(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"title": "T", "author": "A", "chapters": [{"source": "a.md"}, {"source": "b.md", "source_md": "b0.md"}]}))
    assert [(r.chapter, r.source) for r in readers.book(spark, str(tmp_path / "book.json")).orderBy("pos").collect()] == [("ch01", "a.md"), ("ch02", "b0.md")]
    rows = spark.createDataFrame([('[{"key":"a","value":"1"}]',), ('{"a":"1"}',)], "s string")
    assert [r.settings for r in readers.settings(rows, "s").collect()] == [{"a": "1"}, {"a": "1"}]
    (tmp_path / "sub").mkdir()
    for n in ("x.epub", "sub/y.epub", "sub/skip.epub", "z.txt"):
        (tmp_path / n).write_text("x")
    assert sorted(r.rel for r in readers.files(spark, str(tmp_path), "*.epub", ("sk*",)).collect()) == ["sub/y.epub", "x.epub"]


def test_words_to_lines(spark):
    rows = [(1, 1, 1, 1, 50, 10, 20, 8, "b", 80.0), (1, 1, 1, 1, 10, 12, 20, 8, "a", 90.0), (1, 1, 1, 1, 0, 0, 1, 1, " ", 99.0), (1, 1, 1, 2, 0, 0, 1, 1, "x", -1.0)]
    out = readers.words_to_lines(spark.createDataFrame(rows, "page int, block int, par int, line int, left int, top int, width int, height int, text string, conf double"), 72).collect()
    assert [(r.text, r.x0, r.x1, r.conf) for r in out] == [("a b", 10.0, 70.0, 85.0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "r", "g"), (1, "a", "r", "g")], "pos int, word string, reading string, gloss string")
    sinks.write_glossary(rows, str(tmp_path / "g"))
    part = next((tmp_path / "g").glob("part-*"))
    assert part.read_text().splitlines() == ["word\treading\tgloss", "a\tr\tg", "b\tr\tg"]
    sinks.write_reports(rows.withColumn("_x", F.lit(1)), str(tmp_path / "r"))
    assert all("_x" not in r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    sinks.staged_overwrite(table.where("pos = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_queue_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    updates = [(1, 7, 7, "add", "a"), (2, 7, None, "add", "b"), (3, 8, 8, "add", "evil"), (4, 7, 9, "add", "other chat"), (5, 7, 7, "remove", "a")]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("update_id", "from_id", "chat_id", "kind", "payload"), u, strict=True))) for u in updates))
    rows = queue.whitelisted(queue.updates(spark, str(src)), 7)
    q = queue.queue_sizes(rows).writeStream.outputMode("update").format("memory").queryName("queue_state").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (src / "2.json").write_text(json.dumps({"update_id": 6, "from_id": 7, "chat_id": 7, "kind": "add", "payload": "c"}))
    q.processAllAvailable()
    q.stop()
    assert [r["items"] for r in spark.sql("SELECT * FROM queue_state ORDER BY n, items").collect()] == [["b"], ["b", "c"]]


def test_drain_stream_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"update_id":1,"from_id":7,"kind":"add","payload":"a"}')
    q = queue.drain_batches(queue.updates(spark, str(src)), lambda b: b.select("payload", F.lit(True).alias("ok")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [(r.payload, r.ok) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", True)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert queue.windowed_counts(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()
