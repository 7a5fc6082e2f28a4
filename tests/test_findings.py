"""What was once wrong or failed on larger tables."""

import re
import uuid

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import grading, imaging, integrity, packaging, render, titles


def test_a_feed_stays_behind_its_entries(spark):
    entry = '<entry><title>T%d</title><id>%d</id><link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="/b%d.epub"/></entry>'
    xml = '<feed><link rel="next" href="/p2"/>' + "".join(entry % (n, n, n) for n in range(50)) + "</feed>"
    out = packaging.parse_feed(spark.createDataFrame([("f", xml)], "feed string, xml string"), "feed", "xml")
    assert sorted((r.pos, r.title, r.href, r.next) for r in out.collect()) == [(n, f"T{n}", f"/b{n}.epub", "/p2") for n in range(50)]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]  # what is done for each entry
    assert not re.search(r"\bxml#", above)


def test_years_of_five_digits_have_no_sign(spark):
    seconds = [253402300799.0, 253402300800.0, 5999999 * 86413.7]
    got = spark.createDataFrame([(s,) for s in seconds], "s double").select(T.rfc3339(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "18400-01-17T09:19:46Z"]


def test_only_closed_references(spark):
    page = "<body>a&amp;b&amp &amp;lt; &#39;&#x41; &eacute; &notit; &nosuch; &copy</body>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "x")], "id int, html string")
    assert {r.id: r.body_text for r in integrity.page_text(rows, "id", "html", closed=True).collect()} == {1: "a&b&amp &lt; 'A é &notit; &nosuch; &copy", 2: None, 3: "x"}
    assert integrity.page_text(rows, "id", "html").first().body_text == "a&b& &lt; 'A é ¬it; &nosuch; ©"


def test_a_brief_takes_a_word_list_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(grading, "MOST_SHOWN", 3)
    monkeypatch.setattr(grading, "PIECE", 2)
    outline = spark.createDataFrame([(1, 1, "A", "first", None), (1, 2, "B", "second", None)], "book int, n int, title string, summary string, recap string")
    known = spark.createDataFrame([], "book int, pos int, word string")
    words = [(f"w{n}", "E" if n % 3 == 0 else "X", "book" if n > 4 else "graded", "r", "g") for n in (3, 9, 1, 7, 5, 8, 0)]
    lexicon = spark.createDataFrame(words, "word string, level string, source string, reading string, gloss string")
    [r] = grading.brief(outline, "book", 2, known, lexicon, grading.Gates(0.05, 0.01, 0.15, 800, 5), ("E",), "SUP").collect()
    topic = "\n".join(f"- **w{n}** r — g" for n in (5, 7, 8, 9))
    assert r.brief.endswith(f"## Topic words\n{topic}\n\n## Vocabulary\n### E  (3 words)\nw0、w3、w9\n### SUP  (4 words)\nw1、w5、w7、w8")


def _briefs(spark, books):
    outline = spark.range(books).select(F.col("id").alias("book"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.lit("A").alias("title"), F.format_string("s%d", "id").alias("summary"), F.lit(None).cast("string").alias("recap"))
    known = spark.createDataFrame([], "book long, pos int, word string")
    lexicon = spark.range(30_000).select(F.concat(F.element_at(F.array(*map(F.lit, ("blue ring", "cold plate", "hot bolt"))), (F.hash("id") % 3 + 3).cast("int") % 3 + 1), "id").alias("word"), F.lit("X").alias("level"), F.lit("graded").alias("source"), F.lit("r").alias("reading"), F.lit("g").alias("gloss"))
    return grading.brief(outline, "book", 2, known, lexicon, grading.Gates(0.05, 0.01, 0.15, 800, 5), ("E",), "SUP")


def test_briefs_are_packed_and_dealt_out(spark, tmp_path):
    own = spark.newSession()
    own.conf.unset("spark.sql.parquet.compression.codec")
    out = _briefs(own, 40)
    out.write.parquet(str(tmp_path / "out"))
    files = [f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")]
    rows = own.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.select("book").distinct().count() == 40
    assert rows.agg(F.sum(F.octet_length("brief"))).first()[0] > 8 * sum(files)
    assert max(files) < sum(files) / 3  # not all by one task


def test_a_codec_chosen_by_the_caller_stays(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.compression.codec", "gzip")
    _briefs(own, 1)
    assert own.conf.get("spark.sql.parquet.compression.codec") == "gzip" and own.conf.get("parquet.block.size", None) is None


def test_titles_are_fitted_by_their_text(spark):
    rows = spark.createDataFrame([(1, "ab"), (1, "cd"), (None, "ef"), (2, "ab"), (3, None)], "n int, t string")
    glyphs = spark.createDataFrame([(c, 0.5) for c in "abcdef "], "ch string, width double")
    got = [(r.n, r.lines) for r in titles.fit_titles(rows, "n", "t", glyphs, 200, 100, 0.8, 0.2).collect()]
    assert sorted(got, key=repr) == sorted([(1, ["ab"]), (1, ["cd"]), (None, ["ef"]), (2, ["ab"]), (3, [])], key=repr)


def test_archives_are_made_once_for_all_checks(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def once(batches):
        for df in batches:
            for k in df["book"]:
                (made / f"{k}-{uuid.uuid4()}").touch()
            yield df

    book = render.archive("T", "A", "en", [("One", '<p id="a">x</p><a href="#b">y</a>')], {})
    files = spark.createDataFrame([(1, book), (2, book[:40])], "book int, content binary")
    entries = render.archive_entries(files, "book", "content").mapInPandas(once, "book int, pos int, name string, stored boolean, data binary")
    errors = render.archive_errors(entries.withColumn("data", F.when(F.col("name") != "OEBPS/style.css", F.col("data"))), "book")
    assert [(r.book, r.error) for r in errors.collect()] == [(1, "OEBPS/ch01.xhtml dead fragment #b")]
    assert len(list(made.iterdir())) == 6


def test_files_are_made_once_for_their_pixels(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def once(batches):
        for df in batches:
            for k in df["image"]:
                (made / f"{k}-{uuid.uuid4()}").touch()
            yield df

    photos = spark.createDataFrame([(k, 4, 3, [(k * 37 + n * 20) % 256 for n in range(12)]) for k in range(3)], "image int, w int, h int, pixels array<int>")
    files = imaging.wallpapers(photos, "none", "edges", 8, 6).mapInPandas(once, "image int, content binary")
    assert sorted((r.image, r.w, r.h, len(r.levels)) for r in imaging.bmp_levels(files, "image", "content").collect()) == [(k, 8, 6, 48) for k in range(3)]
    assert len(list(made.iterdir())) == 3
