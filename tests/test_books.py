"""Book folders, dictionaries, bitmaps of all depths, deep pages, paged feeds, bounded lists."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.__main__ import main
from lectern.operators import catalog, grading, imaging, packaging, render, restore
from lectern.plans import cache
from lectern.sources import readers


def write_book(folder, title, style="after", image="../images/a.png", cover="images/c.png"):
    (folder / "chapters").mkdir(parents=True)
    (folder / "images").mkdir()
    (folder / "book.json").write_text(json.dumps({"title": title, "author": "Ann", "language": "en", "reading_style": style, "cover": cover, "chapters": [{"source": "chapters/one.md", "glossary": "one.tsv"}, {"source": "chapters/two.md"}]}))
    (folder / "chapters/one.md").write_text(f"# One\n\n{{cold|r}} text\n\n![fig]({image})")
    (folder / "chapters/two.md").write_text("# Two\n\nmore {hot|q}")
    (folder / "one.tsv").write_text("word\treading\tgloss\ncold\tr\tnot hot\n")
    for name in ("a", "c"):
        (folder / f"images/{name}.png").write_bytes(imaging.encode_png(np.zeros((2, 2), int), 2, 2))


def test_book_folders_become_archives(spark, tmp_path):
    write_book(tmp_path / "lib/x", "First")
    write_book(tmp_path / "lib/deep/y", "Second", "ruby")
    tables = readers.book_folders(spark, str(tmp_path / "lib"))
    assert tables["errors"].collect() == []
    made = render.assemble(tables)
    entries = {(r.folder.rsplit("/", 1)[1], r.name): bytes(r.data).decode(errors="replace") for r in render.archive_entries(made, "folder", "content").collect()}
    assert {n for f, n in entries if f == "x"} == {"mimetype", "META-INF/container.xml", "OEBPS/style.css", "OEBPS/content.opf", "OEBPS/nav.xhtml", "OEBPS/ch01.xhtml", "OEBPS/ch02.xhtml", "OEBPS/images/a.png", "OEBPS/images/c.png"}
    assert 'class="rd"' in entries["x", "OEBPS/ch01.xhtml"]
    assert "<ruby>" in entries["y", "OEBPS/ch01.xhtml"]
    assert "not hot" in entries["x", "OEBPS/ch01.xhtml"]
    assert 'properties="cover-image"' in entries["x", "OEBPS/content.opf"]
    assert render.archive_errors(render.archive_entries(made, "folder", "content"), "folder").collect() == []
    assert {(r.title, r.author) for r in packaging.epub_metadata(made, "folder", "content").collect()} == {("First", "Ann"), ("Second", "Ann")}


def test_what_a_book_folder_lacks(spark, tmp_path):
    write_book(tmp_path / "x", "First", image="../images/none.png", cover="../c.png")
    (tmp_path / "x/chapters/two.md").unlink()
    errors = {r.error for r in readers.book_folders(spark, str(tmp_path))["errors"].collect()}
    assert errors == {"chapters/one.md: missing image ../images/none.png", "cover: image outside the book ../c.png", "missing chapter chapters/two.md"}
    assert main(["build", str(tmp_path), str(tmp_path / "out")]) == 1
    write_book(tmp_path / "ok/z", "Third", style="odd")
    with pytest.raises(ValueError, match="reading style"):
        render.assemble(readers.book_folders(spark, str(tmp_path / "ok")))


def test_stages(spark, tmp_path):
    write_book(tmp_path / "books/x", "First")
    assert main(["build", str(tmp_path / "books"), str(tmp_path / "made")]) == 0
    assert spark.read.parquet(str(tmp_path / "made")).count() == 1
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "W_level1.json").write_text(json.dumps(["好", "早"]))
    (lists / "W_level2.json").write_text(json.dumps(["冷"]))
    (tmp_path / "d.json").write_text(json.dumps({"entries": [{"simplified": "好", "pinyin": "hao3", "definitions": ["good"]}, {"simplified": "好", "pinyin": "hao4", "definitions": ["to like", "see x", "fond"]}, {"simplified": "早", "pinyin": "zao3", "definitions": ["early"]}]}, ensure_ascii=False))
    assert main(["syllabus", str(lists), str(tmp_path / "list"), "--dictionary", str(tmp_path / "d.json"), "--bands", "1,2"]) == 0
    got = {r.word: (r.level, r.reading, r.gloss) for r in spark.read.parquet(str(tmp_path / "list")).collect()}
    assert got == {"好": ("HSK1", "hào", "to like; fond"), "早": ("HSK1", "zǎo", "early"), "冷": ("HSK2", "", "")}
    (tmp_path / "words.tsv").write_text("好\tL1\n早\tL1\n")
    (tmp_path / "idioms.tsv").write_text("好好早早\tL9\n")
    spark.createDataFrame([(1, "好"), (1, "早好"), (2, "好好早早"), (2, "冷")], "n int, token string").write.parquet(str(tmp_path / "tokens"))
    assert main(["grade", str(tmp_path / "tokens"), str(tmp_path / "graded"), "--lexicon", str(tmp_path / "words.tsv"), "--idioms", str(tmp_path / "idioms.tsv")]) == 0
    assert {r.token: r.tier for r in spark.read.parquet(str(tmp_path / "graded")).collect()} == {"好": "known", "早好": "composed", "好好早早": "chengyu", "冷": "flagged"}


@pytest.mark.parametrize("bpp", [1, 2, 4, 8])
@pytest.mark.parametrize("size", [(1, 1), (7, 3), (16, 5), (33, 2)])
def test_bitmaps_of_all_depths(spark, bpp, size):
    w, h = size
    levels = np.random.default_rng(w).integers(0, 4, (h, w))
    raw = imaging.encode_bmp(levels, w, h, bpp)
    rowlen = (w * bpp + 31) // 32 * 4
    assert len(raw) == 54 + 4 * (1 << bpp) + rowlen * h
    palette = [0, 255] if bpp == 1 else [0, 85, 170, 255] + [0] * ((1 << bpp) - 4)
    got = imaging.decode_bmp(raw, w, h, False, bpp, rowlen, 54 + 4 * (1 << bpp), palette)
    assert (got == (np.where(levels >= 2, 3, 0) if bpp == 1 else levels)).all()


def test_bitmap_headers_of_all_depths(spark):
    files = spark.createDataFrame([(bpp, imaging.encode_bmp(np.arange(12).reshape(3, 4) % 4, 4, 3, bpp)) for bpp in (1, 2, 4, 8)], "bpp int, content binary")
    heads = {r["bpp_"]: (r.width, r.height, r.native, r.error) for r in imaging.bmp_header(files.withColumnRenamed("bpp", "bpp_"), "bpp_", "content").collect()}
    assert {k: v[:2] + v[3:] for k, v in heads.items()} == {k: (4, 3, None) for k in (1, 2, 4, 8)}
    assert heads[2][2]


def test_deep_pages_are_those_of_the_top(spark, monkeypatch):
    books = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 11).alias("k")).repartition(5)
    order = [F.desc("k"), F.col("id")]
    shallow = {n: sorted(map(tuple, catalog.page(books, order, n, 24).collect())) for n in (1, 5, 21, 22)}
    last = sorted(map(tuple, catalog.page(books, order, 10**6, 24, clamp=True).collect()))
    monkeypatch.setattr(catalog, "TOP", 20)
    assert {n: sorted(map(tuple, catalog.page(books, order, n, 24).collect())) for n in shallow} == shallow
    assert sorted(map(tuple, catalog.page(books, order, 10**6, 24, clamp=True).collect())) == last
    assert len(last) == 500 - 20 * 24


def test_bounds_are_checked_before_anything_is_collected(spark, monkeypatch):
    rows = spark.range(30).select((F.col("id") % 2).alias("page"), F.lit("<e/>").alias("entry"), F.col("id").cast("double").alias("mtime"), F.col("id").alias("rn"))
    assert [r.xml.count("<e/>") for r in catalog.feeds(rows, ["page"], "f", "F", "rn").collect()] == [15, 15]
    assert catalog.feed(rows, "f", "F", "rn").first().xml.count("<e/>") == 30
    assert "<updated>1970-01-01" in catalog.feed(rows.limit(0), "f", "F", "rn").first().xml
    monkeypatch.setattr(catalog, "MOST_ENTRIES", 14)
    with pytest.raises(ValueError, match="over 14 entries"):
        catalog.feeds(rows, ["page"], "f", "F", "rn")
    words = spark.createDataFrame([("b", "1", "x"), ("a", "1", "x"), ("c", "9", "x"), ("d", "1", "personal")], "word string, level string, source string")
    assert sorted((r.band, r.place, r.word, r.n) for r in grading.band_words(words, ("1",), "other").collect()) == [("1", 0, "a", 2), ("1", 1, "b", 2), ("other", 0, "c", 1)]
    assert {r.band: r.words for r in grading.by_band(words, ("1",), "other").collect()} == {"1": ["a", "b"], "other": ["c"]}
    monkeypatch.setattr(grading, "MOST_SHOWN", 3)
    with pytest.raises(ValueError, match="over 3 rows"):
        grading.by_band(words, ("1",), "other")


def test_a_range_without_a_line_is_an_error(spark):
    lines = spark.createDataFrame([(1, 1, 0, "a", 0.0, 0.0, 1.0), (1, 2, 1, "b", 0.0, 0.0, 1.0)], "doc int, page int, pos int, text string, x0 double, top double, bottom double")
    policy = restore.Policy((restore.PageRange.parse("1-2", "body"), restore.PageRange.parse("9", "skip")))
    with pytest.raises(ValueError, match="doc 1: page range 9-9 matches no line"):
        restore.restore(lines, "doc", policy)
    assert restore.restore(lines, "doc", policy, strict=False)[0].count() == 1


def test_pinned_folders_go(spark, tmp_path):
    before = list(cache._pinned)
    cache._pinned.clear()
    from pathlib import Path

    held = cache.pinned(spark.range(3))
    [path] = cache._pinned
    assert held.count() == 3
    assert Path(path).exists()
    cache.release(spark)
    assert not Path(path).exists()
    cache._pinned.extend(before)
