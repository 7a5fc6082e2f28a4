"""Operators without SQL against plain versions, and cases that the driver's tables don't hold."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import catalog, draft, fidelity, grading, imaging, integrity, joins, layout, ledger, packaging, profile, reflow, render, restore
from lectern.plans import registry
from lectern.sources import readers, sinks
from lectern.streaming import queue

SF = "/root/testdata/sf0.001"


def one(spark, column, *rows, schema):
    return [r.x for r in spark.createDataFrame(list(rows), schema).select(column.alias("x")).collect()]


# ---------------------------------------------------------------- images
def plain_diffusion(px, w, h, bottom_up):
    """Pixel by pixel with a dictionary of errors."""
    bounds, levels = fixed.TUNINGS["even"]
    error, out = {}, [0] * (w * h)
    for step in range(h):
        y = h - 1 - step if bottom_up else step
        for x in range(w):
            v = min(255, max(0, px[y * w + x] + error.get((step, x), 0)))
            level = sum(v >= b for b in bounds)
            out[y * w + x] = level
            share = (v - levels[level]) >> 3
            for right, down in ((1, 0), (2, 0), (-1, 1), (0, 1), (1, 1), (0, 2)):
                error[step + down, x + right] = error.get((step + down, x + right), 0) + share
    return out


def plain_floyd(px, w, h):
    buf, out = [float(v) for v in px], [0] * (w * h)
    for y in range(h):
        ahead = 1 if y % 2 == 0 else -1
        for x in range(w) if ahead == 1 else range(w - 1, -1, -1):
            v = buf[y * w + x]
            level = 0 if v <= 42.5 else 1 if v <= 127.5 else 2 if v <= 212.5 else 3
            out[y * w + x] = level
            for dx, dy, k in ((ahead, 0, 7), (-ahead, 1, 3), (0, 1, 5), (ahead, 1, 1)):
                if 0 <= x + dx < w and y + dy < h:
                    buf[(y + dy) * w + x + dx] += (v - 85 * level) * k / 16
    return out


def test_diffusion_pixel_by_pixel(spark):
    rng = np.random.default_rng(2)
    sizes = [(8, 6), (8, 6), (5, 7), (1, 9), (12, 1)]
    rows = [(n, w, h, rng.integers(0, 256, w * h).tolist()) for n, (w, h) in enumerate(sizes)]
    images = spark.createDataFrame(rows, "image int, w int, h int, pixels array<int>")
    for bottom_up in (True, False):
        got = {r.image: r.levels for r in imaging.diffuse(images, bottom_up=bottom_up).collect()}
        assert got == {n: plain_diffusion(p, w, h, bottom_up) for n, w, h, p in rows}
    got = {r.image: r.levels for r in imaging.dither(images, "floyd").collect()}
    assert got == {n: plain_floyd(p, w, h) for n, w, h, p in rows}
    none = {r.image: r.levels for r in imaging.dither(images, "none").collect()}
    assert none[0] == [0 if v <= 42.5 else 1 if v <= 127.5 else 2 if v <= 212.5 else 3 for v in rows[0][3]]
    flat = spark.createDataFrame([(1, 4, 4, [85] * 16, [0.9] * 16)], "image int, w int, h int, pixels array<int>, noise array<double>")
    assert imaging.dither(flat, "atkinson", "noise").first().levels == [1] * 16  # no nudge on a level


def test_diffusion_queries_match_plain_versions(spark):
    px = {r.vec_id: r.p for r in __import__("lectern.plans.queries", fromlist=["x"])._pixels(spark, SF).collect()}
    two = {r.image: r.levels for r in registry.QUERIES["error_diffusion_2d"](spark, SF).collect()}
    row = {r.vec_id: r.levels for r in registry.QUERIES["error_diffusion_1d"](spark, SF).collect()}
    back = {r.image: r.levels for r in registry.QUERIES["serpentine_diffusion"](spark, SF).collect()}
    assert set(two) == set(row) == set(back) == set(px)
    for k in list(px)[:40]:
        assert two[k] == plain_diffusion(px[k], 8, len(px[k]) // 8, True) and row[k] == plain_diffusion(px[k], len(px[k]), 1, True) and back[k] == plain_floyd(px[k], 8, len(px[k]) // 8)


def test_bounded_walks_never_jump(spark):
    for r in registry.QUERIES["bounded_walks"](spark, SF).collect():
        goals = [round((r.p_partkey % 5) * (6 * np.sin(2 * np.pi * d / 17) + 3 * np.sin(2 * np.pi * d / 9))) for d in range(41)]
        at, want = 0, []
        for g in goals:
            at += (g > at) - (g < at)
            want.append(at)
        assert r.walk == want


@pytest.mark.parametrize("bpp", [4, 24])
def test_bitmaps_come_back(spark, bpp):
    rng = np.random.default_rng(bpp)
    levels = rng.integers(0, 4, 7 * 5)
    raw = imaging.encode_bmp4(levels, 7, 5) if bpp == 4 else imaging.encode_bmp24(levels * 85, 7, 5)
    files = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(raw[:-9])), (3, bytearray(b"BM"))], "f int, c binary")
    got = {r.f: r for r in imaging.bmp_levels(files, "f", "c").collect()}
    assert set(got) == ({1, 2} if bpp == 4 else set())  # true colour has no palette to map straight
    if bpp == 4:
        assert got[1].levels == levels.tolist() and got[2].levels is None
    head = imaging.bmp_header(files, "f", "c").where("f = 1").first()
    assert (head.width, head.height, head.bpp, head.error) == (7, 5, bpp, None)


def test_previews_are_whole_files(spark):
    import struct
    import zlib

    rows = spark.createDataFrame([(1, 3, 2, [0, 1, 2, 3, 3, 0])], "image int, w int, h int, levels array<int>")
    raw = bytes(imaging.previews(rows).first().content)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        parts[kind] = raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + parts[kind])
        at += 12 + n
    assert struct.unpack(">IIBB", parts[b"IHDR"][:10]) == (3, 2, 8, 0) and zlib.decompress(parts[b"IDAT"]) == bytes([0, 0, 85, 170, 0, 255, 255, 0])


def test_one_and_two_bit_rows():
    raw = bytes(54) + bytes([0b10110000, 0, 0, 0])
    assert imaging.decode_bmp(raw, 4, 1, True, 1, 4, 54, [0, 255]).tolist() == [[3, 0, 3, 3]]
    assert imaging.decode_bmp(raw, 4, 1, True, 2, 4, 54, [0, 85, 170, 255]).tolist() == [[2, 3, 0, 0]]


# ---------------------------------------------------------------- fidelity
def plain_edits(a, b):
    """Edits of a longest-match script: (size of the longest changed run, changed, runs), by recursion over plain substrings."""
    def blocks(alo, ahi, blo, bhi):
        best = (0, alo, blo)
        for i in range(alo, ahi):
            for j in range(blo, bhi):
                k = 0
                while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if not k:
            return []
        return [*blocks(alo, i, blo, j), (i, j, k), *blocks(i + k, ahi, j + k, bhi)]

    runs, i, j = [], 0, 0
    for x, y, k in [*blocks(0, len(a), 0, len(b)), (len(a), len(b), 0)]:
        if x > i or y > j:
            runs.append(max(x - i, y - j))
        i, j = x + k, y + k
    return len(runs), sum(runs), max(runs, default=0), len(b) - len(a)


def test_edit_measures_by_plain_recursion(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        a = "".join(rng.choice(list("abcde "), 30))
        cut = int(rng.integers(0, 25))
        rows.append((a, a[:cut] + "xy" + a[cut + int(rng.integers(0, 5)) :]))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fidelity.edit_measures("a", "b").alias("m")).collect()
    for r in got:
        assert tuple(r.m) == plain_edits(r.a, r.b)


def test_losses_break_the_growth_bound(spark):
    rows = spark.createDataFrame([("a" * 200, "a" * 180), ("a" * 2000, "a" * 1990 + "b")], "a string, b string").select("a", fidelity.edit_measures("a", "b").alias("m"))
    got = [r.x for r in rows.select(fidelity.edit_bounds(F.length("a"), F.col("m")).alias("x")).collect()]
    assert got[0] == ["changed", "growth"] and got[1] == []


def test_grams_of_a_long_text_take_linear_time(spark):
    def seconds(n):
        rows = spark.createDataFrame([(" ".join(f"w{i % 977}" for i in range(n)),)], "t string")
        began = time.perf_counter()
        assert rows.select(F.size(fidelity.word_ngrams(F.col("t"))).alias("x")).first().x == min(n - 4, 977)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 10


# ---------------------------------------------------------------- restoring and drafts
def book_lines(spark, rows):
    return spark.createDataFrame([(1, p, n, t, x, 12.0 * n, 12.0 * n + 10) for n, (p, t, x) in enumerate(rows)], "doc int, page int, pos int, text string, x0 double, top double, bottom double")


def test_restore_joins_words_and_paragraphs(spark):
    rows = [(1, "Title", 0.0), (2, "A long exam-", 0.0), (2, "ple of well-", 0.0), (2, "known text.", 0.0), (2, "12", 0.0), (2, "Indented", 30.0), (2, "end", 0.0), (3, "verse one", 0.0), (3, "verse two", 0.0), (4, "gone", 0.0)]
    policy = restore.Policy((restore.PageRange.parse("1", "front_matter"), restore.PageRange.parse("2", "body", "prose"), restore.PageRange.parse("3", "body", "verse"), restore.PageRange(4, None, "skip")), (r"^\d+$",), "sentence", True, ("well-known", "wellknown"))
    units, report = restore.restore(book_lines(spark, rows), "doc", policy)
    got = [(r.kind, r.text) for r in units.orderBy("unit").collect()]
    assert got == [("para", "Title"), ("para", "A long example of well-known text."), ("para", "Indented end"), ("verse", "verse one\nverse two")]
    r = report.first()
    assert (r.lines_in, r.lines_out, r.hyphens_resolved, r.furniture_dropped) == (10, 8, 1, {r"^\d+$": 1})
    text = restore.markdown(units, "doc").first().text
    assert "```verse\nverse one\nverse two\n```" in text and text.endswith("\n")


def test_policies_are_checked(spark):
    with pytest.raises(ValueError):
        restore.Policy((restore.PageRange.parse("1", "burn"),))
    with pytest.raises(ValueError):
        restore.Policy((restore.PageRange.parse("1", "body", "haiku"),))
    lines = book_lines(spark, [(1, "a", 0.0), (2, "b", 0.0), (3, "c", 0.0)])
    policy = restore.Policy((restore.PageRange.parse("1-2", "body"), restore.PageRange.parse("2", "skip"), restore.PageRange.parse("9", "skip")))
    assert {r.error for r in restore.range_errors(lines, "doc", policy).collect()} == {"lines in no range", "lines in several ranges", "range 3 matches no line"}
    with pytest.raises(Exception, match="do not cover"):
        restore.restore(lines, "doc", restore.Policy((restore.PageRange.parse("1-2", "body"),)))[0].collect()


def test_anchored_ranges(spark):
    rows = [(1, "Title", 0.0), (1, "One", 0.0), (1, "verse a", 0.0), (1, "verse b", 0.0), (1, "more.", 0.0), (2, "One", 0.0)]
    document = {"page_ranges": [{"start_anchor": "verse a", "end_anchor": "verse b", "treat": "body", "reflow": "verse"}, {"start_anchor": "Title", "end_anchor": "One", "end_anchor_occurrence": 1, "treat": "front_matter"}, {"start_anchor": "more.", "end_anchor": "One", "treat": "body"}], "normalize": {"more": "MORE"}}
    units, report = restore.restore(book_lines(spark, rows), "doc", restore.policy_of(document))
    assert [(r.kind, r.text) for r in units.orderBy("unit").collect()] == [("para", "Title"), ("para", "One"), ("verse", "verse a\nverse b"), ("para", "MORE."), ("para", "One")]
    r = report.first()
    assert (r.gate_pass, r.char_ratio, r.joins_made, r.normalisations) == (True, 1.0, 0, [1])
    document["page_ranges"][1].pop("end_anchor_occurrence")
    with pytest.raises(Exception, match="anchor ambiguous"):
        restore.restore(book_lines(spark, rows), "doc", restore.policy_of(document))[0].collect()
    for wrong in ({"pages": "1", "start_anchor": "x", "end_anchor": "y", "treat": "skip"}, {"start_anchor": "x", "treat": "skip"}):
        with pytest.raises(ValueError):
            restore.policy_of({"page_ranges": [wrong]})


def test_stages_from_the_command_line(spark, tmp_path):
    from lectern.__main__ import main

    book_lines(spark, [(1, "a b c.", 0.0), (2, "12", 0.0)]).write.parquet(str(tmp_path / "lines"))
    (tmp_path / "policy.json").write_text(json.dumps({"page_ranges": [{"pages": "1-2", "treat": "body"}], "furniture": [r"^\d+$"]}))
    assert main(["restore", str(tmp_path / "lines"), str(tmp_path / "units"), "--policy", str(tmp_path / "policy.json"), "--book", "doc"]) == 0
    assert [r.text for r in spark.read.parquet(str(tmp_path / "units")).collect()] == ["a b c."]
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "x.epub").write_bytes(render.archive("T", "A", "en", [("One", '<a href="#no">x</a>')], {}))
    assert main(["verify", str(tmp_path / "books"), str(tmp_path / "errors")]) == 1
    assert [r.error for r in spark.read.parquet(str(tmp_path / "errors")).collect()] == ["OEBPS/ch01.xhtml dead fragment #no"]


def test_chapter_texts_and_roots(spark, tmp_path):
    (tmp_path / "chapters").mkdir()
    (tmp_path / "chapters" / "a.md").write_text("one\ntwo")
    (tmp_path / "book.json").write_text(json.dumps({"title": "T", "chapters": [{"source": "built/a.md", "source_md": "chapters/a.md"}, {"source": "chapters/more.md"}]}))
    (tmp_path / "chapters" / "more.md").write_text("x")
    got = readers.chapter_texts(spark, str(tmp_path / "book.json")).orderBy("pos").collect()
    assert [(r.chapter, r.text) for r in got] == [("ch01", "one\ntwo"), ("ch02", "x")]
    both = readers.multi_root(spark, [str(tmp_path), str(tmp_path / "chapters")], "*.md").collect()
    assert sorted((r.root, r.rel) for r in both) == [(0, "chapters/a.md"), (0, "chapters/more.md")]


def test_fallback_metadata_two_levels_up(spark, tmp_path):
    for name, text in (("a", '{"title": " T ", "author": "A"}'), ("b", "{broken")):
        (tmp_path / name / "build").mkdir(parents=True)
        (tmp_path / name / "book.json").write_text(text)
    got = readers.book_fallback(spark, str(tmp_path)).collect()
    assert [(r.title, r.author, r.language) for r in got] == [("T", "A", "")]
    path = spark.createDataFrame([(f"{got[0].folder}/build/a.epub",)], "p string").select(readers.grandparent(F.col("p")).alias("x")).first().x
    assert path == got[0].folder


def test_drafts_are_checked(spark):
    assert draft.validate({"title": "T"}) == ["missing required keys: ['author', 'language', 'chapters', 'front_matter']"]
    full = {"title": "T", "author": "A", "language": "en", "chapters": [{"toc_label": "x"}], "front_matter": "keep"}
    assert draft.validate(full) == ["unsupported front_matter value 'keep'", "chapter 1 missing 'start_anchor'"]
    starts = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (1, 3, 9)], "book int, n int, para int")
    assert [(r.n, r.error) for r in draft.order_errors(starts, "book").collect()] == [(2, "anchor out of order")]


# ---------------------------------------------------------------- grading
def test_segmentation_is_the_likeliest_split(spark):
    words = {"北京": 50, "大学": 40, "北京大学": 5, "学生": 30, "大": 20, "学": 10, "生": 10, "北": 5, "京": 5}
    lexicon = spark.createDataFrame(list(words.items()), "word string, freq int")
    total = sum(words.values())

    def splits(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if k == 1 or s[:k] in words for rest in splits(s[k:])]

    texts = ["北京大学生", "大学学生北京", "中北京"]
    rows = spark.createDataFrame([(n, f"{t}，ab1 x") for n, t in enumerate(texts)], "k int, t string")
    got = {}
    for r in grading.segment(rows, "k", "t", lexicon).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.token)
    for n, t in enumerate(texts):
        best = max(splits(t), key=lambda ws: sum(np.log(words.get(w, 1) / total) for w in ws))
        assert got[n] == [*best, "，", "ab1", " ", "x"]


def test_single_han_character_in_a_longer_token(spark):
    lexicon = spark.createDataFrame([("山", "L1", "x")], "word string, level string, source string")
    idioms = spark.createDataFrame([], "word string")
    got = {r.token: r.tier for r in grading.classify(spark.createDataFrame([("A山",), ("山",), ("水",)], "token string"), lexicon, idioms).collect()}
    assert got == {"A山": "known", "山": "known", "水": "flagged"}


def test_gate_reasons_carry_their_figures(spark):
    r = spark.createDataFrame([(0.0, 0.0)], "out_of_list_rate double, stretch_rate double")
    got = grading.gate(r, grading.Gates(min_chars=800, min_expressions=5, min_out_of_list=0.01), F.lit(10), F.lit(2)).first().fail_reasons
    assert got == ["out_of_list_rate<min (too easy — reach a little further)", "too short (10<800 chars)", "too few expressions (2<5)"]
    assert grading.resolve_gates({"threshold": None, "max_stretch": 0.2}, {"threshold": 0.1, "max_stretch": 0.3}) == grading.Gates(0.1, 0.0, 0.2, 0, 0)


# ---------------------------------------------------------------- text
def test_lines_and_blanks(spark):
    got = one(spark, T.lines_of(F.col("t")), ("a\r\nb\x0bc\u2028\t\n\u3000\x1d",), schema="t string")[0]
    assert got == ["a", "b", "c"]
    assert one(spark, T.strip(F.col("t")), ("\u3000 x y\x85",), schema="t string") == ["x y"]
    assert one(spark, T.html_text(F.col("t")), ("<body a>x &eacute;&#8212;<b>y</b></body>",), schema="t string") == ["x é— y "]
    assert one(spark, T.tone_mark(F.col("t")), ("HAO3",), ("lu:4",), schema="t string") == ["HǍO", "lǜ"]


def test_recaps(spark):
    got = [tuple(r) for r in spark.createDataFrame([("a\nrecap: b\n\n",), ("RECAP: b\na",)], "t string").select(T.recap(F.col("t")), T.without_recap(F.col("t"))).collect()]
    assert got == [("b", "a\n"), (None, "RECAP: b\na")]


# ---------------------------------------------------------------- catalogue, feeds, archives
def test_rescan_on_a_miss(spark):
    old = spark.createDataFrame([("a",)], "id string")
    asked = []

    def rescan():
        asked.append(1)
        return spark.createDataFrame([("a",), ("b",)], "id string")

    assert catalog.by_id(old, "a", rescan).count() == 1 and not asked
    assert catalog.by_id(old, "b", rescan).count() == 1 and asked == [1]
    assert catalog.by_id(old, "c").count() == 0


def test_entries_need_a_title(spark):
    rows = spark.createDataFrame([(" ", "s", "/x")], "title string, summary string, href string")
    with pytest.raises(Exception, match="title and a link"):
        catalog.navigation_entries(rows).collect()
    assert catalog.opensearch("http://h", "A & B").count("A &amp; B") == 2


def test_undefined_notes_and_bad_images(spark):
    rows = spark.createDataFrame([(1, "x[^a]", "c1")], "n int, md string, p string")
    with pytest.raises(Exception, match="undefined footnote"):
        render.chapter_bodies(rows, ["n"], "md", "p").collect()
    parts, notes = render.blocks(spark.createDataFrame([(1, "![a](b.png)\n\n![x\n\n```verse\n[^n]: kept\n```\n\n[^n]: note")], "n int, md string"), ["n"], "md")
    assert sorted((r.pos, r.error) for r in render.image_errors(parts, ["n"]).collect()) == [(0, "image path must be under ../images/"), (1, "malformed image")]
    assert [r.note for r in notes.collect()] == ["note"] and ("verse", "[^n]: kept") in [(r.kind, r.text) for r in parts.collect()]


def test_equal_books_have_equal_bytes():
    make = lambda: render.archive("T & U", "A", "en", [("One", "<p>x</p>")], {"images/b.png": b"b", "images/a.jpg": b"a"}, "images/b.png")
    assert make() == make() and b"T &amp; U" not in make()[:60]


def test_spine_texts_in_order(spark):
    rows = spark.createDataFrame([(1, 2, "<body>b</body>"), (1, 1, "<body>a&amp;</body>")], "book int, pos int, h string")
    assert integrity.spine_text(rows, "book", "h").first().text == "a&\nb"


# ---------------------------------------------------------------- joins, state, sources
def test_a_chain_of_eighty_nodes_is_reached(spark):
    edges = spark.range(80).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = joins.reachable(edges, spark.createDataFrame([(0,)], "node long")).agg(F.max("hops"), F.count("*")).first()
    assert tuple(got) == (80, 81)


def test_numbered_lines_across_splits(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\n".join(f"w{i}\tx" for i in range(3000)))
    (tmp_path / "b.tsv").write_text("# c\nq\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).where("file like '%a.tsv'").collect()
        assert sorted((r.line, r.row) for r in rows) == [(i, f"w{i}\tx") for i in range(3000)]
        assert [r.cells for r in readers.tsv_lines(spark, str(tmp_path / "b.tsv")).collect()] == [["q"]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_of_two_documents_stay_apart(spark, tmp_path):
    for name, w in (("a", 1.0), ("b", 2.0)):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"page": 1, "width": w, "images": [{"x0": w}]}))
    assert sorted(r.width for r in readers.pages(spark, str(tmp_path)).collect()) == [1.0, 2.0]
    assert readers.page_images(readers.pages(spark, str(tmp_path / "a.jsonl")), 1).first().images[0].x0 == 1.0
    with pytest.raises(Exception, match="not found"):
        readers.page_images(readers.pages(spark, str(tmp_path / "a.jsonl")), 7).collect()


def test_configurations():
    assert readers.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3, "_n": 0}, "_c": 1, "d": {}}) == {"a": {"x": 1, "y": 3}, "b": 1, "d": {}}
    assert readers.overlay({"auth": {"u": 1, "p": 2}, "k": [1]}, {"auth": {"p": 3}, "k": [2], "_x": 0}) == {"auth": {"u": 1, "p": 3}, "k": [2]}


def test_a_failed_move_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    sinks.staged_overwrite(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_items_are_removed_by_id(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(1, "add", "a", "i1"), (2, "add", "a", "i2"), (3, "remove", "i1", None)]
    (src / "1.json").write_text("\n".join(json.dumps({"update_id": n, "from_id": 7, "kind": k, "payload": p, "item": i}) for n, k, p, i in rows))
    q = queue.queue_sizes(queue.updates(spark, str(src))).writeStream.outputMode("update").format("memory").queryName("by_id").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["items"], r.n) for r in spark.sql("SELECT * FROM by_id").collect()] == [(["a"], 1)]


def test_a_question_is_answered_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(1, "ask", "name?"), (2, "text", "Ann"), (3, "text", "again")]
    (src / "1.json").write_text("\n".join(json.dumps({"update_id": n, "from_id": 7, "kind": k, "payload": p}) for n, k, p in rows))
    q = queue.pending_slot(queue.updates(spark, str(src))).writeStream.outputMode("append").format("memory").queryName("slot").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.update_id, r.question, r.payload) for r in spark.sql("SELECT * FROM slot").collect()) == [(2, "name?", "Ann"), (3, None, "again")]


def test_small_state_rules(spark):
    a = spark.createDataFrame([([1, 2], [2, 3])], "a array<int>, b array<int>")
    both, less = ledger.select_more(F.col("a"), F.col("b"))
    assert tuple(a.select(both, less).first()) == ([1, 2, 3], [1])
    views = spark.createDataFrame([(1, 10.0), (2, None), (3, 14.0)], "v int, at double")
    assert sorted(r.v for r in ledger.expired(views, "at", F.lit(15.0), 2.0).collect()) == [1, 2]
    assert tuple(spark.createDataFrame([([(1, 5), (2, 9), (3, 9)],)], "v array<struct<id:int,size:int>>").select(layout.largest(F.col("v"), "size").alias("x")).first().x) == (3, 9)


def test_verdicts_and_medians(spark):
    pages = spark.createDataFrame([(1, 50, 0.5), (1, 50, 0.1), (1, 400, 0.9)], "book int, chars int, image_coverage double")
    full = pages.selectExpr("*", "0 AS lines", "0 AS doubled_lines", "0 AS words", "0 AS stray_singles", "'' AS first_line", "'' AS last_line")
    r = profile.route(full, "book").first()
    assert (r.route, r.image_pages, r.median_chars, r.flags) == ("HYBRID", 1, 50, "")
    box = spark.createDataFrame([([(0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 30.0, 10.0)], 20, 40)], "i array<struct<x0:double,top:double,x1:double,bottom:double>>, w int, h int")
    assert box.select(profile.image_coverage(F.col("i"), F.col("w"), F.col("h")).alias("x")).first().x == 0.5


def test_flatten_keeps_page_order(spark):
    pages = spark.createDataFrame([(1, 2, [("c",)]), (1, 1, [("a",), ("b",)])], "doc int, page int, lines array<struct<text:string>>")
    assert [(r.n, r.text) for r in restore.flatten(pages, "doc").orderBy("n").collect()] == [(0, "a"), (1, "b"), (2, "c")] and reflow.flatten(pages, "doc").count() == 3


def test_feeds_prefer_archives(spark):
    xml = '<feed><entry><title>T</title><link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="/get/1"/><link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="/a.epub"/></entry><entry><title>N</title><link type="application/atom+xml" href="/1"/><link type="application/atom+xml" href="/2"/></entry></feed>'
    got = packaging.parse_feed(spark.createDataFrame([(1, xml)], "k int, x string"), "k", "x").orderBy("pos").collect()
    assert [(r.kind, r.href) for r in got] == [("book", "/a.epub"), ("navigation", "/2")]
