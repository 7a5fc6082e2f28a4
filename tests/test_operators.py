import difflib

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import catalog, fidelity, grading, imaging, integrity, joins, ledger, packaging, profile, reflow


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_self_doubled(spark):
    assert one(spark, T.is_self_doubled(F.col("s")), s="Chapter One Two Chapter One Two")
    assert one(spark, T.dedoubled(F.col("s")), s="Chapter One Two Chapter One Two") == "Chapter One Two"
    assert one(spark, T.dedoubled(F.col("s")), s="short short") == "short short"


def test_number_grammar(spark):
    for s, ok in (("第十一名", True), ("十二个", True), ("三", True), ("个", False), ("十二个个", True), ("个十", False), ("第", False)):
        assert one(spark, T.is_number(F.col("s")), s=s) == ok


def test_rfc3339_is_utc_whatever_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, T.rfc3339(F.col("x0")), x0=1.9) == "1970-01-01T00:00:01Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def lines(spark, rows):
    return spark.createDataFrame(rows, "doc int, page int, pos int, text string, x0 double, top double, bottom double")


def test_prose_reflow_ignores_page_gaps(spark):
    rows = [(1, 1, 0, "a", 10.0, 0.0, 10.0), (1, 1, 1, "b", 10.0, 12.0, 22.0), (1, 1, 2, "c", 10.0, 40.0, 50.0), (1, 2, 0, "d", 10.0, 0.0, 10.0), (1, 2, 1, "e", 30.0, 12.0, 22.0)]
    assert [r.text for r in reflow.reflow_prose(lines(spark, rows), "doc").orderBy("para").collect()] == ["a b", "c d", "e"]


def test_dehyphenation(spark):
    rows = [(1, 1, 0, "the exam-", 0.0, 0.0, 0.0), (1, 1, 1, "ple is well-", 0.0, 0.0, 0.0), (1, 1, 2, "known here -", 0.0, 0.0, 0.0), (1, 1, 3, "and co-", 0.0, 0.0, 0.0), (1, 2, 0, "operate", 0.0, 0.0, 0.0)]
    got = reflow.dehyphenate(lines(spark, rows), "doc", ("well-known", "wellknown")).orderBy("page", "pos").collect()
    assert [(r.text, r.merged) for r in got] == [("the example is well-known here -", 1), ("and co-", 0), ("operate", 0)]


def test_sentence_reflow(spark):
    rows = [(1, 1, 0, "One", 0.0, 0.0, 0.0), (1, 1, 1, "two. ", 0.0, 0.0, 0.0), (1, 2, 0, "three", 0.0, 0.0, 0.0)]
    assert [r.text for r in reflow.reflow_sentence(lines(spark, rows), "doc").orderBy("para").collect()] == ["One two. ", "three"]


def test_exact_cover(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 1, 5), (2, 4, 8), (3, 0, 3)], "g int, start int, end int")
    got = {(r.g, r.start, r.error) for r in joins.cover_errors(spans, "g", F.lit(9)).collect()}
    assert got == {(2, 1, "gap at start"), (2, 4, "overlap"), (3, 0, "wrong end")}


def test_as_of_takes_the_latest_mark(spark):
    points = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    marks = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, at int, v string")
    assert {(r.k, r.at, r.v) for r in joins.as_of(points, marks, ["k"], "at", "v", "-").collect()} == {("a", 5, "y"), ("a", 1, "-"), ("b", 9, "-")}


def test_as_of_plan_has_no_inequality_join(spark):
    points = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("at"))
    marks = points.withColumn("v", F.lit(1))
    plan = joins.as_of(points, marks, ["k"], "at", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_fidelity(spark):
    assert one(spark, fidelity.containment(F.col("a"), F.col("b")), a="one two", b="x") == 1.0
    assert one(spark, fidelity.containment(F.col("a"), F.col("b")), a="a b c d e f", b="a b c d e") == 0.5
    assert one(spark, fidelity.char_ratio(F.col("a"), F.col("b")), a="", b="x") == 1.0


def test_edit_measures_follow_the_longest_match(spark):
    a, b = "the quick brown fox", "the quik brown fax!"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fidelity.edit_measures("a", "b").alias("m")).first().m
    ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
    assert row.edits == len(ops) and row.growth == len(b) - len(a)


def test_search_of_nothing_finds_nothing(spark):
    books = spark.createDataFrame([("A & B", "x", "r")], "title string, author string, rel string")
    assert catalog.search(books, "  ").count() == 0 and catalog.search(books, "a &").count() == 1


def test_id_collisions_hash_the_absolute_path(spark):
    books = spark.createDataFrame([("r", "/1/r"), ("r", "/2/r"), ("s", "/1/s")], "rel string, path string")
    ids = {r.path: r.id for r in catalog.with_ids(books).collect()}
    assert len(set(ids.values())) == 3


def test_diffusion_matches_its_definition(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, 48).astype(int)
    row = spark.createDataFrame([(1, 8, 6, px.tolist())], "image int, w int, h int, pixels array<int>")
    levels = imaging.diffuse(row).first().levels
    assert set(levels) <= {0, 1, 2, 3} and abs(np.mean(np.array(levels) * 85) - px.mean()) < 25
    solid = spark.createDataFrame([(v, 8, 8, [v] * 64) for v in (0, 85, 170, 255)], "image int, w int, h int, pixels array<int>")
    assert all(set(r.levels) == {r.image // 85} for r in imaging.diffuse(solid).collect())
    line = spark.createDataFrame([([85] * 9,)], "p array<int>").select(imaging.diffuse_row(F.col("p")).alias("l")).first().l
    assert line == [1] * 9


def test_self_match_of_a_pattern_is_one(spark):
    rows = spark.createDataFrame([(1, [0, 3] * 16), (2, [0, 3, 1, 2, 2, 0, 1, 3] * 4)], "image int, p array<int>")
    got = {r.image: r.self_match for r in imaging.self_match(rows, "image", "p").collect()}
    assert abs(got[1] - 1) < 1e-9 and got[2] < 0.6


def test_archives_are_reproducible_and_readable(spark):
    rows = spark.createDataFrame([(1, "Tale", "Ann", "en", 0, "One", "<p>a</p>"), (1, "Tale", "Ann", "en", 1, "Two", "<p>b</p>")], "book int, title string, author string, language string, pos int, heading string, body string")
    a, b = (packaging.build_archives(rows).first().content for _ in range(2))
    assert a == b and bytes(a[30:38]) == b"mimetype"
    got = packaging.epub_metadata(spark.createDataFrame([(1, a)], "f int, c binary"), "f", "c").first()
    assert (got.title, got.author, got.language) == ("Tale", "Ann", "en")


def test_reachability_stops_at_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    got = {(r.node, r.hops) for r in joins.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}


def test_drain_removes_what_landed_by_name(spark):
    queue = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, name string")
    results = spark.createDataFrame([("a", True), ("b", False)], "name string, ok boolean")
    assert {r.id for r in ledger.drain(queue, results).collect()} == {3, 4}
    assert ledger.drain(queue, results.limit(0)).count() == 4


def test_dangling(spark):
    pages = spark.createDataFrame([(1, '<a href="#x">1</a><p id="x"></p><a HREF="#y">2</a><a href="/z#q">3</a>')], "p int, h string")
    assert [r.href for r in integrity.dangling_fragments(pages, "p", "h").collect()] == ["#y"]


def test_gates_are_strict_and_ordered(spark):
    r = spark.createDataFrame([("a", 0.05, 0.16), ("b", 0.0501, 0.1)], "c string, out_of_list_rate double, stretch_rate double")
    got = {x.c: x.fail_reasons for x in grading.gate(r, grading.Gates()).collect()}
    assert got == {"a": ["stretch_rate>max_stretch"], "b": ["out_of_list_rate>threshold"]}


def test_language_vote_needs_five(spark):
    docs = spark.createDataFrame([(1, "the and of to"), (2, "the and of to in"), (3, "que que que que que"), (4, None)], "d int, t string")
    assert {r.d: r.lang_guess for r in profile.language_vote(docs, "d", "t").collect()} == {1: "unknown", 2: "en", 3: "es", 4: "unknown"}


def test_vote_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "the")], "d int, t string")
    assert "Exchange" not in profile.language_vote(docs, "d", "t")._jdf.queryExecution().executedPlan().toString()
