"""Patterns against Python's own matching, titles against all sizes, feeds from a server of local files."""

import http.server
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed, patterns
from lectern.operators import fidelity, grading, packaging, titles
from lectern.sources import feeds

# ------------------------------------------------------------------ patterns
PATTERNS = [
    "a", "a|bc", "", "a*b+?c{2,3}", r"\d+", r"\D", r"\w+\b", r"\W", r"\s", r"\S\s\S", r"^a", r"a$", r"(?m)^a", r"(?m)a$", r"\Aa", r"a\Z", ".", "(?s)a.b", "a.b", r"[^a-c\d]", r"[\w.-]+@", r"[^\W\d]", r"[\S]", r"[^\s]x",
    r"(?i)É", r"(?i)[a-c]x", r"(?i:a)B", r"(a)(b)?\1", r"(?P<x>a|b)(?P=x)", r"(?i)(a)\1", r"a(?=b)", r"a(?!b)", r"(?<=a)b", r"(?<!a)b", r"(?>a+)b", r"a++b", r"a{2}", r"\bthe\b", r"\Bx", r"(?a)\w", r"(?a)\d\b", r"(?x) a  b # note",
    "太.+了", "第[一二三]个", r"\.\*\\", r"[\]\[^-]", r"\x41é\N{BULLET}", r"(?-i:a)(?i:b)", r"a\nb", r"[\t\n]", "(|a)b", r"(?s:.)$", r" ", "é",
]
TEXTS = [
    "", "a", "b", "abc", "aabbcc", "a\nb", "a b", "ab\n", "x a", "\na\n", "A", "É", "é", "É", "ax", "AX", "aB", "AB", "aa", "aba", "abab", "٣ 3", "x٣", "²", "Ⅷ", "_", "a-b.c@d", "the end", "thé end", "bathe", "tea", "太好了", "太了", "第二个", ".*\\", "][^-",
    "Aé•", "a b", "a\u0085b", "　", "\x1c", "​", "ß", "ſ", "K", "İ", "🙂", "a🙂b", "x x", "a@", "ÀÉ", "a\r\nb", "a\r", "ab ab", "\t", "1 a", "aaab", "aab",
]


def test_patterns_match_as_in_python(spark):
    pairs = [(p, patterns.for_spark(p), t) for p in PATTERNS for t in TEXTS]
    rows = spark.createDataFrame(pairs, "python string, pattern string, text string")
    got = {(r.python, r.text): r.hit for r in rows.select("python", "text", F.regexp("text", "pattern").alias("hit")).collect()}
    wrong = [(p, t) for p, _, t in pairs if got[p, t] != bool(re.search(p, t))]
    assert wrong == []


def test_random_patterns(spark):
    r = random.Random(11)
    pieces = ["a", "b", "é", r"\w", r"\d", r"\s", ".", "[ab]", "[^a]", r"[^\d]", r"\b", "^", "$", "(a|b)", "(?:ab)", "(?i:A)"]
    pairs = []
    for _ in range(400):
        p = "".join(r.choice(pieces) + (r.choice(["", "", "*", "+", "?", "{1,2}"])) for _ in range(r.randint(1, 4)))
        try:
            re.compile(p)
        except re.error:
            with pytest.raises(patterns.PatternError):
                patterns.for_spark(p)
            continue
        pairs += [(p, patterns.for_spark(p), "".join(r.choice("abAé1 \nx") for _ in range(r.randint(0, 6)))) for _ in range(6)]
    rows = spark.createDataFrame(pairs, "python string, pattern string, text string")
    got = rows.select("python", "text", F.regexp("text", "pattern").alias("hit")).collect()
    assert len(got) > 1000
    assert [(x.python, x.text) for x in got if x.hit != bool(re.search(x.python, x.text))] == []


@pytest.mark.parametrize("wrong", ["(", "[a", "a{3,2}", "*a", r"\q", "(?P<x>a)(?P<x>b)", "(a)?(?(1)b|c)", r"\2", "(?<=a+)b"])
def test_what_has_no_counterpart_is_refused(wrong):
    with pytest.raises(patterns.PatternError):
        patterns.for_spark(wrong)


def test_expressions_are_checked_before_the_job(spark):
    texts = spark.createDataFrame([(1, "太好了 3x"), (2, "太.+了")], "n int, t string")
    got = {r.n: r.expressions for r in grading.expression_hits(texts, "n", "t", [("too", "太.+了"), ("太.+了", None), ("word end", r"\d\w$")]).collect()}
    assert got == {1: ["too", "word end"], 2: ["too", "太.+了"]}
    with pytest.raises(patterns.PatternError, match="not a pattern"):
        grading.expression_hits(texts, "n", "t", [("bad", "(")])


# ------------------------------------------------------------------ titles
def plain_fit(text, width, box_w, box_h, ascent, descent):
    """Every size from the largest down, wrapping a text character by character."""
    wide = lambda c: any(a <= ord(c) <= b for a, b in fixed.WIDE)
    words, gap, inside = [], False, False
    for c in text:
        if c.isspace():
            gap, inside = True, False
        elif wide(c) or not inside:
            words.append((c, gap))
            gap, inside = False, not wide(c)
        else:
            words[-1] = (words[-1][0] + c, words[-1][1])
    size_of = lambda s, size: sum(width(c) for c in s) * size
    for size in range(160, 10, -2):
        size = max(size, 12)
        lines = []
        for w, g in words:
            longer = lines[-1] + (" " if g else "") + w if lines else w
            if lines and size_of(longer, size) <= box_w + 1e-9:
                lines[-1] = longer
            else:
                lines.append(w)
        height = int((round(ascent * size) + round(descent * size)) * 1.15)
        if all(size_of(x, size) <= box_w + 1e-9 for x in lines) and height * len(lines) <= box_h:
            return size, lines, height
    return 12, lines, height


def test_titles_fit_as_all_sizes_tried(spark):
    r = random.Random(2)
    names = [x.p_name for x in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").limit(80).collect()]
    han = "红楼梦三国演义西游记水浒传，。第一回　甄士隐梦幻识通灵"
    texts = names + ["".join(r.choice(han) for _ in range(r.randint(1, 40))) for _ in range(40)] + [f"{n} {han[:k]} x{han[k:]}" for k, n in enumerate(names[:15])]
    texts += ["", "   ", "one", "x" * 200, " a  b ", "a b\nc", "A—b‘c"]
    width = lambda c: 1.0 if ord(c) > 0x2FFF else 0.25 if c == " " else (ord(c) % 8 + 2) / 16
    signs = sorted(set("".join(texts)) - set("—x"))
    glyphs = spark.createDataFrame([(c, width(c)) for c in signs] + [("—", 0.75), ("x", 0.625)], "ch string, width double")
    known = {**{c: width(c) for c in signs}, "—": 0.75, "x": 0.625}
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "n int, title string")
    for box in ((300, 200), (120, 90), (40, 30)):
        got = {x.n: (x.size, x.lines, x.line_height) for x in titles.fit_titles(rows, "n", "title", glyphs, *box, 0.9, 0.25).collect()}
        assert got.pop(-1)[:2] == (160 if box[1] > 0 else 12, [])
        for n, text in enumerate(texts):
            assert got[n] == plain_fit(text, known.get, *box, 0.9, 0.25), (text, box)


def test_unknown_signs_have_a_width(spark):
    glyphs = spark.createDataFrame([("a", 0.5)], "ch string, width double")
    rows = spark.createDataFrame([(1, "a b")], "n int, t string")
    r = titles.fit_titles(rows, "n", "t", glyphs, 250, 1000, 0.8, 0.2, unknown=1.0).first()
    assert (r.size, r.lines) == (160, ["a", "b"])


# ------------------------------------------------------------------ feeds
class Pages(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):  # noqa: N802
        Pages.asked.append((self.path, self.headers.get("Authorization")))
        name, _, n = self.path.strip("/").partition("?")[0].partition("/")
        if name == "hop":
            self.send_response(302)
            self.send_header("Location", f"/hop/{int(n) - 1}" if int(n) > 1 else "/feed/1")
            self.end_headers()
        elif name in ("feed", "loop", "short"):
            last = {"feed": 3, "loop": 99, "short": Pages.short}[name]
            link = f'<link href="{int(n) + 1}" rel="next"/>' if int(n) < last else ""
            link = f'<link rel="next" href="/loop/{int(n) % 2 + 1}?a=1&amp;b=2"/>' if name == "loop" else link
            body = f'<feed>{link}<entry><title>Bööök {n}</title><link rel="next" href="/wrong"/><link type="application/atom+xml" href="/x"/></entry></feed>'.encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)
        elif name == "big":
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"x" * 5000)
        elif name == "latin":
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"\xe9\xff")
        else:
            self.send_error(404)

    short = 2


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Pages.asked, Pages.short = [], 2
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_fetch(server):
    assert feeds.fetch(f"{server}/hop/5", 10**6)[:1] == (200,)
    assert feeds.fetch(f"{server}/hop/5", 10**6)[2] == f"{server}/feed/1"
    status, body, _, error = feeds.fetch(f"{server}/hop/6", 10**6)
    assert (status, body) == (0, b"")
    assert error.startswith("over 5 redirects")
    assert feeds.fetch(f"{server}/big", 5000)[3] is None
    assert feeds.fetch(f"{server}/big", 4999)[3].startswith("over 4999 bytes")
    assert feeds.fetch(f"{server}/none", 100)[3] == f"HTTP 404 from {server}/none"
    assert feeds.fetch("file:///etc/passwd", 100)[3] == "not a web address: file:///etc/passwd"
    assert "Error" in feeds.fetch("http://127.0.0.1:9/x", 100, 2)[3]
    Pages.asked.clear()
    feeds.fetch(f"{server}/big", 9999, user="me", password="pw")
    feeds.fetch(f"{server}/big", 9999, user="me")
    assert [a for _, a in Pages.asked] == ["Basic bWU6cHc=", None]


def test_feed_source_is_a_partition_a_feed(spark, server):
    import json

    spark.dataSource.register(feeds.FeedSource)
    urls = [f"{server}/feed/1", f"{server}/loop/1", f"{server}/latin", f"{server}/gone", f"{server}/hop/6"]
    rows = spark.read.format("feed_pages").option("feeds", json.dumps(urls)).option("timeout", "5").load()
    assert rows.rdd.getNumPartitions() == len(urls)
    got = {}
    for r in rows.collect():
        got.setdefault(r.feed, []).append(r)
    assert [r.url for r in sorted(got[urls[0]], key=lambda r: r.number)] == [f"{server}/feed/{n}" for n in (1, 2, 3)]
    assert [r.next for r in sorted(got[urls[0]], key=lambda r: r.number)][-1] is None
    assert len(got[urls[1]]) < 5  # a feed that leads back to itself ends
    assert [(r.body, r.error) for r in got[urls[2]]] == [(None, f"not UTF-8 ({urls[2]})")]
    assert [(r.status, r.error) for r in got[urls[3]]] == [(404, f"HTTP 404 from {urls[3]}")]
    assert got[urls[4]][0].error.startswith("over 5 redirects")
    entries = packaging.parse_feed(rows.where("error is null").select("url", "body"), "url", "body")
    assert "Bööök 2" in {r.title for r in entries.collect()}
    assert spark.read.format("feed_pages").load().collect() == []


def test_a_crawl_goes_on_where_it_was(spark, server, tmp_path):
    table = spark.createDataFrame([(f"{server}/short/1",), (f"{server}/feed/1",), (f"{server}/gone",)], "feed string")
    visited = str(tmp_path / "visited")
    first = feeds.crawl(spark, table, visited, most_pages=2)
    assert sorted((r.feed.rsplit("/", 2)[1], r.number) for r in first.where("error is null").collect()) == [("feed", 1), ("feed", 2), ("short", 1), ("short", 2)]
    Pages.asked.clear()
    second = feeds.crawl(spark, table, visited, most_pages=2)
    assert sorted(p for p, _ in Pages.asked) == ["/feed/3", "/gone"]  # what was read isn't asked for again
    good = second.where("error is null").collect()
    assert sorted((r.feed.rsplit("/", 2)[1], r.number) for r in good) == [("feed", 1), ("feed", 2), ("feed", 3), ("short", 1), ("short", 2)]
    assert second.where("error is not null").count() == 1


# ------------------------------------------------------------------ small ones
def test_edit_reasons_and_titles_of_entries(spark):
    rows = spark.createDataFrame([(100, 5, 3, 5), (1000, 1, 25, 0), (1000, 20, 24, 10)], "size int, changed int, longest int, growth int")
    got = rows.select(fidelity.edit_reasons(F.col("size"), F.struct("changed", "longest", "growth")).alias("r")).collect()
    assert [r.r for r in got] == [
        ["changed_ratio 0.05 > 0.02 (too much of the text edited)", "net_growth 0.05 > 0.01 (text added/removed wholesale, not corrected)"],
        ["max_edit_span 25 > 24 (an edit is a rewrite, not a local fix — use policy)"], [],
    ]
    entries = spark.createDataFrame([("f", 2, "T", "/b"), ("f", 1, "T", "/a"), ("f", 0, "t", "/c"), ("g", 0, "T", "/d")], "feed string, pos int, title string, href string")
    wanted = spark.createDataFrame([("f", "T"), ("g", "none")], "feed string, title string")
    assert [(r.feed, r.title, r.href) for r in packaging.entry_by_title(entries, "feed", wanted).collect()] == [("f", "T", "/a")]
