import random
import zlib

import numpy as np

from lectern.llm import langid, quality, toxicity
from tests.llm.conftest import prose

INSULTS = ["grubnik", "vlotzer", "smarfeld"]


def toxic_corpus(n=160):
    rows = []
    for i in range(n):
        words = prose(1000 + i, 60).split()
        bad = i % 4 == 0
        if bad:
            words[30] = random.Random(i).choice(INSULTS)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_and_tolerates_gaps():
    rows = toxic_corpus()
    model = toxicity.fit([r[1] for r in rows[:120]], [r[2] for r in rows[:120]])
    scores = model.scores([r[1] for r in rows[120:]])
    y = np.array([r[2] for r in rows[120:]])
    assert scores[y == 1].min() > scores[y == 0].max()
    plain, gapped, inserted, clean = model.scores(["you grubnik there", "you gr-ubnik there", "you grubxnik there", "you kindly there"])
    assert plain > clean and gapped > clean and inserted > clean


def test_disguised_insults_are_predicted():
    """Insults spaced by signs or blanks, and with a letter put in, reach the threshold of 0.3 in unseen sentences."""
    rows = toxic_corpus(400)
    model = toxicity.fit([r[1] for r in rows[:320]], [r[2] for r in rows[:320]])
    assert (model.scores([r[1] for r in rows[320:] if not r[2]]) < 0.3).all()
    for word in INSULTS:
        forms = [word, ".".join(word), "-".join(word), " ".join(word), " - ".join(word), word[:3] + "*" + word[3:], *[word[:k] + "x" + word[k:] for k in range(1, len(word))]]
        scores = model.scores([f"nelu tibo {f} ravo dilmu" for f in forms])
        assert (scores >= 0.3).all(), (word, scores)


def brute_phi(sym):
    """{letters: sum of decay**span}, five letters counted LONGER times; a code with a gap in it doesn't count."""
    from itertools import combinations

    out = {}
    for order, factor in ((toxicity.ORDER, 1.0), (toxicity.ORDER + 1, toxicity.LONGER)):
        for places in combinations(range(len(sym)), order):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN and all(sym[p] for p in places):
                code = 0
                for p in places:
                    code = code << toxicity.BITS | int(sym[p])
                out[order, code] = out.get((order, code), 0) + factor * toxicity.DECAY**span
    return out


def test_kernel_and_nystrom_map_match_brute_force():
    """The folded weights score a string as its Nystrom image does, both by plain sums over subsequences."""
    rng = np.random.default_rng(6)
    marks = [rng.integers(1, 6, 5).astype(np.uint8) for _ in range(6)]
    phis = [brute_phi(m) for m in marks]
    codes = {n: np.unique([c for p in phis for o, c in p if o == n]).astype(np.int32) for n in (4, 5)}
    slot = np.full(1 << 20, -1, np.int32)
    slot[codes[4]] = np.arange(len(codes[4]))
    width = len(codes[4]) + len(codes[5])
    keys = [(4, c) for c in codes[4].tolist()] + [(5, c) for c in codes[5].tolist()]
    beta = rng.normal(size=6)
    weights = np.array([sum(b * p.get(k, 0) for b, p in zip(beta, phis, strict=True)) for k in keys])
    table = np.zeros(1 << 20, np.float32)
    table[codes[4]] = weights[: len(codes[4])]
    long = toxicity.LongWeights(codes[5], weights[len(codes[4]) :])
    for n in (3, 5, 9, 14):
        sym = rng.integers(0, 6, n).astype(np.uint8)
        phi = brute_phi(sym)
        rows = toxicity._phi_rows(np.concatenate([sym, np.zeros(toxicity.SPAN, np.uint8)]), [n + toxicity.SPAN], slot, codes[5], width)
        assert np.allclose(rows[0], [phi.get(k, 0) for k in keys])
        kernel = [sum(v * phi.get(k, 0) for k, v in p.items()) for p in phis]
        assert np.isclose(toxicity.position_values(sym, table, long).sum(), np.dot(beta, kernel), atol=1e-4)


def test_toxicity_defined_cases(spark, odd_docs, no_docs):
    flat = toxicity.fit([], [])
    assert 0 <= flat.scores(["", None, "x"])[0] <= 1
    assert toxicity.fit(["a b"], [1]).scores(["anything"])[0] > 0.5
    labels = spark.createDataFrame([(5, 1, "z"), (2, 0, "z"), (None, 1, "z"), (9, None, "z"), (99, 1, "z")], "doc_id long, toxic int, text string")
    model = toxicity.train(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert toxicity.score(no_docs, model).count() == 0


def test_kernel_is_the_sum_over_gapped_places():
    sym = np.array([1, 2, 9, 3, 4, 0, 5], np.uint8)
    w = np.zeros(1 << 20, np.float32)
    code = ((1 << 5 | 2) << 5 | 3) << 5 | 4
    w[code] = 1
    assert np.isclose(toxicity.position_values(sym, w)[0], toxicity.DECAY**5)


def brute_phrases(text: list[int], train: list[int]) -> int:
    held, n, i = "".join(map(chr, train)), 0, 0
    s = "".join(map(chr, text))
    while i < len(s):
        j = i
        while j < len(s) and s[i : j + 1] in held:
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def test_cross_parsing_counts_phrases(monkeypatch):
    """Against brute force on texts of one lane and of many: a lane's border changes nothing."""
    monkeypatch.setattr(langid, "LANE", 64)
    rng = random.Random(1)
    samples = {"aa": ["".join(rng.choice("abc ") for _ in range(700))], "bb": ["".join(rng.choice("bcd ") for _ in range(500)), "привет мир " * 9]}
    parser = langid.fit(samples)
    texts = ["".join(rng.choice("abcdx ") for _ in range(n)) for n in (1, 5, 63, 64, 65, 300, 2000)] + [samples["aa"][0], "мир привет", "漢字 a" * 40]
    symbols = [parser.symbols(t) for t in texts]
    for k, name in enumerate(parser.languages):
        train = parser.symbols(" ".join(samples[name])).tolist()
        assert parser.phrases(symbols)[:, k].tolist() == [brute_phrases(t.tolist(), [c for c in train if c]) for t in symbols]
    names, scores = parser.classify([*texts, None, "", "123 !"])
    for t, name, score in zip([*symbols, None, None, None], names, scores, strict=True):
        if t is None or not (t != langid.GAP).any():
            assert (name, score) == ("und", 0)
            continue
        cost = [brute_phrases(t.tolist(), parser.symbols(" ".join(samples[x])).tolist()) * np.log2(len(parser.symbols(" ".join(samples[x])))) for x in parser.languages]
        assert parser.languages[int(np.argmin(cost))] == name and abs(score - (1 - min(cost) / max(cost))) < 1e-9


def test_languages_of_many_scripts(spark):
    """Five scripts, one of thousands of letters, are told apart; signs without a letter are 'und'."""
    rng = random.Random(3)
    ranges = {"el": (0x3B1, 0x3C9), "ru": (0x430, 0x44F), "ar": (0x627, 0x64A), "zh": (0x4E00, 0x9000), "en": (0x61, 0x7A)}
    han = [chr(0x4E00 + rng.randrange(0x4000)) for _ in range(3000)]
    letters = {k: han if k == "zh" else [chr(c) for c in range(a, b + 1) if chr(c).isalpha()] for k, (a, b) in ranges.items()}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(40)), k) for i, k in enumerate(list(ranges) * 30)]
    rows += [(1000, "\U0001F600\U0001F600", None), (1001, "！！", None), (1002, "😀 漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in langid.predict(docs, langid.train(docs)).collect()}
    assert all(got[i] == k for i, _, k in rows if k) and got[1000] == got[1001] == "und" and got[1002] != "und"


def test_language_held_out_accuracy(spark, no_docs, odd_docs):
    sounds = {"aa": ["ba", "do", "mi"], "bb": ["zx", "qur", "py"], "cc": ["nst", "ol", "ek"]}
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(40)), lang) for i, (lang, s) in enumerate(list(sounds.items()) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.predict(docs, langid.train(docs)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out and got[i].lang_pred == rows[i][2] for i in held)
    model = langid.train(odd_docs)
    odd = {x.doc_id: x for x in langid.predict(odd_docs, model).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[6].lang_pred == "und" and odd[3].score == 0
    assert langid.predict(no_docs, langid.train(no_docs)).count() == 0
    assert {x.lang_pred for x in langid.predict(odd_docs, langid.train(no_docs)).collect()} == {"und"}


def brute_measures(t):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark, odd_docs, no_docs):
    loop = "a b c d e f g h i " * 4
    more = [(100, loop + "x\ny\ny\n \n#%|"), (101, "q " * 30), (102, "w1 w2 w3 w4 w5 w6 w7 w8"), (103, "𝒜 𝒜 b ##")]
    docs = odd_docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, "en") for i, t in more], "doc_id long, text string, lang string"))
    for r in quality.measures(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    labels = spark.createDataFrame([(5, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count() and all(r.kept == (not r.base_failed) for r in got)  # too few labels prove nothing
    assert quality.judge(no_docs, labels).count() == 0


def test_quality_thresholds_are_exact_and_limited(spark):
    from math import comb, log

    from pyspark.sql import functions as F

    for n, k, p in ((50, 0, 0.05), (400, 3, 0.05), (1000, 9, 0.02)):
        got = spark.range(1).select(quality.log_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert abs(got - log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))) < 1e-9
    rows, labels = [], []
    for i in range(3000):
        bad = i % 3 == 0
        words = prose(i % 50, 30).split()
        rows.append((i, " ".join(w + "%%%" if bad else w for w in words), "en"))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 3 != 0) for r in got)


def brute_cutoffs(rows, limit, level):
    """rows: (stratum, held, good, {rate: value}) of one stratum; the proven rule or None, by plain counting."""
    from math import comb

    learn = [r for r in rows if not r[1]]
    good, bad = [r for r in learn if r[2]], [r for r in learn if not r[2]]
    best, proven = None, True
    for n, share in enumerate(quality.LEVELS):
        rule = {}
        for rate in quality.RATES:
            for c in quality.CUTOFFS:
                k, caught = sum(r[3][rate] > c for r in good), sum(r[3][rate] > c for r in bad)
                if caught and caught * len(good) >= 2 * k * len(bad) and 1000 * k <= share * len(good):
                    rule[rate] = c
                    break
        if not rule:
            continue
        hits = lambda r, rule=rule: any(r[3][x] > c for x, c in rule.items())
        held = [r for r in rows if r[1] and r[2]]
        k = sum(map(hits, held))
        tail = sum(comb(len(held), i) * limit**i * (1 - limit) ** (len(held) - i) for i in range(k + 1))
        proven = proven and k < len(held) * limit and tail <= level
        if proven and (best is None or sum(map(hits, bad)) > best[0]):
            best = (sum(map(hits, bad)), rule)
    return best[1] if best else None


def test_quality_rules_match_brute_force_and_keep_their_promise(spark):
    """80 strata at once: rules as by plain counting, and hardly any stratum's true rejection over the limit."""
    strata, r = tuple(f"s{i:02}" for i in range(80)), random.Random(11)
    rows, labels, plain, tails = [], [], {}, {}
    for n, name in enumerate(strata):
        tails[name] = tail = r.choice([0.002, 0.01, 0.055, 0.08])  # of good documents with a high rate
        for i in range(r.choice([60, 400, 800])):
            doc_id, good = n * 1000 + i, r.random() < 0.7
            high = r.random() < (tail if good else 0.6)
            values = [r.randrange(300, 400) if high else r.randrange(0, 15), r.randrange(0, 60), 0, r.randrange(0, 9), 0]
            rows.append((doc_id, name, False, *values))
            labels.append((doc_id, int(good)))
            plain.setdefault(name, []).append((name, zlib.crc32(str(doc_id).encode()) % 2 == 0, good, dict(zip(quality.RATES, values, strict=True))))
    measured = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, " + ", ".join(f"{x} int" for x in quality.RATES))
    labels += labels[:50] + [(1, 0), (1, 1)]  # repeated ones count once, contradicting ones not at all
    plain["s00"] = [x for k, x in enumerate(plain["s00"]) if k != 1]
    level = 0.05
    got = quality.cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int"), 0.05, level * 81, strata)
    got = {x.stratum: x.cutoffs for x in got.collect()}
    assert got == {k: v for k, v in ((k, brute_cutoffs(v, 0.05, level)) for k, v in plain.items()) if v is not None}
    risky = [k for k in strata if tails[k] > 0.05]
    assert len(got) > 10 and sum(got.get(k, {}).get("symbol_rate", 999) < 300 for k in risky) <= len(risky) * level + 3


def test_samples_stay_bounded(spark, monkeypatch):
    """100,000 rows under one id, repeated and contradicting labels: the sample that reaches the driver keeps its bounds."""
    from pyspark.sql import functions as F

    seen = {}

    def toxic_fit(texts, y, share):
        seen["toxic"] = list(zip(texts, y, strict=True))

    def lang_fit(samples, most):
        seen["lang"] = samples

    monkeypatch.setattr(toxicity, "fit", toxic_fit)
    monkeypatch.setattr(langid, "fit", lang_fit)
    same = spark.range(50_000).select(F.lit(1).alias("doc_id"), F.lit("one text that many rows repeat").alias("text"), F.lit("en").alias("lang"))
    differ = spark.range(50_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    others = spark.range(2, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    none = spark.range(40).select(F.lit(None).cast("long").alias("doc_id"), F.lit("text without an id").alias("text"), F.lit("fr").alias("lang"))
    docs = same.unionByName(differ).unionByName(others).unionByName(none)
    labels = spark.createDataFrame([(1, 1)] * 500 + [(k, 0) for k in range(2, 60)] + [(7, 1), (None, 1)] * 3 + [(8, None)], "doc_id long, toxic int")
    toxicity.train(docs, labels, per_class=20, most_points=400, hold_out=False)
    for k in (0, 1):
        texts = [t for t, y in seen["toxic"] if y == k]
        assert 5 < len(texts) <= 20
        assert len(set(texts)) == len(texts)
        assert sum(map(len, texts)) <= 400
    assert "other 7" not in {t for t, _ in seen["toxic"]}  # labels of both classes
    langid.train(docs, per_language=15, symbols_per_language=150, hold_out=False)
    assert set(seen["lang"]) == {"en", "de"}
    for texts in seen["lang"].values():
        assert len(texts) <= 15
        assert sum(map(len, texts[:-1])) < 150 + 40


def test_the_driver_gives_back_what_a_fit_took(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"you are a {'nasty fool' if n % 4 == 0 else 'kind friend'} number {n}") for n in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(80)], "doc_id long, toxic int")
    done, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: done.append("fit") or fit(*a))
    monkeypatch.setattr(toxicity, "give_back", lambda: done.append("back"))
    toxicity.train(docs, labels, hold_out=False)
    assert done == ["fit", "back"]
