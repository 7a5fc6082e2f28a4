import hashlib

import numpy as np
import pytest

from lectern.llm import fingerprints as fp
from tests.llm.conftest import prose


def plain_places(text):
    """Bins filled one by one with plain numbers."""
    bins = {}
    for h in map(int, fp.shingle_hashes(text.encode())):
        at = h >> 56
        bins[at] = min(h, bins.get(at, h))
    out = []
    for b in range(fp.BINS):
        source = b if b in bins else next(x for x in fp._ASKS[b].tolist() if x in bins)
        value = np.array([bins[source]], np.uint64) ^ fp._SALT[b]
        out.append(int(fp._mix(value)[0]) & 15)
    return out


def plain_likeness(a, b):
    same = sum(x == y for x, y in zip(a, b, strict=True))
    return min(1.0, max(0.0, (same / 256 - 1 / 16) / (15 / 16)))


def plain_edits(rows):
    """All rows of (doc_id, text) by descending id, as the contract says; rows of one id in any order must have one text."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        a, b, c = plain_places(text), plain_places(new), plain_places(after)
        hexes = ["".join(f"{d:x}" for d in p) for p in (a, b)]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *hexes, plain_likeness(a, b), plain_likeness(a, c)))
    return out


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_edits_equal_brute_force(spark, rng_docs):
    want = plain_edits([(r.doc_id, r.text) for r in rng_docs.collect()])
    assert rows_of(fp.fingerprint_edits(rng_docs)) == sorted(map(repr, want))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_edits([(r.doc_id, r.text) for r in docs.collect()])
    got = fp.fingerprint_edits(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert np.mean([r.near_edited for r in got]) > 0.4
    assert np.mean([r.near_next for r in got]) < 0.03


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = fp.fingerprint_edits(odd_docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got)) == sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in rows)
    assert got[0].__fields__ == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    plain = {}
    for r in fp.fingerprints(odd_docs).collect():
        plain.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(plain[r.doc_id] == {r.fingerprint} for r in got)
    assert plain[3] == plain[4] == plain[6]  # null, empty and white space only
    assert plain[2] == plain[5] == plain[7]  # equal texts, and one with wider gaps
    assert {r.edited_sha256 for r in got if r.doc_id == 4} == {hashlib.sha256(b"").hexdigest()}
    assert fp.fingerprint_edits(no_docs).collect() == []
    assert fp.fingerprints(no_docs).collect() == []


def test_single_row_is_its_own_next(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    [r] = fp.fingerprint_edits(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert r.near_next == 1.0


def test_repeated_ids_and_rows(spark):
    rows = [(7, "same text here")] * 40 + [(None, "x y z")] * 5 + [(1, None)]
    got = fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert rows_of(spark.createDataFrame(got)) == sorted(map(repr, plain_edits(rows)))


@pytest.mark.parametrize("words", [3, 12, 60, 600])
def test_estimate_is_near_the_sets(spark, words):
    """The estimate's mean error over many pairs: the bias of agreeing by chance is gone."""
    errors = []
    for seed in range(60):
        a = prose(seed, words).split()
        b = a[: len(a) * 2 // 3] + prose(1000 + seed, words).split()[: len(a) - len(a) * 2 // 3]
        texts = [" ".join(x).encode() for x in (a, b)]
        x, y = (set(fp.shingle_hashes(t).tolist()) for t in texts)
        errors.append(fp._likeness(*map(fp.places, texts)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03
    assert np.max(np.abs(errors)) < 0.35 if words < 30 else np.max(np.abs(errors)) < 0.16


def test_likeness_in_the_jvm(spark, rng_docs):
    texts = [r.text for r in rng_docs.limit(30).collect()]
    prints = [fp.digits(fp.places(t.encode())) for t in texts]
    pairs = [(a, b) for a in prints[:10] for b in prints] + [(None, prints[0])]
    got = spark.createDataFrame(pairs, "a string, b string").select(fp.likeness("a", "b").alias("l"), "a", "b").collect()
    for r in got:
        assert r.l is None if r.a is None else abs(r.l - fp._likeness(fp._undigits(r.a), fp._undigits(r.b))) < 1e-12
