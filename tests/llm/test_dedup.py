import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from lectern.llm import chunk_dedup, exact_dedup, minhash, suffix_dedup
from tests.llm.conftest import prose

WS = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[WS.sub("", r.text or "")].append(r)
    out = []
    for t, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        out += [(r.doc_id, best.doc_id, len(members), hashlib.sha256(t.encode()).hexdigest()) for r in members]
    return sorted(out, key=repr)


def test_exact_matches_brute_force(odd_docs, rng_docs):
    for docs in (odd_docs, rng_docs):
        for size in (64, 16384):  # many levels of pairs, and one block
            got = exact_dedup.exact_duplicates(docs, size).collect()
            assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_exact(docs.collect())
            kept = defaultdict(int)
            for r in got:
                kept[r.text_sha256] += r.kept
            assert set(kept.values()) == {1}


def test_exact_stage_keeps_columns(odd_docs, no_docs):
    out = exact_dedup.drop_exact_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [WS.sub("", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({WS.sub("", r.text or "") for r in odd_docs.collect()})
    assert exact_dedup.exact_duplicates(no_docs).count() == 0 == exact_dedup.drop_exact_duplicates(no_docs).count()
    named = odd_docs.selectExpr("*", "1 AS __id", "2 AS __n", "3 AS kept_key", "4 AS text_key", "5 AS ROW_ID")
    kept = exact_dedup.drop_exact_duplicates(named).collect()
    assert exact_dedup.drop_exact_duplicates(named).columns == named.columns and {r["__n"] for r in kept} == {2}
    best = {sha: i for i, keep, _, sha in brute_exact(odd_docs.collect()) for i in [keep]}
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, best.values()))


def brute_components(rows, k=5):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else []))

    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_matches_brute_force(rng_docs):
    want = brute_components(rng_docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rng_docs).collect()}
    assert got == want


def test_near_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd_docs.count()
    assert by[5].component_id == by[7].component_id == 2 and by[2].kept and not by[5].kept
    assert by[None].component_id == 2 and not by[None].kept  # a near copy of the rows above
    for i in (3, 4, 6):
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[9].component_id == by[10].component_id == 9 and by[9].n_shingles == 1
    assert minhash.near_duplicates(no_docs).count() == 0


def test_near_pairs_behind_other_centres(spark, monkeypatch):
    """One bucket holds a family whose first centres resemble nobody enough; its pairs are found all the same."""
    sketch = minhash._sketch

    def one_bucket(batches):
        for b in sketch(batches):
            yield b.set_column(4, "keys", pa.array([[1]] * b.num_rows, pa.list_(pa.int64())))

    monkeypatch.setattr(minhash, "_sketch", one_bucket)
    slots = [[f"s{i}v{a}w{k}" for k in range(10)] for i in range(16) for a in range(2)]
    picks = np.random.default_rng(5).integers(0, 2, (14, 16)).tolist()
    picks += [[1 - v if i == 0 else v for i, v in enumerate(picks[d])] for d in (9, 12)]
    rows = [(d, " ".join(w for i, a in enumerate(p) for w in slots[2 * i + a])) for d, p in enumerate(picks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_components(docs.collect())
    assert want[14][1] == 9 and want[15][1] == 12 and len({c for _, c in want.values()}) == 14
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == want


def test_near_by_prefixes(rng_docs, monkeypatch):
    """With buckets of over two members split by prefixes, the components are the same."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    want = brute_components(rng_docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rng_docs).collect()}
    assert got == want


def test_near_family_behind_a_common_passage(spark, monkeypatch):
    """Documents that share a passage of two thirds, some of them alike: common shingles bring nobody together that isn't."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "SALTED", 2)
    passage = prose(70, 120)
    rows = [(i, passage + " " + prose(900 + i // 3, 60 if i % 3 else 56)) for i in range(60)] + [(100 + i, passage + " " + prose(2000 + i, i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(docs.collect())
    assert 10 < len({c for _, c in want.values()}) < 60
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == want


def test_near_stage_on_odd_rows(odd_docs, no_docs):
    """One row of each component, blank rows all; rows that repeat an id are told apart by their texts."""
    odd = odd_docs.selectExpr("*", "1 AS __id", "2 AS row_key", "3 AS comp")
    out = minhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [2, 3, 4, 6, 8, 9, 11, 12]))
    extra = odd_docs.where("doc_id = 9").selectExpr("uid", "2L AS doc_id", "text", "lang", "source", "bucket", "spans")
    again = minhash.drop_near_duplicates(odd_docs.union(extra)).where("text = 'one two'").collect()
    assert [r.doc_id for r in again] == [2]
    assert minhash.drop_near_duplicates(no_docs).count() == 0


def test_near_families_in_small_blocks(spark, monkeypatch):
    """Blocks of four members: buckets of several blocks give the same components as brute force."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCKS_A_TASK", 2)
    slots = [[f"s{i}v{a}w{k}" for k in range(10)] for i in range(16) for a in range(2)]
    picks = np.random.default_rng(5).integers(0, 2, (40, 16)).tolist()
    picks += [[1 - v if i == 0 else v for i, v in enumerate(picks[d])] for d in (9, 12, 33)]
    rows = [(d, " ".join(w for i, a in enumerate(p) for w in slots[2 * i + a])) for d, p in enumerate(picks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(docs.collect())
    assert len({c for _, c in want.values()}) < 43
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == want


def test_family_links_by_blocks_and_classes(spark, monkeypatch):
    """Links of one bucket, found by blocks of sizes' classes, connect exactly what all pairs do."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCKS_A_TASK", 2)
    rng = np.random.default_rng(8)
    sets = [np.unique(minhash._mix(rng.integers(0, 3000, rng.integers(30, 400)).astype(np.uint64))) for _ in range(60)]
    for k in range(25):  # with up to a quarter of their values gone, some just too few, others just enough
        whole = sets[k]
        sets.append(np.sort(rng.permutation(whole)[: int(np.ceil(len(whole) * (0.74 + 0.01 * (k % 4))))]))
    rows = [(n, len(s), 1, minhash._packed(s), n) for n, s in enumerate(sets)]
    rows += rows[:10]  # members that are listed twice
    table = spark.createDataFrame(rows, "node long, size long, key long, shingles binary, comp long").repartition(3)
    large = spark.createDataFrame([(1,)], "key long")
    unique = table.dropDuplicates(["node"])
    got = minhash._family_links(table.select("node", "size", "key"), large, unique.select("node", "comp"), unique.select("node", "shingles"), 75).collect()
    pairs = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert len(pairs) > 10
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in got} == pairs  # here no two links join the same components


def test_blocks_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """What a family's members cost to send grows with them, not with members times blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    sent = {}
    blocks_of = minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, label: sent.setdefault(label, blocks_of(df, label)))
    rng = np.random.default_rng(9)
    for n in (40, 160):
        sent.clear()
        sets = [np.unique(minhash._mix(rng.integers(0, 10**6, 50).astype(np.uint64))) for _ in range(n)]
        table = spark.createDataFrame([(k, len(s), 1, minhash._packed(s), k) for k, s in enumerate(sets)], "node long, size long, key long, shingles binary, comp long")
        monkeypatch.setattr(minhash, "discard", lambda *t: None)
        minhash._family_links(table.select("node", "size", "key"), spark.createDataFrame([(1,)], "key long"), table.select("node", "comp"), table.select("node", "shingles"), 75)
        blocks = sent["blocks"].selectExpr("size(nodes) AS n", "length(shingles) AS b").collect()
        assert sum(r.n for r in blocks) == n  # each member lies in one block
        assert max(r.n for r in blocks) <= 16


def test_densified_bins_agree_as_sets_do():
    rng = np.random.default_rng(0)
    hits = []
    for _ in range(200):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (30, 5, 5))
        x, y = (minhash.one_permutation(np.unique(minhash._mix(np.concatenate([common, o])))) for o in (a, b))
        hits.append((x == y).mean())
    assert abs(np.mean(hits) - 30 / 40) < 0.04


def brute_suffix(rows, size=50):
    seen, out = {}, {}
    ordered = sorted(((r.doc_id, (r.text or "").encode()) for r in rows), key=lambda x: x[0])
    for i, b in ordered:
        for p in range(len(b) - size + 1):
            seen.setdefault(b[p : p + size], i)
    for i, b in ordered:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_matches_brute_force(rng_docs):
    want = brute_suffix(rng_docs.collect())
    for options in ({}, {"batch_bytes": 3000, "bucket_bytes": 500}):
        got = suffix_dedup.suffix_duplicates(rng_docs, **options).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
        for r in got:
            assert sum(s["length"] for s in r.spans) == r.n_removed


def test_suffix_with_heavy_grams(spark, rng_docs, monkeypatch):
    """Grams of over three runs have their windows dealt one by one; the result is that of brute force."""
    monkeypatch.setattr(suffix_dedup, "HEAVY_RUNS", 3)
    line = "this line of over fifty bytes is in every document, whatever it is about; see also page 7\n"
    rows = [(i, prose(i, 12) + "\n" + line + prose(300 + i, 9 + i % 5)) for i in range(60)] + [(100 + i, line * 3) for i in range(3)] + [(200, "a" * 400), (201, "a" * 300 + "b")]
    for docs in (rng_docs, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)):
        want = brute_suffix(docs.collect())
        for options in ({}, {"batch_bytes": 3000, "bucket_bytes": 500}):
            got = suffix_dedup.suffix_duplicates(docs, **options).collect()
            assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_a_common_line_makes_no_large_group(spark, monkeypatch):
    """A line in every document, with other text at both its ends: no gram has more than a set number of contexts in a bucket."""
    line = "this line of over fifty bytes is in every document, whatever it is about; see also page 7"
    rows = [(i, prose(i, 12) + " " + line + " " + prose(900 + i, 12)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def most(limit):
        monkeypatch.setattr(suffix_dedup, "HEAVY_RUNS", limit)
        table = suffix_dedup.materialise(docs.select("doc_id", "text").mapInArrow(suffix_dedup.gather(4000), suffix_dedup.BATCHES), "batches")
        _, contexts = suffix_dedup.routed(table, 50, 32)
        found = defaultdict(set)
        for r in contexts.collect():
            joined, at = suffix_dedup.unpack_bytes(bytes(r.contexts)), 0
            for off, n in zip(r.offsets, r.windows, strict=True):
                context = joined[at : at + n + 49]
                at += len(context)
                found[r.bucket, context[off : off + 16]].add(context)
        return max(map(len, found.values()))

    assert most(10**9) > 300  # as many as documents
    assert most(50) <= 50


def test_suffix_odd_rows(odd_docs, no_docs):
    rows = [r for r in odd_docs.collect() if r.doc_id is not None]
    want = brute_suffix({r.doc_id: r for r in rows}.values())
    got = suffix_dedup.suffix_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.n_removed >= r.n_bytes - 60  # counts as the last document: its copy of the base goes
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.suffix_duplicates(no_docs).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    place = rng.permutation(3900)[:700].astype(np.int64)
    group = np.sort(rng.integers(0, 9, 700))
    order = suffix_dedup.SuffixOrder(data).sort(place, group, 50)
    raw = data.tobytes()
    keys = [(group[i], raw[place[i] : place[i] + 50]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(700))


def test_chunks_resist_shifts():
    text = hashlib.sha512(b"x").hexdigest().encode() * 3 + b"".join(hashlib.md5(bytes([i])).hexdigest().encode() for i in range(120))
    a = {text[s:e] for s, e in zip([0, *chunk_dedup.cut_points(text)], chunk_dedup.cut_points(text), strict=False)}
    moved = b"inserted words " + text
    b = {moved[s:e] for s, e in zip([0, *chunk_dedup.cut_points(moved)], chunk_dedup.cut_points(moved), strict=False)}
    assert len(a & b) > 0.9 * len(a)
    assert chunk_dedup.cut_points(b"") == [] and chunk_dedup.cut_points(text)[-1] == len(text)


def plain_cuts(text: bytes, least=8, usual=20, most=512):
    """Cut points by the plain definition: the hash of the last 16 bytes, one byte at a time."""
    mask, gear = (1 << 64) - 1, []
    for i in range(256):
        x = (i + 1) * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        gear.append((x * 0xBF58476D1CE4E5B9 & mask) >> 32)
    ends, last = [], 0
    for n in range(1, len(text) + 1):
        h = sum(gear[text[n - 1 - k]] << 2 * k for k in range(min(16, n))) & 0xFFFFFFFF
        here = h < (1 << 32) // usual and n - last >= least or n == len(text)
        while here and n - last > most:
            last += most
            ends.append(last)
        if here and n > last:
            ends.append(n)
            last = n
    return ends


def test_cuts_match_the_plain_definition():
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 40, 3000):
        text = bytes(rng.integers(97, 123, n).astype(np.uint8))
        assert chunk_dedup.cut_points(text) == plain_cuts(text)
    assert chunk_dedup.cut_points(b"a" * 2000) == plain_cuts(b"a" * 2000)


def test_chunk_duplicates(rng_docs, odd_docs, no_docs):
    rows = {r.doc_id: (r.text or "").encode() for r in rng_docs.collect()}
    owner = {}
    for i in sorted(rows):
        for s, e in zip([0, *chunk_dedup.cut_points(rows[i])], chunk_dedup.cut_points(rows[i]), strict=False):
            owner.setdefault(rows[i][s:e], i)
    got = {r.doc_id: r for r in chunk_dedup.chunk_duplicates(rng_docs).collect()}
    for i, raw in rows.items():
        spans = []
        for s, e in zip([0, *chunk_dedup.cut_points(raw)], chunk_dedup.cut_points(raw), strict=False):
            if owner[raw[s:e]] < i:
                if spans and spans[-1][1] == s:
                    spans[-1][1] = e
                else:
                    spans.append([s, e])
        assert [(s["start"], s["start"] + s["length"]) for s in got[i].spans] == [(a, b) for a, b in spans if b - a >= 80]
        assert (got[i].n_dup_bytes, got[i].n_dup_chunks) == (sum(b - a for a, b in spans), sum(owner[raw[s:e]] < i for s, e in zip([0, *plain_cuts(raw)], plain_cuts(raw), strict=False)))
    assert all(got[i].n_removed > 100 for i in range(181, 200))  # the shared passage of 55 words
    small = chunk_dedup.chunk_duplicates(rng_docs, batch_bytes=3000, bucket_bytes=500)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, got.values()))
    odd = {r.doc_id: r for r in chunk_dedup.chunk_duplicates(odd_docs).collect()}
    assert odd[2].n_removed == 0 and odd[5].n_removed == odd[5].n_bytes and odd[3].n_chunks == 0 and odd[12].n_removed > 200
    cut = {r.doc_id: r.text for r in chunk_dedup.cut_documents(odd_docs).collect()}
    assert cut[5] == "" and cut[9] == "one two" and cut[3] is None
    named = odd_docs.selectExpr("*", "1 AS __id", "2 AS cut_key", "3 AS n_bytes")
    assert chunk_dedup.cut_documents(named).columns == named.columns and chunk_dedup.cut_documents(no_docs).count() == 0
    assert chunk_dedup.chunk_duplicates(no_docs).count() == 0


def test_chunks_find_short_passages_and_copies(spark, odd_docs):
    """Passages of 260 bytes in two contexts each, and copies of documents shorter than a run."""
    rows = []
    for i in range(300):
        passage = prose(7000 + i, 60)[:260]
        rows += [(2 * i + k, prose(8000 + 2 * i + k, 30) + " " + passage + " " + prose(9000 + 2 * i + k, 30)) for k in range(2)]
    got = {r.doc_id: r for r in chunk_dedup.chunk_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1].n_removed > 0 for i in range(300)) >= 297
    assert all(got[2 * i].n_removed == 0 for i in range(300))
    odd = {r.doc_id: r for r in chunk_dedup.chunk_duplicates(odd_docs, whole_copies=True).collect()}
    assert odd[9].n_removed == 0 and odd[10].n_removed == odd[10].n_bytes == 7 and odd[10].n_spans == 1
