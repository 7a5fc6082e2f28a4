import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm import huffman, mixing, packing
from lectern.llm.tokens import DocumentTokenizer, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_memo_gives_the_librarys_ids(odd_docs):
    texts = [r.text for r in odd_docs.collect()] + ["a  b", " a", "a ", "a\n\nb", "a\tb", "don't we'll", "x <|endoftext|> y", "日本 語", "a b c", "12ab, __a__ ...''", "é'é", "\x85a b", "naïve, café!"]
    t = tokenizer(PATH)
    for x in texts:
        assert t.encode(x) == ids_of(x)[:-1].tobytes(), x


def test_words_meet_the_library_once_whatever_marks_follow():
    class Counting:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, letters):
            self.asked.append(letters)
            return self.model.tokenize(letters)

    t = DocumentTokenizer(PATH)
    t._model = counting = Counting(t._model)
    texts = [f"a naïve{m} café{m} жук{m} {m}" for m in (",", ".", "!?", "***", "…", "×", "'s,", "<|endoftext|>", "|>", "'", "")]
    ids, ends = t.encode_all([x.encode() for x in texts])
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [ids_of(x)[:-1].tolist() for x in texts]
    assert len(counting.asked) == len(set(counting.asked)) and any(x.endswith("ve") for x in counting.asked)
    asked = len(counting.asked)
    t.encode("a naïve; café; naïve) café#")
    assert len(counting.asked) == asked


def test_packing_covers_every_id(odd_docs, rng_docs, no_docs):
    for docs in (odd_docs, rng_docs):
        rows = packing.pack(docs, PATH, capacity=64).collect()
        pieces = defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(ids_of(r.text))
        for doc_id, group in texts.items():
            assert sum(p.length for p in pieces[doc_id]) == sum(map(len, group))
            if len(group) == 1:
                at = 0
                for p in sorted(pieces[doc_id], key=lambda p: p.start):
                    assert p.start == at and p.doc_tokens == len(group[0]) and p.ids_crc32 == zlib.crc32(group[0][at : at + p.length])
                    at += p.length
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append(r)
        for s in sequences.values():
            at = 0
            for p in sorted(s, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at == 64 or at & (at - 1) == 0  # no padding
    assert packing.pack(no_docs, PATH).count() == 0


def test_placement_minimises_the_sum_of_squares():
    p = packing.SumOfSquares(10)
    rng = np.random.default_rng(2)
    for i in range(300):
        r = int(rng.integers(1, 10))
        before = p.levels.copy()
        p.add(i, b"\0\0\0\0" * r)

        def cost(level, before=before, r=r):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + r < 10:
                n[level + r] += 1
            return (n[1:10] ** 2).sum()

        assert (p.levels[1:10] ** 2).sum() == min(cost(h) for h in range(0, 11 - r) if h == 0 or before[h])


def test_huffman_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(4)
    for n in (2, 3, 17, 300):
        counts = rng.integers(1, 1000, n) ** 2
        lengths = huffman.code_lengths(counts, 16)
        assert np.isclose(sum(2.0 ** -lengths), 1)
        import heapq

        heap, total = [int(c) for c in counts], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            total += s
            heapq.heappush(heap, s)
        assert (counts * huffman.code_lengths(counts, 40)).sum() == total  # 40 bits limit nothing here
        assert lengths.max() <= 16 and (counts * lengths).sum() >= total
        short = huffman.code_lengths(counts, max(2, (n - 1).bit_length()))
        assert short.max() <= max(2, (n - 1).bit_length()) and sum(2.0 ** -short) <= 1
    assert huffman.code_lengths(np.array([5])).tolist() == [1]


def test_huffman_block_round_trip():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 5000), 900).astype(np.uint32)
    used, counts = np.unique(ids, return_counts=True)
    book = huffman.Codebook(used.astype(np.int64), huffman.code_lengths(counts))
    for n in (1, 127, 128, 129, 5000):
        payload, marks = book.encode(ids[:n])
        assert (book.decode(payload, marks, n) == ids[:n]).all()


def test_huffman_holds_more_ids_than_sixteen_bits():
    ids = np.arange(70_000)
    book = huffman.Codebook(ids, huffman.code_lengths(np.ones(70_000)))
    some = np.random.default_rng(8).integers(0, 70_000, 3000).astype(np.uint32)
    payload, marks = book.encode(some)
    assert book.limit == 17 and (book.decode(payload, marks, 3000) == some).all()


def test_huffman_files(odd_docs, rng_docs, no_docs):
    for docs in (rng_docs, odd_docs):
        got = huffman.round_trip(docs, PATH).collect()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        assert len(got) == len(rows)
        starts = sorted(got, key=lambda r: r.start)
        at = 0
        for r, (known, doc_id, text) in zip(starts, rows, strict=True):
            ids = ids_of(text)
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id if known else None, at, len(ids), zlib.crc32(ids))
            at += len(ids)
    assert huffman.round_trip(no_docs, PATH).count() == 0


def test_mixed_documents_keep_columns_and_copies(spark, odd_docs):
    """The stage gives each row as often as the operator takes it, whatever the columns are called."""
    odd = odd_docs.selectExpr("*", "1 AS __n", "2 AS kept_id", "3 AS n_tokens", "4 AS text_key")
    out = mixing.mix_documents(odd, budget_percent=100)
    assert out.columns == odd.columns
    taken = mixing.mix(odd, mixing.domain_of_source(), mixing.WEIGHTS, budget_percent=100).collect()
    count = lambda rows, key: sorted((str(k), sum(key(r) == k for r in rows)) for k in {key(r) for r in rows})
    words = lambda r: (r.doc_id, len((r.text or "").replace("\x0b", " ").split()))
    assert count(out.collect(), words) == count(taken, lambda r: (r.doc_id, r.n_tokens))
    every = mixing.mix_documents(odd, budget_percent=400).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r["count"]) for r in every} >= {(2, 8), (5, 4), (None, 4)}


def brute_fill(budget, children):
    """Fractions: repeat until no child is over its supply."""
    left, open_, share = budget, dict(children), {}
    while open_:
        total = sum(w for _, w in open_.values())
        over = {k: s for k, (s, w) in open_.items() if s * total <= w * left}
        if not over:
            share |= {k: left * w / total for k, (_, w) in open_.items()}
            break
        share |= over
        left -= sum(over.values())
        open_ = {k: v for k, v in open_.items() if k not in over}
    return share


def test_fill_redistributes_among_siblings(spark):
    children = {"a": (10, 5), "b": (1000, 3), "c": (30, 1), "d": (500, 1), "e": (0, 9)}
    rows = [(k, s, w, 700) for k, (s, w) in children.items()]
    got = {r.k: r.share for r in mixing.fill(spark.createDataFrame(rows, "k string, supply long, weight long, budget long"), [], "k").collect()}
    want = brute_fill(700, children)
    assert sum(got.values()) == 700 and all(abs(got[k] - want[k]) < 1 for k in children)


def test_mix_takes_prefixes(odd_docs, rng_docs, no_docs):
    for docs in (rng_docs, odd_docs):
        taken = mixing.mix(docs, mixing.domain_of_source(), mixing.WEIGHTS).collect()
        leaves = defaultdict(list)
        for r in taken:
            leaves[(r.domain, r.lang, r.source)].append(r)
        total = sum(len((r.text or "").split()) for r in docs.collect())
        assert sum(r.taken_tokens for r in taken) <= total * 60 // 100 + 200
        for rows in leaves.values():
            cut = [r for r in rows if r.taken_tokens < r.n_tokens]
            assert len({(r.doc_id, r.n_tokens) for r in cut}) <= 1
            last = max(r.epoch for r in rows)
            assert all(r.epoch == last for r in cut)
    assert mixing.mix(no_docs, mixing.domain_of_source(), mixing.WEIGHTS).count() == 0
    out = mixing.mix_documents(odd_docs, budget_percent=100)
    assert out.columns == odd_docs.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in odd_docs.collect()}
