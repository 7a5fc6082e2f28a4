import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, n = {}, 0
    for byte in range(256):
        if byte in printable:
            letter[chr(byte)] = byte
        else:
            letter[chr(256 + n)] = byte
            n += 1
    return a, b, letter


def plain_document(libraries, text):
    """(ids of A, ids of B, groups, links) by walking the bytes of one document."""
    a, b, letter = libraries
    if not text:
        return [], [], [], []
    raw = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    spans = []
    for parts in (bytes_a, bytes_b):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        spans.append(out)
    both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
    groups, at = [], [0, 0]
    for end in sorted(both):
        sides = []
        for k, ids in enumerate((ids_a, ids_b)):
            begin = at[k]
            while at[k] < len(ids) and spans[k][at[k]][1] <= end:
                at[k] += 1
            sides.append(",".join(map(str, ids[begin : at[k]])))
        groups.append("|".join(sides))
    links, j = [], 0
    for i, (s, e) in zip(ids_a, spans[0], strict=True):
        while j and spans[1][j - 1][1] > s:
            j -= 1
        while j < len(ids_b) and spans[1][j][0] < e:
            if spans[1][j][1] > s:
                links.append((i, ids_b[j]))
            j += 1
    return ids_a, ids_b, groups, links


def plain_rows(libraries, rows):
    docs = [(i, *plain_document(libraries, t)) for i, t in rows]
    count = defaultdict(int)
    for *_, links in docs:
        for pair in set(links):
            count[pair] += 1
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(
        repr((i, len(a), len(b), len(g), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else ""))
        for i, a, b, g, ls in docs
    )


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


ODD = [
    "plain words, and marks; 12 345 it's o'clock!", "line\nline two\n\nline three\n", " leading", "trailing ", "two  blanks", "tab\tinside and\t at ends\t", "\n", " ", "  ", "\n\n\n", "<|endoftext|> in text<|endoftext|>", "▁ the mark itself", "a▁b", "日本語 と 中文 テキスト", "é̈ combining é ﬁ ½   nbsp 　 wide",
    "🙂🙃 emoji 👩‍👩‍👧 joined", "control \x00\x01\x1f\x7f", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 \U0001f468", "<0x41> <unk> <s> </s>", "x" * 3000, "ab " * 500, "''''' '' 's 't", "word\n 's next\n's", " sep  para\x85nel", "﻿bom", "a ​ b",
]


def test_odd_texts_equal_brute_force(spark, libraries):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(90, None), (91, ""), (None, "an id that is null"), (5, "tab\tinside and\t at ends\t")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, link int, batch string").repartition(3)
    assert rows_of(al.align_documents(docs, A, B)) == plain_rows(libraries, rows)


def test_random_texts_equal_brute_force(spark, libraries, rng_docs):
    rows = [(r.doc_id, r.text) for r in rng_docs.collect()]
    assert rows_of(al.align_documents(rng_docs, A, B)) == plain_rows(libraries, rows)


def test_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(al.align_documents(docs, A, B)) == plain_rows(libraries, rows)


def test_odd_rows(spark, libraries, odd_docs, no_docs):
    assert rows_of(al.align_documents(odd_docs, A, B)) == plain_rows(libraries, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert al.align_documents(no_docs, A, B).collect() == []
    assert al.token_groups(no_docs, A, B).collect() == []


def test_groups_and_counts(spark, libraries, rng_docs):
    rows = {r.doc_id: r.text for r in rng_docs.collect()}
    got = {r.doc_id: r.groups for r in al.token_groups(rng_docs, A, B).collect()}
    plain = {i: plain_document(libraries, t) for i, t in rows.items()}
    assert got == {i: ";".join(g) for i, (_, _, g, _) in plain.items()}
    count = defaultdict(int)
    for *_, links in plain.values():
        for pair in set(links):
            count[pair] += 1
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    counts = al.link_counts(al.aligned_batches(rng_docs, A, B)).collect()
    assert {(r.a, r.b): (r.n, r.best) for r in counts} == {p: (n, n == most[p[0]]) for p, n in count.items()}
    assert len(counts) == len(count)


def test_units_equal_whole_texts(libraries):
    """Random joins of odd pieces: units give what the libraries give for the whole."""
    import random

    r = random.Random(5)
    pieces = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", ".", "12", "é", "日", "▁", " ", "🙂", "<|endoftext|>", "-", "Zx"]
    texts = ["".join(r.choice(pieces) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(1, 9))) for _ in range(1500)]
    index, ends, values = al.aligner(A, B).batch([t.encode() for t in texts])
    at = 0
    for t, end in zip(texts, ends.tolist(), strict=True):
        units = [values[k] for k in index[at:end].tolist() if k >= 0]
        a, b, groups, links = plain_document(libraries, t)
        assert (sum(u[0] for u in units), sum(u[1] for u in units), sum(u[2] for u in units)) == (len(a), len(b), len(groups)), repr(t)
        assert b"".join(u[3] for u in units)[:-1].decode() == ";".join(groups), repr(t)
        assert sum(len(u[4]) // 8 for u in units) == len(links)
        at = end


def test_union_find():
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(30):
        n = r.randint(1, 60)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 70))]
        group = list(range(n))
        for _ in range(n):
            for x, y in edges:
                group[x] = group[y] = min(group[x], group[y])
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert al.components(n, a, b).tolist() == group
