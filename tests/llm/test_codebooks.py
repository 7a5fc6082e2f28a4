import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from lectern.llm import codebooks as cb


def plain_codes(rows, entries=16, rounds=6, parts=8):
    """(vec_id, vector, label) rows coded with plain numbers, every part against every entry."""
    kept = [(i, [math.floor(4096 * x) for x in v], label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max((len(v) for _, v, _, _ in kept), default=0)
    width = -(-max(1, length) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label, raw) for i, v, label, raw in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _, raw in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3])):
        first.setdefault(i, v)
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = defaultdict(list)
            for _, v, _, _ in kept:
                at[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(at[k]) for c in zip(*at[k], strict=True)] if k in at else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label, _ in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    sums = defaultdict(int)
    for _, label, _, e in out:
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((i, label, c, e, sums[label], digest)) for i, label, c, e in out)


def check(spark, rows, schema="vec_id long, embedding array<float>, label int", **more):
    table = spark.createDataFrame(rows, schema).repartition(3)
    if table.schema["embedding"].dataType.elementType.typeName() == "float":
        rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x, *_ in rows]
    got = cb.compress(table, **more).collect()
    assert sorted(map(repr, map(tuple, got))) == plain_codes([r[:3] for r in rows], **more)
    return got


def test_random_vectors(spark):
    r = random.Random(1)
    check(spark, [(k, [r.gauss(0, 0.2) for _ in range(16)], r.choice([None, 1, 2])) for k in range(700)])


def test_ties_and_clusters(spark):
    """Few different values, so that many distances are equal, and subtrees that lie in one entry's cell."""
    r = random.Random(2)
    rows = [(k, [r.choice([-0.25, 0.0, 0.25]) for _ in range(8)], k % 3) for k in range(400)]
    rows += [(1000 + k, [r.choice([-3, 3]) + r.gauss(0, 0.01) for _ in range(8)], 7) for k in range(600)]
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [None] * 8, [nan] * 8, [inf] * 8, [0.5] * 8, [0.5] * 8, [0.25] * 5, [-0.1] * 19, [0.0] * 16, [-0.0001] * 8, [1.0, None] * 4]
    rows = [(k % 9 if k % 5 else None, v, None if k % 4 == 0 else k % 3, "x", 1) for k, v in enumerate(vectors * 3)]
    check(spark, rows, "vec_id long, embedding array<double>, label int, code string, error int")


def test_few_and_none(spark):
    check(spark, [(3, [0.5, 0.25], 1), (2, [0.5, -0.25], None)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label string")
    assert cb.compress(empty).collect() == []
    assert cb.compress(spark.createDataFrame([(1, None, "a")], "vec_id long, embedding array<float>, label string")).collect() == []


def test_repeated_ids_and_hot_label(spark):
    r = random.Random(4)
    vectors = [[r.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(r.randrange(20), r.choice(vectors), "hot" if r.random() < 0.7 else str(r.randrange(5))) for _ in range(500)]
    check(spark, rows, "vec_id long, embedding array<float>, label string")


def test_blocks(spark, monkeypatch):
    """Results don't depend on how rows lie in partitions and blocks."""
    r = random.Random(6)
    rows = [(k, [r.gauss(0, 0.3) for _ in range(8)], k % 2) for k in range(300)]
    a = check(spark, rows)
    b = cb.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)).collect()
    assert sorted(a) == sorted(b)


def test_elimination_agrees_with_all_distances():
    """For many boxes and entries the tree gives the nearest entry, ties to the lower index; some subtrees go at once."""
    r = np.random.default_rng(5)
    at_once = 0
    for n in (1, 5, 33, 1000, 4000):
        for spread in (3, 50, 5000):
            points = r.integers(-spread, spread, (n, 4))
            points[: n // 2] //= 20
            entries = r.integers(-spread, spread, (9, 4))
            entries[3] = entries[7]
            order, held, low, high, sums = cb.grow(points)
            assert (held == points[order]).all()
            assert (sums[0] == points.sum(0)).all()
            got, whole, single = cb.assign(held, low, high, entries)
            want = ((held[:, None] - entries) ** 2).sum(2).argmin(1)
            assert (got == want).all()
            at_once += int((~single).sum())
    assert at_once > 1000
