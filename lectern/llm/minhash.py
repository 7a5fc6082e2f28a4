"""Near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation.

A document's set holds the 64-bit hashes of its five-word shingles. One hash per shingle
fills all bins (its high bits choose the bin); empty bins borrow by optimal densification
(a fixed probe sequence per bin). Equal sets collapse to one node first, so copies never
meet again. Bands of bins give bucket keys. In the first round every bucket that holds
several components offers one centre and only the edges between it and members of other
components: at most as many edges as members. The centre is the member that shares its
buckets with most others (an original among its edited copies), as it is the likeliest to
be linked with the rest. Pairs are checked on the full sets, and links contract components.

Most buckets are then of one component. In the second round all pairs of the others are
tested, and each bucket's work is in proportion to its members or done in blocks:

* Buckets of up to SMALL members offer all their members as centres.
* Larger ones hold documents that share passages without being alike. Their members leave
  them and are posted anew, under the shingles of their prefixes: of a set in one common
  order (the commonest shingles, that over SMALL such members have, come last) the
  first (1 - t) of it. Two sets of similarity t or more share a shingle of their prefixes, so
  no pair is lost, and the passage's shingles, being last, bring few together. Where a prefix
  does reach them, it holds all the set's other shingles, too; so a pair that only meets under
  common shingles has nothing else in common, and one of its sets must consist of them by
  2t / (1 + t) at least: those are the leading sets of such a bucket.
* What still is a large bucket is a family of variants of one text, too far from each other
  to be linked. Its members are dealt into classes by size, of which only neighbours can hold
  similar sets, and into blocks of bounded bytes; a block is one row. Blocks of a family meet in
  a join, and for each pair of blocks all common shingles are counted as a matrix product. A
  block is sent a bounded number of times, however many blocks it meets, and no pair of members
  becomes a row: a pair of blocks gives a spanning forest of the links found.

So all pairs that share a bucket are linked or tested after two rounds.

Skew: buckets are reduced to (count, centre) by aggregates that combine before the
shuffle and joined back, a join that adaptive execution may split; no group is gathered
in one task. The set of a centre of many edges is dealt out in salted copies. Components
are contracted by joins, never on the driver. Working tables go as soon as they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bucketed, discard, ensure_columns, forgotten, keep_rows, materialise, slices, text_bytes, tidy

BINS = 256
#: (rows, least set size, most set size): sets under 134 shingles, where few bins are
#: filled, get short bands. A pair of similarity 0.75 always shares one of the schemes.
SCHEMES = ((3, 1, 134), (5, 100, None))
SIGNATURE = 64
#: Members of a bucket whose pairs are all tested in one round.
SMALL = 64
#: Edges of a centre that share one copy of its set.
SALTED = 256
#: Common shingles that the prefixes' order knows as such.
FREQUENT = 250_000
#: Members of a block of a large bucket at most, about, and bytes of their packed sets.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Tasks that a large bucket's blocks are dealt to at least, and copies of a block for that at most.
BLOCKS_A_TASK, STRIPES = 16, 8
_WORD_MEMO = 400_000
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_ODD = _mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def _probes(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin the bins it asks in turn when it is empty."""
    n = np.arange(bins * tries, dtype=np.uint64).reshape(bins, tries)
    return (_mix(n + _U(0x9E3779B97F4A7C15)) % _U(bins)).astype(np.int64)


_PROBES = _probes(BINS)


class _Memo(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


_memo = _Memo()
forgotten.append(_memo.clear)


def shingle_set(raw: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's lower-cased words; one for a shorter text, none without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(_memo.__getitem__, words)), dtype="<u8")
    if len(h) < k:
        return _mix(np.array([(h * _ODD[8 : 8 + len(h)]).sum(dtype=np.uint64) + _U(len(h))], dtype=np.uint64))
    n = len(h) - k + 1
    total = h[:n] * _ODD[0]
    for i in range(1, k):
        total += h[i : i + n] * _ODD[i]
    return np.unique(_mix(total))


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each bin over sorted hashes; an empty bin takes that of the first filled bin in its probe sequence."""
    where = (hashes >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    full = np.zeros(BINS, dtype=bool)
    full[where[first]] = True
    values = np.zeros(BINS, dtype=np.uint64)
    values[where[first]] = hashes[first]
    if not full.all():
        empty = np.flatnonzero(~full)
        tries = full[_PROBES[empty]]
        hit = tries.argmax(1)
        source = _PROBES[empty, hit]
        found = tries[np.arange(len(empty)), hit]
        some = np.flatnonzero(full)
        source = np.where(found, source, some[(_PROBES[empty, 0] + empty) % len(some)])
        values[empty] = values[source]
    return values


def bands(values: np.ndarray, size: int) -> list[int]:
    keys: list[int] = []
    for rows, least, most in SCHEMES:
        if size >= least and (most is None or size <= most):
            count = BINS // rows
            v = values[: count * rows].reshape(count, rows) * _ODD[16 : 16 + rows]
            h = _mix(v.sum(axis=1, dtype=np.uint64) + _ODD[24] * np.arange(1, count + 1, dtype=np.uint64) + _U(rows))
            keys += h.view(np.int64).tolist()
    return keys


_SKETCH = "uid long, doc_id long, n_shingles long, set_id binary, keys array<long>, signature binary, text_key binary"
_SKETCH_ARROW = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary()), ("text_key", pa.binary())]
)


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for whole in batches:
        for batch in slices(whole, 4 << 20):
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                s, key = shingle_set(raw), hashlib.md5(raw).digest()
                if len(s):
                    v = one_permutation(s)
                    out.append((uid, doc_id, len(s), _set_id(s), bands(v, len(s)), v[:: BINS // SIGNATURE].astype("<u2").tobytes(), key))
                else:
                    out.append((uid, doc_id, 0, None, [], None, key))
                uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SKETCH_ARROW, strict=True)], schema=_SKETCH_ARROW)


def _packed(s: np.ndarray) -> bytes:
    """The high six bytes of each hash, in order."""
    return np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set_id, text) -> (node, shingles), where the text gives that set."""
    for whole in batches:
        for batch in slices(whole, 4 << 20):
            out = []
            for node, set_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                s = shingle_set(raw)
                if _set_id(s) == set_id:
                    out.append((node, _packed(s)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["node", "shingles"])


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            links = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sa, sb = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, held = a[k], _unpacked(sa[k].as_py())
                other = _unpacked(sb[k].as_py())
                both = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(other) - both):
                    links.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return run


def _agreement(x: str, y: str):
    """How many of the signature's places agree, in the JVM."""
    same = F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), lambda i: F.when(F.substring(F.col(x), i * 2 + 1, F.lit(2)) == F.substring(F.col(y), i * 2 + 1, F.lit(2)), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda acc, v: acc + v)


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp, more) after joining the components that ``links`` (a, b) connect; the smallest id names each."""
    rest = [c for c in labels.columns if c != "comp"]
    la, lb = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    edges = links.join(la, "a").join(lb, "b").where("ca <> cb").select(F.col("ca").alias("x"), F.col("cb").alias("y")).distinct()
    edges = materialise(edges, "contracted")
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        hook = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("root"))
        held = materialise(hook.withColumn("moved", F.lit(True)), "hooks")
        moved = True
        while moved:  # pointer jumping: a chain of hooks halves each time
            up = held.select(F.col("x").alias("root"), F.col("root").alias("top"))
            top = F.coalesce("top", "root")
            jumped = materialise(held.drop("moved").join(up, "root", "left").select("x", top.alias("root"), (top != F.col("root")).alias("moved")), "jumps")
            discard(held)
            held, moved = jumped, not jumped.where("moved").isEmpty()
        hook = held.select("x", "root")
        if roots is None:
            new = materialise(hook, "roots")
        else:
            old = roots.join(hook.toDF("root", "top"), "root", "left").select("x", F.coalesce("top", "root").alias("root"))
            new = materialise(old.unionByName(hook.join(roots.select("x"), "x", "left_anti")), "roots")
        sx, sy = hook.toDF("x", "rx"), hook.toDF("y", "ry")
        left = materialise(edges.join(sx, "x").join(sy, "y").where("rx <> ry").select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct(), "contracted")
        discard(edges, roots, held)
        edges, roots = left, new
    if roots is None:
        discard(edges)
        return labels
    out = materialise(labels.join(roots.toDF("comp", "root"), "comp", "left").select(*rest, F.coalesce("root", "comp").alias("comp")), "labels")
    discard(edges, roots)
    return out


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sets -> (shingle, n): each task counts what it has before anything is sent, a bounded number at a time."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n, pa.int64())], names=["shingle", "n"])

    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            held.append(_unpacked(raw.as_py()).view(np.int64))
            size += len(held[-1])
            if size >= 4_000_000:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def _prefixes(percent: int, often):
    """(node, shingles) -> (node, size, key, leads): see prefix_postings()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = often.value
        for batch in batches:
            for k in range(batch.num_rows):
                s = _unpacked(batch.column(1)[k].as_py()).view(np.int64)
                place = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                last = common[place] == s if len(common) else np.zeros(len(s), bool)
                size, first = len(s), len(s) - (len(s) * percent + 99) // 100 + 1
                pure = int(last.sum()) * (100 + percent) >= 2 * percent * size
                order = np.lexsort((s, last))[:first]
                n = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[k].as_py()), pa.int64()), pa.array(np.full(n, size), pa.int64()), pa.array(_mix(s[order].view(np.uint64)).view(np.int64)), pa.array(~last[order] | pure)],
                    names=["node", "size", "key", "leads"],
                )

    return run


def prefix_postings(sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, key, leads): the shingles of each set's prefix, of which similar sets share one.

    Of sets of n and m shingles with Jaccard similarity t at least, t * n are common, so
    the first n - ceil(t * n) + 1 of each, in one order for all, have one in common. Any
    order will do; here the commonest shingles are last, so few prefixes reach them: those of
    over SMALL sets, FREQUENT at most, which travel to the tasks as an array. ``leads``:
    whether the set can be a centre there (see above).
    """
    spark = sets.sparkSession
    counts = sets.select("shingles").mapInArrow(_shingles, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > SMALL)
    often = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").collect()  # a bounded number
    shared = spark.sparkContext.broadcast(np.array(sorted(r["shingle"] for r in often), np.int64))
    return materialise(sets.select("node", "shingles").mapInArrow(_prefixes(percent, shared), "node long, size long, key long, leads boolean"), "prefixes")


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``near`` whose full sets are similar. A set that many pairs name as ``a`` is dealt out in salted copies."""
    copies = near.groupBy("a").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("copies"))
    salted = copies.join(sets.toDF("a", "sa"), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("a", "salt", "sa")
    pairs = near.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    pairs = pairs.join(sets.toDF("b", "sb"), "b").join(salted, ["a", "salt"]).select("a", "b", "sa", "sb")
    return materialise(pairs.mapInArrow(_similar(percent), "a long, b long"), "links")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after joining what ``links`` connect; both inputs are discarded."""
    if links.isEmpty():
        discard(links)
        return labels
    out = merge_components(labels, links)
    if out is not labels:
        discard(labels)
    discard(links)
    return out


def _round(postings: DataFrame, labels: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Buckets of several components (key, centre, n and the number of all members), and the links found from their centres.

    One centre a bucket, or with ``every`` all leading members of the buckets of up to SMALL.
    """
    held = postings.select("node", "size", "key", "leads").join(labels, "node")
    draw = F.min(F.when(F.col("leads"), F.struct("rank", "node", "comp", "size")))
    live = held.groupBy("key").agg(draw.alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    live = materialise(live.where("lo <> hi and c is not null").select("key", F.col("c.node").alias("centre"), F.col("c.comp").alias("centre_comp"), F.col("c.size").alias("centre_size"), "n"), "live")
    if every:
        small = live.where(F.col("n") <= SMALL).select("key")
        centres = held.where("leads").join(small, "key", "left_semi").select("key", F.col("node").alias("centre"), F.col("comp").alias("centre_comp"), F.col("size").alias("centre_size"))
    else:
        centres = live.drop("n")
    # sets whose sizes are too far apart can't be similar
    offered = held.join(centres, "key").where(f"comp <> centre_comp and 100 * least(size, centre_size) >= {int(percent)} * greatest(size, centre_size)")
    edges = offered.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), F.least("size", "centre_size").alias("size")).distinct()
    # at the least similarity 0.75 of the places agree, with a deviation of 3.5 of 64; five deviations
    # below, pairs are far apart. Small sets fill few bins, agree less regularly, and are all checked.
    edges = edges.join(signatures.toDF("a", "sa"), "a").join(signatures.toDF("b", "sb"), "b")
    alike = (F.col("size") < SCHEMES[0][2]) | (_agreement("sa", "sb") >= int(SIGNATURE * percent / 100 - 17))
    near = materialise(edges.where(alike).select("a", "b"), "near")
    links = _confirmed(near, sets, percent)
    discard(near)
    return live, links


def common_counts(rows: list[np.ndarray], columns: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each set (sorted, distinct) of ``rows`` and of ``columns`` have in common, as blocks of a matrix product."""
    sets = [*rows, *columns]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.zeros((2, int(column.max()) + 1 if len(column) else 0), bool)
    shared[(owner >= len(rows)).astype(int), column] = True
    kept = shared.all(0)[column]  # values that both sides have
    owner, column = owner[kept], column[kept]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        mine = (column >= at) & (column < at + width)
        has = np.zeros((len(sets), width), np.float32)
        has[owner[mine], column[mine] - at] = 1
        out += has[: len(rows)] @ has[len(rows) :].T
    return out.astype(np.int64)  # counts under 2**24 are exact


_BLOCK = "key long, class int, own int, nodes array<long>, comps array<long>, sizes array<long>, shingles binary"


def _block(table: pa.Table) -> pa.Table:
    """Members (key, class, own, node, comp, shingles) of one block as one row; a member that is listed twice counts once."""
    nodes = np.array(table.column("node").to_pylist(), np.int64)
    _, first = np.unique(nodes, return_index=True)
    comps, raw = table.column("comp").to_pylist(), table.column("shingles").to_pylist()
    packed = [raw[i] for i in first.tolist()]
    named = [table.column(c)[0].as_py() for c in ("key", "class", "own")]
    cells = [*named, nodes[first].tolist(), [comps[i] for i in first.tolist()], [len(p) // 6 for p in packed], b"".join(packed)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    return pa.table({n.split()[0]: pa.array([c], k) for n, c, k in zip(_BLOCK.split(", "), cells, kinds, strict=True)})


def _opened(sizes: list[int], packed: bytes) -> list[np.ndarray]:
    return np.split(_unpacked(packed), np.cumsum(sizes)[:-1])


def _spanning(a: np.ndarray, b: np.ndarray, comps: tuple[list[int], list[int]]) -> list[int]:
    """Which of the links (places in two lists of components) join components that those before don't."""
    parent: dict[int, int] = {}
    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        roots = []
        for c in (comps[0][x], comps[1][y]):
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            roots.append(c)
        if roots[0] != roots[1]:
            parent[max(roots)] = min(roots)
            kept.append(k)
    return kept


def _met(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks (nodes, comps, sizes, shingles of each, whether they are the same) -> links."""
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, comps, sizes, packed, others, other_comps, other_sizes, other_packed, same = (c[i].as_py() for c in batch.columns)
                left = _opened(sizes, packed)
                right = left if same else _opened(other_sizes, other_packed)
                n, m = np.array(sizes), np.array(other_sizes)
                both = common_counts(left, right)
                alike = 100 * both >= percent * (n[:, None] + m[None, :] - both)
                a, b = np.nonzero((np.triu(alike, 1) if same else alike) & (np.array(comps)[:, None] != np.array(other_comps)[None, :]))
                kept = _spanning(a, b, (comps, other_comps))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[a[k]] for k in kept], pa.int64()), pa.array([others[b[k]] for k in kept], pa.int64())], names=["a", "b"])

    return run


def _family_links(postings: DataFrame, large: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside large buckets."""
    # sets of classes that aren't neighbours differ in size by more than links allow
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    members = postings.select("node", "size", "key").join(large.select("key"), "key", "left_semi").distinct()
    members = members.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / step).cast("int"))
    counts = members.groupBy("key", "class").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(6 * F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    counts = materialise(counts.where("blocks > 0"), "block_counts")
    rows = members.join(counts, ["key", "class"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.join(labels.select("node", "comp"), "node").join(sets, "node").select("key", "class", "own", "node", "comp", "shingles")
    blocks = materialise(rows.groupBy("key", "class", "own").applyInArrow(_block, _BLOCK), "blocks")
    striped = blocks.join(counts.select("key", "class", F.least(F.lit(STRIPES), F.ceil(F.col("blocks") / BLOCKS_A_TASK)).cast("int").alias("stripes")), ["key", "class"])
    left = striped.withColumn("stripe", F.col("own") % F.col("stripes"))
    # a block meets those of its own class, and of the one below, dealt by that class's stripes
    down = counts.select("key", F.col("class").alias("meets"), F.least(F.lit(STRIPES), F.ceil(F.col("blocks") / BLOCKS_A_TASK)).cast("int").alias("stripes"))
    right = blocks.withColumn("meets", F.explode(F.array(F.col("class"), F.col("class") - 1))).join(down, ["key", "meets"])
    right = right.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).select(
        "key", F.col("meets").alias("class"), "stripe", (F.col("meets") == F.col("class")).alias("level"), F.col("own").alias("other"),
        *[F.col(c).alias(f"other_{c}") for c in ("nodes", "comps", "sizes", "shingles")],
    )
    pairs = left.join(right.hint("merge"), ["key", "class", "stripe"]).where("not level or own <= other")
    columns = ["nodes", "comps", "sizes", "shingles", *[f"other_{c}" for c in ("nodes", "comps", "sizes", "shingles")]]
    found = pairs.select(*columns, (F.col("level") & (F.col("own") == F.col("other"))).alias("same")).mapInArrow(_met(percent), "a long, b long")
    out = materialise(found, "families")
    discard(counts, blocks)
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    docs = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialise(docs.mapInArrow(tidy(_sketch), _SKETCH), "sketch")


def _components(docs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(set_id, doc_id, comp): the smallest doc_id of each set and its component's number."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "uid"))
    owners = sketch.where("n_shingles > 0").groupBy("set_id").agg(best.alias("o"), F.first("n_shingles").alias("size"))
    owners = materialise(owners.select("set_id", F.col("o.uid").alias("node"), F.col("o.doc_id").alias("doc_id"), "size"), "owners")
    own = owners.select(F.col("node").alias("uid"))
    every = sketch.join(own.hint("merge"), "uid", "left_semi").select(F.col("uid").alias("node"), F.col("n_shingles").alias("size"), F.explode("keys").alias("key"), F.lit(True).alias("leads"))
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings = materialise(every.join(shared.hint("merge"), "key"), "postings")
    signatures = sketch.select(F.col("uid").alias("node"), "signature")
    labels = materialise(postings.groupBy("node").agg((-F.sum("n")).alias("rank")).select("node", "rank", F.col("node").alias("comp")), "labels")
    # the sets of all nodes that share a key, once; repeated ids are told apart by the set
    wanted = owners.join(labels.select("node"), "node")
    texts = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = texts.join(wanted.hint("merge"), texts["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "set_id", "text")
    sets = bucketed(found.mapInArrow(tidy(_sets), "node long, shingles binary"), "sets", "node")
    live, links = _round(postings, labels, signatures, sets, percent, every=False)
    labels = _merged(labels, links)
    large = live.where(F.col("n") > SMALL).select("key")
    hubs = materialise(postings.join(large, "key", "left_semi").select("node").distinct(), "hubs")
    rest = postings.join(live.where(F.col("n") <= SMALL).select("key"), "key", "left_semi").select("node", "size", "key", "leads")
    hub_sets = materialise(sets.join(hubs, "node"), "hub_sets")
    prefixes = prefix_postings(hub_sets, percent)
    rest = materialise(rest.unionByName(prefixes), "postings")
    discard(postings, live, hubs, hub_sets, prefixes)
    live, links = _round(rest, labels, signatures, sets, percent, every=True)
    families = _family_links(rest, live.where(F.col("n") > SMALL), labels, sets, percent)
    labels = _merged(_merged(labels, links), families)
    discard(rest, live)
    out = materialise(owners.join(labels.select("node", "comp"), "node", "left").select("set_id", "doc_id", F.coalesce("comp", "node").alias("comp")), "nodes")
    discard(owners, labels, sets)
    return out


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of Jaccard similarity of at
    least ``percent`` / 100, the row's own included. A text without words (null, empty)
    has no set and stands alone. Rows that repeat a text share a component; of rows that
    also repeat the doc_id each is kept alike. A null doc_id is never smallest; a group of
    such rows only has a null component and is kept. An empty table gives no rows; further
    columns are ignored.
    """
    sketch = _sketches(docs)
    nodes = _components(docs, sketch, percent)
    first = nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = materialise(nodes.join(first, "comp").select("set_id", "component_id"), "classes")
    discard(nodes)
    rows = sketch.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: of the smallest doc_id, null last, and of its texts any one.

    Rows without words (null or blank text) all stay. Rows that repeat id and text become
    one; rows that repeat only the id, or have none, are told apart by their texts. An
    empty table stays empty; working columns avoid the names of the table's own.
    """
    sketch = _sketches(docs)
    nodes = _components(docs, sketch, percent)
    rows = sketch.where("n_shingles > 0").groupBy("set_id", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "rows")).alias("o")
    kept = rows.join(nodes.select("set_id", "comp"), "set_id").groupBy("comp").agg(best).select("o.doc_id", "o.text_key", "o.rows", F.lit(1).cast("long").alias("copies"))
    blank = sketch.where("n_shingles = 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    kept = materialise(kept.unionByName(blank.withColumn("copies", F.col("rows"))), "kept")
    discard(nodes, sketch)
    return keep_rows(docs, kept)
