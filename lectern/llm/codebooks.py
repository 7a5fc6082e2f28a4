"""Vector codes by product quantisation, trained with the filtering form of Lloyd's algorithm.

Vectors become integers and are cut into equal parts; each part position has a codebook of a few entries. The rows of a
partition are gathered into blocks, and for each part of a block a kd-tree is built once and written to the shared
folder: parts in the tree's order, and for each node its bounding box, the sum and the count of what lies below.

In each round a task walks its trees from the root, level by level, with the entries that may still be nearest to some
part in a node's box. Against the entry nearest to the box's middle, another one is eliminated if even the corner of
the box that lies farthest in its direction isn't nearer to it (nor as near, if the other's index is higher): distance
differences are linear, so no part in the box can prefer it. Where one entry is left the whole subtree is assigned by
its cached sum and count; in leaves that keep several the parts are compared with those. A task adds up its blocks
and sends one row a sum, so that the shuffle and what the driver gets (the next codebooks) have a fixed size.

All arithmetic is in integers, or in floating point where every value in it is an integer below 2**53.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import ensure_columns, join_heavy, materialise, pack_bytes, tidy, unpack_bytes

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Parts in a leaf at most, and components in a block about.
LEAF = 32
BLOCK = 2 << 20
#: Larger components (that is, vectors' components of LIMIT / SCALE) would overflow the sums of squares.
LIMIT = 1 << 26


def _pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        most = int(np.abs(a).max(initial=0))
        np.save(out, a.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64), allow_pickle=False)
    return pack_bytes(out.getvalue())


def _unpack(raw: bytes) -> Iterator[np.ndarray]:
    at = io.BytesIO(unpack_bytes(raw))
    size = at.getbuffer().nbytes
    while at.tell() < size:
        yield np.load(at, allow_pickle=False).astype(np.int64)


def integers(column: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * x) of each row's components, zeros after a shorter vector's last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(np.array(column.offsets))
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"components must be below {LIMIT // SCALE} in absolute value")
    if (sizes == length).all():
        return scaled.astype(np.int64).reshape(-1, length)
    out = np.zeros((len(sizes), length), np.int64)
    out[np.arange(length) < sizes[:, None]] = scaled
    return out


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and where the last one ends."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def height(n: int) -> int:
    return max(0, (max(1, n) - 1) // LEAF).bit_length()


def grow(points: np.ndarray) -> tuple[np.ndarray, ...]:
    """kd-tree of points: their order, and for all nodes, level by level, least and greatest components and sums."""
    n, order, deep = len(points), np.arange(len(points)), height(len(points))
    for level in range(deep):
        at = bounds(n, level)
        held = points[order]
        wide = (np.maximum.reduceat(held, at[:-1]) - np.minimum.reduceat(held, at[:-1])).argmax(1)
        node = np.repeat(np.arange(len(wide)), np.diff(at))
        order = order[np.lexsort((held[np.arange(n), wide[node]], node))]
    held = points[order]
    starts = [bounds(n, level)[:-1] for level in range(deep + 1)]
    boxes = [np.concatenate([f.reduceat(held, s) for s in starts]) for f in (np.minimum, np.maximum, np.add)]
    return order, held, *boxes


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, in floating point where that is exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * points.shape[1] < 1 << 53 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)


def survivors(low: np.ndarray, high: np.ndarray, entries: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to some point of each box, out of those ``alive``."""
    far = np.iinfo(np.int64).max
    best = np.where(alive, (((low + high)[:, None, :] - 2 * entries) ** 2).sum(2), far).argmin(1)
    near = entries[best][:, None, :]
    corner = np.where(entries > near, high[:, None, :], low[:, None, :])
    gap = ((entries - corner) ** 2).sum(2) - ((near - corner) ** 2).sum(2)
    index = np.arange(len(entries))
    out = (gap > 0) | ((gap == 0) & (index > best[:, None]))
    out[np.arange(len(best)), best] = False
    return alive & ~out


def assign(held: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Nearest entry of each part in the tree's order, ties to the lower index.

    Also the subtrees that were assigned at once (number among all nodes, entry), and which parts weren't in one.
    """
    n, k = len(held), len(entries)
    deep = height(n)
    out, single = np.zeros(n, np.int64), np.ones(n, bool)
    nodes, alive, whole = np.zeros(1, np.int64), np.ones((1, k), bool), []
    for level in range(deep + 1):
        at, first = bounds(n, level), (1 << level) - 1
        alive = survivors(low[first + nodes], high[first + nodes], entries, alive)
        sole = alive.sum(1) == 1
        entry = alive[sole].argmax(1)
        whole.append((first + nodes[sole], entry))
        begin, end = at[nodes[sole]], at[nodes[sole] + 1]
        step = np.zeros(n + 1, np.int64)  # ranges of a level don't overlap: marks at both ends fill them
        value = np.zeros(n + 1, np.int64)
        step[begin] += 1
        step[end] -= 1
        value[begin] += entry
        value[end] -= entry
        mine = np.cumsum(step[:-1]) > 0
        out[mine] = np.cumsum(value[:-1])[mine]
        single &= ~mine
        nodes, alive = nodes[~sole], alive[~sole]
        if level < deep:
            nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], 1).reshape(-1), np.repeat(alive, 2, axis=0)
    if single.any():
        leaf = np.repeat(np.arange(1 << deep), np.diff(bounds(n, deep)))
        may = np.zeros((1 << deep, k), bool)
        may[nodes] = alive
        d = distances(held[single], entries)
        out[single] = np.where(may[leaf[single]], d, np.inf if d.dtype == np.float64 else np.iinfo(np.int64).max).argmin(1)
    return out, whole, single


def _forest(length: int, width: int):
    """(vec_id, embedding, label) -> a row for each block: vec_ids, labels, tree."""
    most = max(1, BLOCK // (width * PARTS))

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, labels = table.column(0).combine_chunks(), table.column(2).combine_chunks()
        points = np.zeros((table.num_rows, width * PARTS), np.int64)
        points[:, :length] = integers(table.column(1), length)
        trees = [a for p in range(PARTS) for a in grow(points[:, p * width : (p + 1) * width])]
        at = pa.array([0, table.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(at, c) for c in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([_pack(*trees)], pa.binary())], names=["vec_ids", "labels", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == most:
                    yield block(held)
                    held, rows = [], 0
        if rows:
            yield block(held)

    return run


def _trees(raw: bytes) -> list[tuple[np.ndarray, ...]]:
    arrays = list(_unpack(raw))
    return [tuple(arrays[p * 5 : p * 5 + 5]) for p in range(PARTS)]


def _round(books: np.ndarray):
    """Trees -> (slot, total): sums of each entry's components and its count, one row for each that isn't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, k, width = books.shape
        total = np.zeros((PARTS, k, width + 1), np.int64)
        for batch in batches:
            for raw in batch.column(0):
                for p, (_, held, low, high, sums) in enumerate(_trees(raw.as_py())):
                    n, deep = len(held), height(len(held))
                    counts = np.concatenate([np.diff(bounds(n, level)) for level in range(deep + 1)])
                    entry, whole, single = assign(held, low, high, books[p])
                    for node, e in whole:
                        np.add.at(total[p, :, :width], e, sums[node])
                        np.add.at(total[p, :, width], e, counts[node])
                    np.add.at(total[p, :, :width], entry[single], held[single])
                    total[p, :, width] += np.bincount(entry[single], minlength=k)
        flat = total.reshape(-1)
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some], pa.int64())], names=["slot", "total"])

    return run


def _encode(books: np.ndarray):
    """Blocks -> (vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in (0, 1))
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, (order, held, low, high, _) in enumerate(_trees(batch.column(2)[i].as_py())):
                    entry = assign(held, low, high, books[p])[0]
                    codes[order, p] = entry
                    error[order] += ((held - books[p][entry]) ** 2).sum(1)
                text = codes.tobytes().hex()
                step = 2 * PARTS
                hexes = pa.array([text[at : at + step] for at in range(0, len(text), step)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, hexes, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _kept(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ensure_columns(vectors, "vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & finite)


def first_books(kept: DataFrame, length: int, width: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, null last; of rows that share an id the least vector."""
    ids = [r["vec_id"] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    named = F.col("vec_id").isin([i for i in ids if i is not None])
    rows = kept.where(F.coalesce(named, F.lit(False)) | (F.col("vec_id").isNull() & F.lit(None in ids))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).collect()
    by_id = {r["vec_id"]: r["embedding"] for r in rows}
    points = np.zeros((len(ids), width * PARTS), np.int64)
    points[:, :length] = integers(pa.array([by_id[i] for i in ids], pa.list_(pa.float64())), length)
    return points.reshape(len(ids), PARTS, width).transpose(1, 0, 2).copy()


def train(forest: DataFrame, books: np.ndarray, rounds: int, watch: Callable[[np.ndarray], None] = lambda b: None) -> np.ndarray:
    """``books`` after so many rounds: each entry becomes floor(sum / count) of what is nearest to it; unused ones stay."""
    for _ in range(rounds):
        sums = forest.select("tree").mapInArrow(tidy(_round(books)), "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total"))
        total = np.zeros(PARTS * books.shape[1] * (books.shape[2] + 1), np.int64)
        for r in sums.collect():  # one row for each entry and component: a fixed number
            total[r["slot"]] = r["total"]
        total = total.reshape(PARTS, books.shape[1], -1)
        count = total[:, :, -1:]
        books = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)
        watch(books)
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, label, code (two hexadecimal digits a part), error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped. Rows that repeat an id, or a whole row,
    stay and count as often as they occur. Vectors of a length that PARTS doesn't divide, and shorter ones than the
    longest, are filled up with zeros. Null ids come last among the first entries; null labels are one label. With fewer
    ids than ``entries`` the codebooks have fewer; a table without vectors gives no rows. Components of LIMIT / SCALE and
    more raise an error. Further columns are ignored.
    """
    kept = _kept(vectors)
    label = kept.schema["label"].dataType.simpleString()
    kind = kept.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, label {label}, code string, error long"
    length = kept.agg(F.max(F.size("embedding"))).first()[0]
    if length is None:
        return vectors.sparkSession.createDataFrame([], f"{out}, label_error long, codebooks_sha256 string")
    length = max(1, length)
    width = -(-length // PARTS)
    forest = materialise(kept.mapInArrow(tidy(_forest(length, width)), f"vec_ids array<{kind}>, labels array<{label}>, tree binary"), "forest")
    books = train(forest, first_books(kept, length, width, entries), rounds)
    rows = materialise(forest.mapInArrow(tidy(_encode(books)), out), "codes")
    named = rows.withColumn("of_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = materialise(named.groupBy("of_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    every = join_heavy(named, totals, ["of_label"], "n", rows.count())
    return every.select("vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
