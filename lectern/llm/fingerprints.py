"""Document fingerprints: one-permutation MinHash, kept as packed low-order bits.

Each shingle of a text is hashed once; the hash's high bits choose one of BINS bins, which keeps its least hash. A bin
that stays empty borrows by optimal densification: it asks the other bins in an order of its own, the same for all
texts, until one is full. Of each bin's value, hashed again together with the bin's number (so that borrowed values are
as independent as others), the lowest BITS bits are kept: a hexadecimal digit a bin, a string of BINS digits a text.

Two bins with different values agree in one of 2**BITS cases by chance. If m of BINS places agree, the likeness is
therefore (m / BINS - c) / (1 - c) with c = 2**-BITS, cut to [0, 1]: an estimate of the Jaccard similarity of the sets.

Shingles are windows of five lower-cased words, those that begin before the text or end after it included, so that
short texts have several; a text of fewer words has its windows of five bytes, too. A text without words has one
shingle of its own: such texts have equal fingerprints, and nothing else resembles them.

``fingerprints`` is one pass without a shuffle. ``fingerprint_edits`` needs each document's neighbour in descending
order of doc_id: texts are dealt out once, by ranges of the id; each task walks its sorted range with one row held back.
A range's first and last row (two rows a task) are written beside the results and paired afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.minhash import _ODD, _memo, _mix
from lectern.llm.shared import ensure_columns, materialise, slices, tidy

BINS = 256
BITS = 4
WORDS = 5

_U = np.uint64
_CHANCE = 2.0**-BITS
_EDGE = np.full(WORDS - 1, _mix(np.array([7], np.uint64))[0])
_BLANK = _mix(np.array([11], np.uint64))
_SALT = _mix(np.arange(1, BINS + 1, dtype=np.uint64) + _U(0x5851F42D4C957F2D))
#: For each bin all bins in the order in which it asks them.
_ASKS = np.argsort(_mix(np.arange(BINS * BINS, dtype=np.uint64) + _U(0x14057B7EF767814F)).reshape(BINS, BINS), axis=1).astype(np.int64)
#: Bins asked at first; nearly always one of them is full.
_FEW = 24


def _windows(values: np.ndarray, first: int) -> np.ndarray:
    n = len(values) - WORDS + 1
    total = values[:n] * _ODD[first]
    for i in range(1, WORDS):
        total += values[i : i + n] * _ODD[first + i]
    return _mix(total)


def shingle_hashes(raw: bytes) -> np.ndarray:
    """Hashes of a text's shingles, in no order, repeated ones included."""
    words = raw.lower().split()
    if not words:
        return _BLANK
    known = np.frombuffer(b"".join(map(_memo.__getitem__, words)), dtype="<u8")
    out = _windows(np.concatenate([_EDGE, known, _EDGE]), 32)
    if len(words) < WORDS:
        letters = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64) + _U(1)
        out = np.concatenate([out, _windows(np.concatenate([_EDGE, _mix(letters), _EDGE]), 40)])
    return out


def places(raw: bytes) -> np.ndarray:
    """The fingerprint as numbers, one of BITS bits for each bin."""
    hashes = np.sort(shingle_hashes(raw))
    where = (hashes >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    full, values = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    full[where[first]] = True
    values[where[first]] = hashes[first]
    if len(first) < BINS:
        empty = np.flatnonzero(~full)
        found = full[_ASKS[empty, :_FEW]]
        source = _ASKS[empty, found.argmax(1)]
        late = ~found.any(1)
        if late.any():
            source[late] = _ASKS[empty[late], full[_ASKS[empty[late]]].argmax(1)]
        values[empty] = values[source]
    return (_mix(values ^ _SALT) & _U(2**BITS - 1)).astype(np.uint8)


def digits(p: np.ndarray) -> str:
    return (p[0::2] << 4 | p[1::2]).tobytes().hex()


def _undigits(text: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack([packed >> 4, packed & 15], axis=1).reshape(-1)


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    m = int(np.count_nonzero(a == b))
    return min(1.0, max(0.0, (m / BINS - _CHANCE) / (1 - _CHANCE)))


def likeness(a: Column | str, b: Column | str) -> Column:
    """The same for two columns of fingerprints, in the JVM; null if one is null."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 1).otherwise(0))
    value = (same / BINS - _CHANCE) / (1 - _CHANCE)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PLAIN = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield _batch([(i, len(t), digits(places(t.encode()))) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)], _PLAIN)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars (code points), fingerprint (BINS hexadecimal digits).

    Null counts as the empty text, which has a fingerprint as any other. Equal texts have equal fingerprints, and so
    have texts that differ only in the case of A-Z or in white space between words. Repeated rows, null ids and further
    columns do no harm; an empty table gives no rows.
    """
    rows = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidy(_fingerprint), "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_WALK = pa.schema([*_RESULT, ("kind", pa.string()), ("range", pa.int32()), ("text", pa.string())])


def _compared(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    raw = edited(text, following).encode()
    new = places(raw)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), digits(own), digits(new), _likeness(own, new), _likeness(own, other)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order -> a result for all but the last, and the range's first and last row."""
    number, held = TaskContext.get().partitionId(), None

    def end(kind: str) -> tuple:
        doc_id, text, own = held
        return doc_id, None, None, digits(own), None, None, None, kind, number, text

    for whole in batches:
        for batch in slices(whole):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                now = doc_id, text, places(text.encode())
                if held:
                    rows.append((*_compared(*held, now[1], now[2]), "done", None, None))
                    held = now
                else:
                    held = now
                    rows.append(end("first"))
            yield _batch(rows, _WALK)
    if held:
        yield _batch([end("last")], _WALK)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, fingerprint, next text, next fingerprint) of ranges' last rows -> results."""
    for batch in batches:
        rows = [_compared(i, t, _undigits(p), u, _undigits(q)) for i, t, p, u, q in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _batch(rows, pa.schema(_RESULT))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next text's are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited form
    has its last third (floor of n_chars / 3 code points) replaced by the first as many of the next document in
    descending order of doc_id; after the last comes the first. Null texts count as empty. Null ids come last; rows that
    share an id follow each other in an order fixed by their texts. A single row is its own next. An empty table gives
    no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # equal ids, and equal rows, are dealt to several ranges if they are many
    rows = rows.withColumn("by_text", F.xxhash64("text")).withColumn("by_row", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), F.asc("by_text"), F.asc("by_row")]
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    walked = materialise(ranges.select("doc_id", "text").mapInArrow(tidy(_walk), f"{_RESULT_DDL}, kind string, range int, text string"), "fingerprints")
    done = walked.where("kind = 'done'").select(*[n for n, _ in _RESULT])
    ends = [r["range"] for r in walked.where("kind = 'first'").select("range").orderBy("range").collect()]  # a number a task
    if not ends:
        return done
    following = spark.createDataFrame(list(zip(ends, [*ends[1:], ends[0]], strict=True)), "range int, next int")
    last = walked.where("kind = 'last'").select("range", "doc_id", "text", "fingerprint").join(following, "range")
    first = walked.where("kind = 'first'").select(F.col("range").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    paired = last.join(first, "next").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return done.unionByName(paired.mapInArrow(_pair, _RESULT_DDL))
