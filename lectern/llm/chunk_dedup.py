"""Substring de-duplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; where it falls under a bound, a chunk ends. As a
cut depends only on the last bytes, an insertion moves chunk borders nearby and no
others. A chunk whose digest also occurs in a document with a smaller id is a duplicate;
neighbouring duplicates form runs, and runs of at least ``least_run`` bytes are removed;
with ``whole_copies`` a document whose every chunk is a duplicate goes whole, however
short. Chunks are small against the run, so that a repeated passage loses little at its
two ends. All duplicate bytes are counted, those of shorter runs, too.

Digests travel as arrays: a batch of documents sends each occupied bucket its distinct
digests, once, with their smallest document; the bucket answers with the smallest document
of the whole corpus for those that several documents hold. So a digest that a third of all
rows hold reaches its task once for each batch, and disk holds little more than 16 bytes
for a chunk. Chunks are cut again when the answers come; a batch's texts are its only
state. Batches and buckets have bounded bytes; the number of buckets follows the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import BATCHES, buckets_of, gather, materialise, occupied, open_batch, pack_bytes, spare, text_bytes, text_key, unpack_bytes

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Null ids count as this in comparisons, and are given back as null.
LAST = (1 << 63) - 1


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()
WINDOW = 16


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 16 bytes at each place: sum of gear[b[i-k]] << 2k, built by doubling."""
    h = GEAR[data]
    reach = 1
    while reach < WINDOW:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(2 * reach))
        reach *= 2
    return h


def cut_points(data: bytes, least: int = 8, usual: int = 20, most: int = 512) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length."""
    n = len(data)
    if not n:
        return []
    marks = np.flatnonzero(rolling(np.frombuffer(data, np.uint8)) < np.uint32((1 << 32) // usual)) + 1
    ends, last = [], 0
    for p in [*marks.tolist(), n]:
        if p - last < least and p < n:
            continue
        while p - last > most:
            last += most
            ends.append(last)
        if p > last:
            ends.append(p)
            last = p
    return ends


def _chunks(raw: bytes, sizes: list[int], options: tuple[int, int, int]):
    """Chunks of a batch's documents: start, size, document, and the index of each in the distinct digests (sorted, as pairs)."""
    digests, starts, lengths, counts, begin, blake = [], [], [], [], 0, hashlib.blake2b
    for size in sizes:
        text, last = raw[begin : begin + size], 0
        ends = cut_points(text, *options)
        for end in ends:
            digests.append(blake(text[last:end], digest_size=16).digest())
            starts.append(last)
            lengths.append(end - last)
            last = end
        counts.append(len(ends))
        begin += size
    pairs = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    order, index = _distinct(pairs)
    return np.array(starts, np.int64), np.array(lengths, np.int64), np.repeat(np.arange(len(sizes)), counts), pairs[order], index


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct pair, in order, and for each row the number of its pair."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    held = pairs[order]
    new = np.concatenate([[True], (held[1:] != held[:-1]).any(1)]) if len(held) else np.zeros(0, bool)
    index = np.empty(len(pairs), np.int64)
    index[order] = np.cumsum(new) - 1
    return order[new], index


def _ids(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([LAST if i is None else i for i in doc_ids], np.int64)


def _send_digests(options: tuple[int, int, int], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                batch, doc_ids, sizes, texts = [rows.column(i)[k].as_py() for i in range(4)]
                raw, _, _ = open_batch(sizes, texts)
                _, _, doc, digests, index = _chunks(raw, sizes, options)
                holder = _ids(doc_ids)[doc]
                least, most = np.full(len(digests), LAST), np.full(len(digests), -LAST - 1)
                np.minimum.at(least, index, holder)
                np.maximum.at(most, index, holder)
                spans = occupied(buckets_of(digests[:, 0], buckets))
                cells = [[b for b, _, _ in spans], [batch] * len(spans), [digests[x:y].tobytes() for _, x, y in spans]]
                cells += [[pack_bytes(v[x:y].tobytes()) for _, x, y in spans] for v in (least, most)]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["bucket", "batch", "digests", "least", "most"])

    return run


def _first_documents(table: pa.Table) -> pa.Table:
    """For one bucket: to each batch, which of its digests several documents hold and the smallest of these."""
    parts = [np.frombuffer(d, np.uint64).reshape(-1, 2) for d in table.column("digests").to_pylist()]
    order, index = _distinct(np.concatenate(parts))
    least, most = np.full(len(order), LAST), np.full(len(order), -LAST - 1)
    for value, name, at in ((least, "least", np.minimum.at), (most, "most", np.maximum.at)):
        at(value, index, np.concatenate([np.frombuffer(unpack_bytes(d), np.int64) for d in table.column(name).to_pylist()]))
    out = []
    for batch, mine in zip(table.column("batch").to_pylist(), np.split(index, np.cumsum([len(p) for p in parts])[:-1]), strict=True):
        shared = least[mine] < most[mine]
        if shared.any():
            out.append((batch, table.column("bucket")[0].as_py(), np.packbits(shared).tobytes(), pack_bytes(least[mine[shared]].tobytes())))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(("batch", "bucket", "bits", "first"), kinds, strict=True))})


_SPANS = "array<struct<start:long,length:long>>"
_RESULT = f"doc_id long, n_bytes long, n_chunks long, n_dup_chunks long, n_dup_bytes long, n_removed long, n_spans long, spans {_SPANS}, text_key binary"


def _answer(options: tuple[int, int, int], buckets: int, least_run: int, whole_copies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                doc_ids, sizes, texts, answers = [rows.column(i)[k].as_py() for i in range(1, 5)]
                raw, _, _ = open_batch(sizes, texts)
                start, length, doc, digests, index = _chunks(raw, sizes, options)
                first = np.full(len(digests), LAST)
                spans = {b: (x, y) for b, x, y in occupied(buckets_of(digests[:, 0], buckets))}
                for a in answers or []:
                    x, y = spans[a["bucket"]]
                    part = first[x:y]
                    part[np.unpackbits(np.frombuffer(a["bits"], np.uint8))[: y - x].astype(bool)] = np.frombuffer(unpack_bytes(a["first"]), np.int64)
                dup = first[index] < _ids(doc_ids)[doc]
                n = len(sizes)
                chunks, dups, dup_bytes = np.bincount(doc, minlength=n), np.bincount(doc[dup], minlength=n), np.bincount(doc[dup], length[dup], minlength=n).astype(np.int64)
                # runs: neighbouring duplicate chunks of one document
                d, s, z = doc[dup], start[dup], length[dup]
                head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + z[:-1])])) if len(d) else np.zeros(0, np.int64)
                total = np.add.reduceat(z, head) if len(head) else np.zeros(0, np.int64)
                goes = (total >= least_run) | (whole_copies & (dups == chunks)[d[head]])
                held: list[list[dict]] = [[] for _ in range(n)]
                for i, a, b in zip(d[head][goes].tolist(), s[head][goes].tolist(), total[goes].tolist(), strict=True):
                    held[i].append({"start": a, "length": b})
                ends = np.cumsum(sizes)
                keys = [hashlib.md5(raw[e - z : e]).digest() for e, z in zip(ends.tolist(), sizes, strict=True)]
                cells = [doc_ids, sizes, chunks, dups, dup_bytes, [sum(x["length"] for x in h) for h in held], [len(h) for h in held], held, keys]
                kinds = [pa.int64()] * 7 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["doc_id", "n_bytes", "n_chunks", "n_dup_chunks", "n_dup_bytes", "n_removed", "n_spans", "spans", "text_key"])

    return run


def _spans(docs: DataFrame, least_run: int, least: int, usual: int, most: int, whole_copies: bool, batch_bytes: int, bucket_bytes: int) -> DataFrame:
    options = (least, usual, most)
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`"))
    table = materialise(rows.mapInArrow(gather(batch_bytes), BATCHES), "batches")
    total = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(32, -(-total // bucket_bytes))
    sent = table.mapInArrow(_send_digests(options, buckets), "bucket long, batch long, digests binary, least binary, most binary")
    first = sent.groupBy("bucket").applyInArrow(_first_documents, "batch long, bucket long, bits binary, first binary")
    answers = materialise(first.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits", "first")).alias("answers")), "answers")
    return table.join(answers, "batch", "left").select("batch", "doc_ids", "sizes", "texts", "answers").mapInArrow(_answer(options, buckets, least_run, whole_copies), _RESULT)


def chunk_duplicates(
    docs: DataFrame, least_run: int = 80, least: int = 8, usual: int = 20, most: int = 512, whole_copies: bool = False, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_chunks, n_dup_chunks, n_dup_bytes, n_removed, n_spans, spans (start, length in bytes).

    n_dup_bytes counts the bytes of all duplicate chunks, n_removed those of the removed
    runs. Only repeats from a document with a smaller doc_id count; repeats inside one
    stay. Rows that share a doc_id count as one document; a null doc_id counts as the
    largest; a null text is empty and has no chunk; an empty table gives no rows; further
    columns are ignored.
    """
    return _spans(docs, least_run, least, usual, most, whole_copies, batch_bytes, bucket_bytes).drop("text_key")


def without_spans(raw: bytes, spans: list[dict]) -> bytes:
    """The bytes outside the spans (which are in order and apart)."""
    kept, last = [], 0
    for s in spans:
        kept.append(raw[last : s["start"]])
        last = s["start"] + s["length"]
    return b"".join([*kept, raw[last:]])


def cut_documents(
    docs: DataFrame, least_run: int = 80, least: int = 8, usual: int = 20, most: int = 512, whole_copies: bool = False, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text``; a character cut in two is dropped whole.

    Rows are found again by id, which may be null, and text. A null text stays null; an
    empty table stays empty; working columns avoid the names of the table's own.
    """
    i, k, gone, own_id, own_key = spare(docs, "cut_id", "cut_key", "cut_spans", "row_id", "row_key")
    cut = _spans(docs, least_run, least, usual, most, whole_copies, batch_bytes, bucket_bytes).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias(i), F.col("text_key").alias(k), F.col("spans").alias(gone)).dropDuplicates([i, k])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(batch.num_columns - 1).to_pylist()
            raws = text_bytes(batch.column(at))
            texts = [without_spans(r, s).decode("utf-8", "ignore") if s else t for r, s, t in zip(raws, spans_of, batch.column(at).to_pylist(), strict=True)]
            cols = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    keyed = docs.withColumn(own_id, F.col("`doc_id`").cast("long")).withColumn(own_key, text_key(F.col("`text`")))
    same = F.col(own_id).eqNullSafe(F.col(i)) & (F.col(own_key) == F.col(k))
    return keyed.join(cut, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone).mapInArrow(run, docs.schema)
