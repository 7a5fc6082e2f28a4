"""Alignment of two tokenizers' cuts of the same text, and counts of the token pairs that overlap.

A byte-level tokenizer (A) and a piece tokenizer with a word mark (B) both cut the bytes of a blank and the text. Tokens
of A and B whose byte ranges overlap are linked; union-find over this bipartite graph gives its components, the
smallest groups that cover the same bytes. All units of a batch are linked and united together, as arrays.

Neither tokenizer joins anything across the blank or line feed between two words. So texts are cut there into units,
and only the distinct units of a batch meet the libraries and a bounded memo; a text with other white space at such a
place is one unit, and isn't remembered. A unit knows its numbers of tokens, its groups as text and its links.

Documents are gathered into batches. A batch is written once as a row: its documents' numbers and digests, its distinct
links with the number of its documents that hold them, and each document as a sequence of units. Links are counted over
all batches (one row for each link and batch, combined before the shuffle), each first token's highest count is found,
and both go back to the batches that asked. So what is exchanged is in proportion to the batches' distinct links, not
to the links' occurrences, and no task holds more than a batch and its answers.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import ensure_columns, forgotten, materialise, pack_bytes, slices, text_bytes, tidy, unpack_bytes
from lectern.llm.tokens import _byte_alphabet

#: The sign that B has for a blank.
MARK = "▁"
#: Units that the memo holds, and the longest one's bytes.
MEMO_UNITS = 100_000
MEMO_UNIT_BYTES = 48
#: Bytes of text in a batch, and units that the libraries get at once (their results are large).
BATCH_BYTES = 4 << 20
UNITS_AT_ONCE = 4096


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over edges (a, b) of n nodes, all at once: the least node of each node's component."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:  # halve all paths until each node names its root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens (of A, of B) whose byte ranges overlap, in order: both ends cut the bytes, and each piece is a link."""
    ends = distinct(np.concatenate([ends_a, ends_b]))
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """``units(raws)``: what each distinct unit's alignment is; see align()."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: bytes([b]) for b, c in _byte_alphabet().items()}
        words = {i: w for w, i in self._a.get_vocab().items()}
        self._bytes_a = [b"".join(letters.get(c, c.encode()) for c in words.get(i, "")) for i in range(max(words) + 1)]
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # a token's id as groups write it, inside its side and as its last one
        self._names = pa.array([f"{i}{sign}" for n, signs in ((len(self._bytes_a), ",|"), (len(pieces), ",;")) for i in range(n) for sign in signs], pa.binary())
        self._size_a = np.array([len(x) for x in self._bytes_a], np.int64)
        self._size_b = np.array([len(x) for x in self._bytes_b], np.int64)
        self._mark_feed = self._b.encode("\n")
        joins = any(MARK in p.lstrip(MARK) or (len(p) > 1 and ("\n" in p or " " in p)) for i, p in enumerate(pieces) if not self._b.is_control(i))
        self._by_unit = "ByteLevel" in str(self._a.pre_tokenizer) and self._a.normalizer is None and not joins and len(self._mark_feed) == 2
        self._memo: dict[bytes, tuple | None] = {}

    def forget(self) -> None:
        self._memo = {}

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        """B's ids of units: it adds the blank of those that have one; the others stand after a line feed."""
        out = self._b.encode([t[1:] if t[0] == " " else t if t == "\n" else "\n" + t for t in texts], num_threads=1)
        return [ids if t[0] == " " else ids[1:] if t == "\n" else ids[2:] for t, ids in zip(texts, out, strict=True)]

    def align(self, raws: list[bytes]) -> list[tuple | None]:
        """For each unit (n_a, n_b, groups, links): groups as text with a last ';', links as 64-bit numbers (A's id, B's id).

        None where the tokens of one of the two, joined, aren't the unit's bytes.
        """
        if len(raws) > UNITS_AT_ONCE or (len(raws) > 1 and sum(map(len, raws)) > 1 << 20):
            step = max(1, min(UNITS_AT_ONCE, len(raws) // 2))
            return [v for at in range(0, len(raws), step) for v in self.align(raws[at : at + step])]
        if not raws:
            return []
        texts = [r.decode() for r in raws]
        all_a = [e.ids for e in self._a.encode_batch_fast(texts, add_special_tokens=False)]
        all_b = self._encode_b(texts)
        fine = [
            k for k, (r, a, b) in enumerate(zip(raws, all_a, all_b, strict=True))
            if b"".join(map(self._bytes_a.__getitem__, a)) == r and b"".join(map(self._bytes_b.__getitem__, b)) == r
        ]
        out: list[tuple | None] = [None] * len(raws)
        if not fine:
            return out
        a = np.array([i for k in fine for i in all_a[k]], np.int64)
        b = np.array([i for k in fine for i in all_b[k]], np.int64)
        # units stand side by side: both have an end where one ends, so no link crosses that
        at_a, at_b = linked(np.cumsum(self._size_a[a]), np.cumsum(self._size_b[b]))
        root = components(len(a) + len(b), at_a, at_b + len(a))
        links = (a[at_a] << 32 | b[at_b]).astype("<i8")
        # members follow each other, so that a group begins where the root changes
        group_a, group_b = (np.cumsum(np.append(False, r[1:] != r[:-1])) for r in (root[: len(a)], root[len(a) :]))
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        texts = self._names.take(pa.array(np.concatenate([2 * a + last_a, 2 * (b + len(self._bytes_a)) + last_b])[order]))
        offsets, text = np.frombuffer(texts.buffers()[1], np.int32), texts.buffers()[2].to_pybytes()
        n_a, n_b = np.array([len(all_a[k]) for k in fine]), np.array([len(all_b[k]) for k in fine])
        end_a, end_both = np.cumsum(n_a), np.cumsum(n_a + n_b)
        upto_group = (group_a[end_a - 1] + 1).tolist()
        upto_link = np.searchsorted(at_a, end_a).tolist()
        upto_text = offsets[end_both].tolist()
        g = f = t = 0
        for k, x, y, h, i, j in zip(fine, n_a.tolist(), n_b.tolist(), upto_group, upto_link, upto_text, strict=True):
            out[k] = x, y, h - g, text[t:j], links[f:i].tobytes()
            g, f, t = h, i, j
        return out

    def _odd(self, raw: bytes) -> bool:
        """Whether white space at a unit's ends could join with what stands around it."""
        text = raw.decode()
        word = text[1:] if text[0] == " " else text
        return text != "\n" and (not word or word[0].isspace() or word[-1].isspace())

    def units(self, raws: list[bytes]) -> list[tuple | None]:
        """align() through the memo."""
        new = [r for r in raws if r not in self._memo]
        found = dict(zip(new, self.align(new), strict=True))
        out = [found[r] if r in found else self._memo[r] for r in raws]
        short = [(r, v) for r, v in found.items() if len(r) <= MEMO_UNIT_BYTES][:MEMO_UNITS]
        if len(self._memo) + len(short) > MEMO_UNITS:
            self._memo = {}
        self._memo.update(short)
        return out

    def batch(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple | None]]:
        """Texts as sequences of units: numbers of units, where each text's sequence ends, and the units.

        A text without bytes has no units; one that has a unit that isn't right has number -1 alone.
        """
        sizes = np.array([len(r) + 1 if r else 0 for r in raws], np.int64)
        data = np.frombuffer(b"".join(b" " + r for r in raws if r), np.uint8)
        stop = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        blank, feed = data == 32, data == 10
        cut = blank | feed
        cut[1:] |= feed[:-1]
        cut[(stop - sizes)[some]] = True
        start = np.flatnonzero(cut)
        first, last = np.searchsorted(start, stop - sizes), np.searchsorted(start, stop)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        every = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        strange = np.array([self._odd(r) for r in every], bool)[index] if len(index) else np.zeros(0, bool)
        gap, line = blank[start], feed[start]
        closes = np.zeros(len(start), bool)
        closes[last[some] - 1] = True
        strange |= closes & line
        strange[:-1] |= line[:-1] & (gap | line)[1:]
        if not self._by_unit:
            strange[:] = True
        upto = np.concatenate([[0], np.cumsum(strange)])
        apart = upto[last] > upto[first]
        used = distinct(index[~np.repeat(apart, last - first)])
        values: list[tuple | None] = [None] * len(every)
        for k, v in zip(used.tolist(), self.units([every[k] for k in used.tolist()]), strict=True):
            values[k] = v
        odd = np.flatnonzero(apart).tolist()
        values += self.align([b" " + raws[n] for n in odd])
        take = np.ones(len(start), bool)
        for k, n in enumerate(odd):
            take[first[n] : last[n]] = False
            take[first[n]] = True
            index[first[n]] = len(every) + k
        bad = np.array([v is None for v in values], bool)
        wrong = np.concatenate([[0], np.cumsum(bad[index] & take)])
        for n in np.flatnonzero(wrong[last] > wrong[first]).tolist():
            take[first[n] : last[n]] = False
            take[first[n]] = True
            index[first[n]] = -1
        kept = np.concatenate([[0], np.cumsum(take)])
        return index[take], kept[last], values


_loaded: dict[tuple[str, str], Aligner] = {}


def _forget() -> None:
    for a in _loaded.values():
        a.forget()


forgotten.append(_forget)


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of vocabulary files."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _numbers(data: np.ndarray, kind: str) -> bytes:
    return pack_bytes(data.astype(kind).tobytes())


def _read(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(unpack_bytes(raw), kind).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    ids: list = []
    raws: list[bytes] = []
    size = 0
    for whole in batches:
        for batch in slices(whole, most):
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if ids and size + len(raw) > most:
                    yield ids, raws
                    ids, raws, size = [], [], 0
                ids.append(doc_id)
                raws.append(raw)
                size += len(raw)
    if ids:
        yield ids, raws


_ALIGNED = "batch long, doc_ids array<long>, numbers array<long>, digests array<string>, links binary, held binary, places binary, place_ends binary, units binary, ends binary"
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 6]


def _align(path_a: str, path_b: str, most: int):
    """(doc_id, text) -> one row of _ALIGNED for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for ids, raws in _gathered(batches, most):
            index, ends, values = aligner(path_a, path_b).batch(raws)
            values.append((0, 0, 0, b"", b""))  # also what number -1 stands for
            values = [v or values[-1] for v in values]
            index = np.where(index < 0, len(values) - 1, index)
            texts = pa.array([v[3] for v in values], pa.large_binary()).take(pa.array(index))
            stops = np.append(0, np.frombuffer(texts.buffers()[1], np.int64)[1 : len(index) + 1]) if len(index) else np.zeros(1, np.int64)
            joined = memoryview(texts.buffers()[2] or b"")
            at = np.append(0, ends)
            digests = [hashlib.sha256(joined[stops[p] : stops[q] - 1]).hexdigest() if stops[q] > stops[p] else "" for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            # distinct links of the batch, and each unit's links as places among them
            links = np.frombuffer(b"".join(v[4] for v in values), "<i8")
            known = distinct(links)
            places = np.searchsorted(known, links)
            counts = np.array([[*v[:3], len(v[4]) // 8] for v in values], np.int64)
            place_ends = np.cumsum(counts[:, 3])
            totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[index], axis=0)])
            numbers = (totals[at[1:]] - totals[at[:-1]]).reshape(-1)
            # in how many of the batch's documents a link is: of a document's equal units one counts
            owner = np.repeat(np.arange(len(ids)), np.diff(at))
            pairs = distinct(owner * len(values) + index)
            unit, owner = pairs % len(values), pairs // len(values)
            many = counts[unit, 3]
            begin = np.repeat(place_ends[unit] - many - (np.cumsum(many) - many), many)
            each = places[begin + np.arange(int(many.sum()))] if len(many) else np.zeros(0, np.int64)
            found = distinct(np.repeat(owner, many) * max(1, len(known)) + each) % max(1, len(known))
            held = np.bincount(found, minlength=len(known))
            cells = [number, ids, numbers, digests, _numbers(known, "<i8"), _numbers(held, "<i4"), _numbers(places, "<i4"), _numbers(place_ends, "<i4"), _numbers(index, "<i4"), _numbers(ends, "<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, _KINDS, strict=True)], names=[c.split()[0] for c in _ALIGNED.split(", ")])
            number += 1

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, links, held) -> (batch, link, n) of each link that a document of the batch holds."""
    for batch in batches:
        for i in range(batch.num_rows):
            links, held = _read(batch.column(1)[i].as_py(), "<i8"), _read(batch.column(2)[i].as_py(), "<i4")
            some = held > 0
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py()), pa.int64()), pa.array(links[some]), pa.array(held[some])], names=["batch", "link", "n"])


_OUT = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]


def _answered(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """One batch's row and the answers (link, n, best) it got -> its documents' rows."""
    row = {c: rows.column(c)[0].as_py() for c in rows.column_names}
    link = np.asarray(answers.column("link"))
    order = np.argsort(link)
    n, best = (np.asarray(answers.column(c))[order].astype(np.int64) for c in ("n", "best"))
    link = link[order]
    asked = _read(row["links"], "<i8")
    at = np.minimum(np.searchsorted(link, asked), max(0, len(link) - 1))  # links of units that no document has get any answer
    places, stops = _read(row["places"], "<i4"), np.append(0, _read(row["place_ends"], "<i4"))
    ends = np.append(0, _read(row["ends"], "<i4"))
    units = _read(row["units"], "<i4")
    sums = []
    for value in (best, n):
        upto = np.append(0, np.cumsum(value[at][places])) if len(link) else np.zeros(len(places) + 1, np.int64)
        of_unit = upto[stops[1:]] - upto[stops[:-1]]
        along = np.append(0, np.cumsum(of_unit[units]))
        sums.append(along[ends[1:]] - along[ends[:-1]])
    numbers = np.array(row["numbers"], np.int64).reshape(-1, 4)
    cells = [row["doc_ids"], *numbers.T, *sums, row["digests"]]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(_OUT, cells, strict=True)})


def aligned_batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    rows = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialise(rows.mapInArrow(tidy(_align(path_a, path_b, BATCH_BYTES)), _ALIGNED), "aligned")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents the two ids are linked, and whether that is a's highest."""
    asked = aligned.select("batch", "links", "held").mapInArrow(_asked, "batch long, link long, n long")
    counts = asked.groupBy("link").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("link", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # an id of A is linked with as many ids as B has at most
    return counts.join(most, "a").select("a", F.col("link").bitwiseAND(0xFFFFFFFF).alias("b"), "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose joined tokens differ from a blank and the text (white space or signs that B
    writes in another way), have no tokens: zeros, and '' as digest. Every row counts as a document, repeated ones and
    such without an id included. An empty table gives no rows; further columns are ignored.
    """
    aligned = aligned_batches(docs, path_a, path_b)
    counts = materialise(link_counts(aligned).select((F.shiftleft("a", 32) + F.col("b")).alias("link"), "n", F.col("best").cast("int").alias("best")), "link_counts")
    asked = aligned.select("batch", "links", "held").mapInArrow(_asked, "batch long, link long, n long").select("batch", "link")
    answers = asked.join(counts, "link")
    return aligned.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_answered, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _texts(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in _gathered(batches, BATCH_BYTES):
            index, ends, values = aligner(path_a, path_b).batch(raws)
            at = [0, *ends.tolist()]
            texts = [b"".join(values[k][3] for k in index[p:q].tolist() if k >= 0)[:-1].decode() for p, q in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "groups"])

    return run


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per input row: doc_id, groups (``a1,a2|b1;a3|b2,b3``, ids of A and B in order; empty without tokens)."""
    rows = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidy(_texts(path_a, path_b)), "doc_id long, groups string")
