"""Token ids of whole texts with the ``tokenizers`` library, memoised by word.

Byte-level BPE never merges across the places where its pattern cuts. A single blank or
line feed between non-blank characters is always such a place, and so is that between a
Latin-1 letter and an ASCII mark that isn't an apostrophe. So a batch of texts is cut there into
units (a word with the blank before it, the marks behind it, or a line feed), whose
distinct ones are found by Arrow's dictionary encoding; only those meet the bounded memo
and the library, and Arrow joins their ids again. A text with other white space is
encoded whole by the library. Both give the library's ids.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa

from lectern.llm.shared import forgotten

_SIMPLE = re.compile(r"([^\W\d_]+)([^\w\s'<]*)\Z")
#: The memo's younger half becomes its older one at so many entries, and longer units aren't kept (both bound a
#: worker's memory).
MEMO_ENTRIES = 250_000
MEMO_UNIT_BYTES = 64
#: Texts cut into units together.
PIECE_BYTES = 8 << 20


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(256 + n) for n, b in enumerate(others)}


#: The same as code points; a line feed stays, as it parts the units that are looked up together.
_LETTERS = np.array([10 if b == 10 else ord(c) for b, c in sorted(_byte_alphabet().items())], "<u4")
_ASCII_LETTERS = np.isin(np.arange(256), list(string.ascii_letters.encode()))
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is 0xC3.
_LATIN_LETTERS = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


class DocumentTokenizer:
    """``encode(text)``: ids as little-endian unsigned 32-bit bytes, without the end id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._by_unit = "ByteLevel" in str(self._library.pre_tokenizer) and self._library.normalizer is None
        self._young: dict[bytes, bytes | None] = {}
        self._old: dict[bytes, bytes | None] = {}
        self._feed = self._ids("\n")
        # a cut before a mark of an added token could part that token
        added = "".join(t.content for t in self._library.get_added_tokens_decoder().values())
        self._marks = np.isin(np.arange(256), [ord(c) for c in string.punctuation if c not in "'" + added])

    def _ids(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _bytes(self, raws: list[bytes]) -> list[bytes]:
        """Ids of units of the pattern, their blanks included."""
        letters = _LETTERS[np.frombuffer(b"\n".join(raws), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        ids: list[int] = []
        ends = [0]
        for unit in letters if raws else []:
            ids += [t.id for t in self._model.tokenize(unit)]
            ends.append(4 * len(ids))
        every = np.array(ids, "<u4").tobytes()
        return [every[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _unit(self, text: str) -> bytes | tuple[bytes, bytes] | None:
        """Ids of a unit that isn't a word, or its letters and marks; None if white space within it could join what stands around it."""
        if text == "\n":
            return self._feed
        word = text[1:] if text[0] == " " else text
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        m = _SIMPLE.match(word)
        if m and m[1].isalpha():
            # a run of letters and one of marks: the pattern cuts between them, and nowhere else
            return text[: len(text) - len(m[2])].encode(), m[2].encode()
        return self._ids(text)

    def _units(self, distinct: list[bytes]) -> list[bytes | None]:
        """Ids of each unit; None as _unit() says."""
        known, before = self._young.get, self._old.get
        out = [known(raw, self) for raw in distinct]
        words, missed = [], [n for n, ids in enumerate(out) if ids is self]
        for n in missed:
            raw = distinct[n]
            out[n] = before(raw, self)
            if out[n] is self:
                text = raw.decode()
                if (text[1:] if text[0] == " " else text).isalpha():
                    words.append(n)
                else:
                    out[n] = self._unit(text)
        for n, ids in zip(words, self._bytes([distinct[n] for n in words]), strict=True):
            out[n] = ids
        parted = []
        for n in missed:
            if isinstance(out[n], tuple):
                parted.append(n)
            elif len(distinct[n]) <= MEMO_UNIT_BYTES:
                self._young[distinct[n]] = out[n]
        if parted:
            parts = list(dict.fromkeys(p for n in parted for p in out[n]))
            ids_of = dict(zip(parts, self._units(parts), strict=True))
            for n in parted:
                out[n] = b"".join(ids_of[p] for p in out[n])
                if len(distinct[n]) <= MEMO_UNIT_BYTES:
                    self._young[distinct[n]] = out[n]
        return out

    def forget(self) -> None:
        """Empty the memo."""
        self._young, self._old = {}, {}

    def encode_all(self, raws: list[bytes], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each, as one array, and the place in it where each text's ids end."""
        parts, ends, held, size, at = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], [], 0, 0
        for n, raw in enumerate(raws):
            held.append(raw)
            size += len(raw)
            if size >= PIECE_BYTES or n == len(raws) - 1:
                ids, stops = self._piece(held, end)
                parts.append(ids)
                ends.append(stops + at)
                held, size, at = [], 0, at + len(ids)
        return np.concatenate(parts), np.concatenate(ends)

    def _piece(self, raws: list[bytes], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in raws], np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        stop = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        if not self._by_unit:
            return self._joined([self._ids(r.decode()) + end for r in raws])
        blank, feed = data == 32, data == 10
        cut = blank | feed
        cut[1:] |= feed[:-1] | (self._marks[data[1:]] & _ASCII_LETTERS[data[:-1]])
        cut[2:] |= self._marks[data[2:]] & _LATIN_LETTERS[data[1:-1]] & (data[:-2] == 0xC3)
        cut[(stop - sizes)[some]] = True
        start = np.flatnonzero(cut)
        first, last = np.searchsorted(start, stop - sizes), np.searchsorted(start, stop)  # units of each text
        units = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        _, ends, letters = coded.dictionary.buffers()
        ends, letters = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1].tolist(), letters.to_pybytes() if letters else b""
        ids = self._units([letters[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        if len(self._young) >= MEMO_ENTRIES:
            self._old, self._young = self._young, {}
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a text is encoded whole if a unit is odd by itself, or a blank or line feed isn't between words
        gap, line = blank[start], feed[start]
        odd = np.array([i is None for i in ids], bool)[index] if len(index) else np.zeros(0, bool)
        begins, closes = np.zeros(len(start), bool), np.zeros(len(start), bool)
        begins[first[some]], closes[last[some] - 1] = True, True
        odd |= (begins & (gap | line)) | (closes & line)
        odd[:-1] |= line[:-1] & (gap | line)[1:]
        upto = np.concatenate([[0], np.cumsum(odd)])
        values = [b"" if i is None else i for i in ids]
        values += [end, b""]
        for n in np.flatnonzero(upto[last] > upto[first]).tolist():
            index[first[n] : last[n]] = len(ids) + 1
            index[first[n]] = len(values)
            values.append(self._ids(raws[n].decode()))
        index = np.insert(index, last, len(ids))
        taken = pa.array(values, pa.binary()).take(pa.array(index))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(index) + 1]
        out = np.frombuffer(taken.buffers()[2] or b"", "<u4")[: int(offsets[-1]) // 4]
        return out, offsets[last + np.arange(1, len(raws) + 1)].astype(np.int64) // 4

    @staticmethod
    def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), "<u4"), np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([(text or "").encode()])[0].tobytes()


_loaded: dict[str, DocumentTokenizer] = {}


def _forget() -> None:
    for t in _loaded.values():
        t.forget()


forgotten.append(_forget)


def tokenizer(path: str) -> DocumentTokenizer:
    """One per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = DocumentTokenizer(path)
    return _loaded[path]
