"""Token ids of whole texts, by a public tokenizer.

The tokenizers library spends most of its time on words it has already met.
So a text is cut where its pre-tokenizer cuts in any case, each different piece
is given to the library once, and the ids are put together with numpy.  Pieces
already met are kept per Python worker, up to a fixed number of bytes.

Where a cut is safe: before white space that follows a character that is not
white space, and between an ASCII letter and an ASCII mark.  No pattern of
either vocabulary file matches across such a place or looks back over it, and
no normaliser joins the characters beside it.

The library's own reading of added tokens such as ``<|endoftext|>`` (one id
wherever a text holds them) is had with ``added``; each is then one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm.memory import memory, only, release
from wordmine.llm.textbytes import IS_SPACE, runs, text_bytes

#: Appended to every document.
END_ID = 0
#: Bytes of pieces that a worker remembers.  The rarer pieces are, the more it pays.
REMEMBER = 32 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_MARK = _GRAPHIC & ~_LETTER
_MARK[ord("0") : ord("9") + 1] = False


def _lead(first: int, last: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[first : last + 1] = True
    return table


#: Lead bytes of characters that are never white space.
_LEAD_2 = _lead(0xC3, 0xDF)
_LEAD_3 = _lead(0xE4, 0xEF)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces start, text starts included, strictly ascending."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    solid = _GRAPHIC[data]
    solid[1:] |= _LEAD_2[data[:-1]] & (data[1:] >= 0x80)
    solid[2:] |= _LEAD_3[data[:-2]] & (data[2:] >= 0x80) & (data[1:-1] >= 0x80)
    cut = np.zeros(n, bool)
    cut[1:] = (IS_SPACE[data[1:]] & solid[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
    starts = offsets[:-1]
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


#: A space and one word of ASCII or Latin-1 letters.
_PLAIN = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class PieceEncoder:
    """Ids of texts, with a bounded memory of pieces already encoded.

    Plain words are given to the library many to a text, which it does faster
    than many texts.  Their ids are told apart by the vocabulary's own marks: an
    id that opens with a space, or one that ends a word.

    With ``added`` the added tokens of the file are found in texts, as the library
    does by default; without it they are text like any other.
    """

    LONGEST = 64
    TOGETHER = 1000

    #: Bytes of a remembered piece beside its own and its ids': object, number, tables.
    EACH = 160

    def __init__(self, path: str, remember: int = REMEMBER, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literal, self.whole = None, False
        if added:
            listed = list(self.tokenizer.get_added_tokens_decoder().values())
            longest = sorted((t.content.encode() for t in listed), key=len, reverse=True)
            self.literal = re.compile(b"|".join(map(re.escape, longest))) if longest else None
            # Such tokens depend on what is beside them, so their texts stay whole.
            self.whole = any(
                t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s", t.content)
                for t in listed
            )
        else:
            self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.remember = remember
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens, self.closes = np.zeros((2, self.vocabulary), bool)
        for name, i in names.items():
            self.opens[i] = name[0] == "\u0120"
            self.closes[i] = name.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.full(1, END_ID, np.uint32)  # slot 0: the end of a document
        self.starts = np.zeros(1, np.int64)
        self.lengths = np.ones(1, np.int64)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for every piece."""
        ids = [
            e.ids
            for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        ]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32), lengths

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        groups = [
            "".join(pieces[i : i + self.TOGETHER])
            for i in range(0, len(pieces), self.TOGETHER)
        ]
        ids, _ = self._each(groups)
        if self.closes.any():
            ends = np.flatnonzero(self.closes[ids]) + 1
        else:
            ends = np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self._each(pieces)
        return ids, np.diff(ends, prepend=0)

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        if self.held > self.remember:
            self._forget()
        known = self.known
        slots = np.fromiter((known.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(slots < 0).tolist()
        if not new:
            return slots
        plain = [i for i in new if _PLAIN.fullmatch(pieces[i])]
        taken = set(plain)
        order = plain + [i for i in new if i not in taken]
        text = [pieces[i].decode("utf-8", "replace") for i in order]
        ids_plain, plain_lengths = self._together(text[: len(plain)])
        ids_other, other_lengths = self._each(text[len(plain) :])
        lengths = np.concatenate((plain_lengths, other_lengths))
        first = len(self.ids) + np.cumsum(lengths) - lengths
        slot = len(self.starts)
        slots[order] = np.arange(slot, slot + len(order))
        known.update(
            (pieces[i], k)
            for k, i in enumerate(order, slot)
            if len(pieces[i]) <= self.LONGEST
        )
        self.held += self.EACH * len(order) + 4 * int(lengths.sum())
        self.held += sum(len(pieces[i]) for i in order if len(pieces[i]) <= self.LONGEST)
        self.ids = np.concatenate((self.ids, ids_plain, ids_other))
        self.starts = np.concatenate((self.starts, first))
        self.lengths = np.concatenate((self.lengths, lengths))
        return slots

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces start; an added token is a piece of its own."""
        if self.whole:
            starts = np.unique(offsets[:-1])
            return starts[starts < len(data)]
        starts = cut_points(data, offsets)
        if self.literal is None:
            return starts
        raw, spans, at = data.tobytes(), [], 0
        while m := self.literal.search(raw, at):
            at = m.end()
            if np.searchsorted(offsets, m.start(), "right") < np.searchsorted(offsets, at - 1, "right"):
                at = m.start() + 1  # from one text into the next
            else:
                spans.append(m.span())
        if not spans:
            return starts
        opens, ends = np.array(spans, np.int64).T
        k = np.searchsorted(opens, starts, "right") - 1
        inside = (k >= 0) & (starts < ends[k])
        starts = np.union1d(starts[~inside], np.concatenate((opens, ends)))
        return starts[starts < len(data)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text closed by END_ID, and their n + 1 offsets."""
        data, offsets = text_bytes(texts)
        starts = self._cuts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(
            pa.large_binary(),
            len(starts),
            [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))],
        ).dictionary_encode()
        slots = self._slots(pieces.dictionary.to_pylist())
        order = slots[np.asarray(pieces.indices)] if len(starts) else slots
        order = np.insert(order, np.searchsorted(starts, offsets[1:]), 0)
        lengths = self.lengths[order]
        total = np.cumsum(lengths)
        shift = self.starts[order] - (total - lengths)
        ids = self.ids[np.repeat(shift, lengths) + np.arange(total[-1] if len(total) else 0)]
        ends = total[np.flatnonzero(order == 0)] if len(order) else total
        return ids, np.concatenate(([0], ends))


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = memory()


def encoder(path: str, added: bool = False, remember: int = REMEMBER) -> PieceEncoder:
    """One per Python worker and vocabulary, so that what it remembers lasts."""
    only(_ENCODERS)
    key = path, added, remember
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, remember, added)
        release()  # reading the file leaves much behind
    return _ENCODERS[key]


def encode_batches(
    batches: Iterator[pa.RecordBatch], path: str, added: bool = False, remember: int = REMEMBER
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids and offsets of their column ``text``."""
    encode = encoder(path, added, remember).encode
    for batch in batches:
        for start, stop in runs(batch.column("text"), remember // 16):
            part = batch.slice(start, stop - start)
            yield part, *encode(part.column("text"))


def id_type(path: str, added: bool = False, remember: int = REMEMBER) -> np.dtype:
    """Two bytes for an id where the vocabulary allows it, else four."""
    return np.dtype("<u2") if encoder(path, added, remember).vocabulary <= 1 << 16 else np.dtype("<u4")


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary per text out of ``values`` laid end to end."""
    bounds = np.asarray(offsets, np.int64) * values.itemsize
    array = pa.Array.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values))],
    )
    return array.cast(pa.binary())


def token_ids(docs: DataFrame, path: str, added: bool = False, remember: int = REMEMBER) -> DataFrame:
    """``doc_id, ids``: little-endian ids of every whole text, END_ID last.

    A null text counts as empty, so its ids are END_ID alone.  ``added`` reads
    added tokens in the texts as the library does by default.  A worker remembers
    pieces up to ``remember`` bytes.
    """

    def run(batches):
        kind = id_type(path, added, remember)
        for part, ids, offsets in encode_batches(batches, path, added, remember):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), binaries(ids.astype(kind), offsets)],
                names=["doc_id", "ids"],
            )

    only = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return only.mapInArrow(run, "doc_id long, ids binary")
