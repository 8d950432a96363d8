"""Exact, cached byte-pair encoding with the ``tokenizers`` library.

A text is cut at every single space that stands between two visible characters. The vocabulary's
split pattern never joins characters across such a place, so the pieces' ids, joined, are the ids of
the text. Columns are cut and reduced to their different pieces by Arrow kernels; a piece's ids are kept
in a bounded per-process cache, and only unseen words reach the library.
Texts with other runs of white space (double spaces, a space beside a line break, Unicode spaces) or
with an added token such as <|endoftext|> are encoded whole by the library. Null counts as empty.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import alone

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space that is not followed by a character which is surely visible, or a null character: such texts are not cut.
_UNSAFE = r" ([^!-~¡-ᙿ‰-⁞⁰-⿿、-퟿豈-﻾]|$)|\x00"
#: ASCII marks that the split pattern keeps together after a word; an apostrophe may start a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are cut at once.
SLICE_BYTES = 8 << 20
_INSTANCES: dict[tuple[str, int], "CachedBpe"] = {}


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class CachedBpe:
    """Encodes texts to little-endian ids; ``max_pieces`` bounds the cache (about 200 bytes an entry)."""

    def __init__(self, path: str, max_pieces: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([_UNSAFE, *map(re.escape, added)])
        self.max_pieces = max_pieces
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        #: By piece: the ids of a space and the piece; ``bare`` has the ids of words without a space before them.
        self.pieces: dict[str, bytes] = {"": b""}
        self.bare: dict[str, bytes] = {}
        self.model = self.tokenizer.model  # takes words that are cut and spelled in the byte alphabet
        self.model._resize_cache(0)
        self.spelling = _byte_alphabet()

    def _packed(self, ids: list[int]) -> bytes:
        out = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the split pattern leaves whole."""
        spelled = "\n".join(words).encode().decode("latin-1").translate(self.spelling).split("\u010a") if words else []
        run, packed = self.model.tokenize, self._packed
        return [packed([t.id for t in run(w)]) for w in spelled]

    @staticmethod
    def _cut(piece: str) -> list[str] | None:
        """The split pattern's words of a piece with line breaks; None if it isn't lines of a word each, with at most one run of marks after it."""
        out: list[str] = []
        for k, part in enumerate(piece.split("\n")):
            base = part.rstrip(_MARKS)
            if not base.isalpha():
                return None
            if k:
                out.append("\n")
            out.append(base)
            if len(base) < len(part):
                out.append(part[len(base) :])
        return out

    def _learn_bare(self, words: set[str]) -> None:
        new = list(words.difference(self.bare))
        marks = [w for w in new if w == "\n"]  # line breaks separate words there
        plain = [w for w in new if w != "\n"]
        self.bare.update(zip(plain, self._words(plain), strict=True))
        self.bare.update(zip(marks, self._library(marks), strict=True))

    def _learn(self, missing: list[str]) -> None:
        known, bare = self.pieces, self.bare
        spaced, loose, ended, cut, odd = set(), {".", ","}, [], [], []
        for p in missing:
            if p.isalpha():
                spaced.add(p)
            elif p[-1] in ".," and p[:-1].isalpha():  # most of the others
                ended.append(p)
            elif ws := self._cut(p):
                cut.append((p, ws))
                loose.update(ws[1:])
            else:
                odd.append(p)
        spaced.update([p[:-1] for p in ended])
        spaced.update([ws[0] for _, ws in cut])
        new = list(spaced.difference(known))
        known.update(zip(new, self._words([" " + w for w in new]), strict=True))
        self._learn_bare(loose)
        for p in ended:
            known[p] = known[p[:-1]] + bare[p[-1]]
        for p, ws in cut:
            known[p] = known[ws[0]] + b"".join([bare[w] for w in ws[1:]])
        if odd:
            known.update(zip(odd, self._library([" " + p for p in odd]), strict=True))

    def _forget(self, recent: list[str]) -> None:
        """Keeps the pieces that came first (frequent ones come early) and those of the last slice."""
        old = dict(islice(self.pieces.items(), self.max_pieces // 3))
        self.pieces = old | {p: self.pieces[p] for p in recent}
        self.bare.clear()

    def _starts(self, texts: list[str], whole: np.ndarray, column: pa.Array) -> list[bytes]:
        """Ids of what stands before a text's first space, or of the whole of texts that are not cut."""
        cuts = [self._cut(t) if t else [] for t in texts]
        self._learn_bare({w for ws in cuts if ws for w in ws})
        out = [b"".join([self.bare[w] for w in ws]) if ws else b"" for ws in cuts]
        left = [k for k, ws in enumerate(cuts) if ws is None]
        for k, ids in zip(left, self._library([texts[k] for k in left]), strict=True):
            out[k] = ids
        rows = np.flatnonzero(whole)
        if len(rows):
            for k, ids in zip(rows.tolist(), self._library(column.take(pa.array(rows)).to_pylist()), strict=True):
                out[k] = ids
        return out

    def _slice(self, column: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(column)
        mask = pc.match_substring_regex(column, self.unsafe)
        lists = pc.split_pattern(pc.if_else(mask, "", column), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.pieces.get, unique))
        gaps = [k for k, v in enumerate(got) if v is None]
        if gaps:
            self._learn([unique[k] for k in gaps])
            for k in gaps:
                got[k] = self.pieces[unique[k]]
        first = coded.dictionary.take(coded.indices.take(pa.array(bounds[:-1]))).to_pylist()
        values = pa.array([*got, *self._starts(first, mask.to_numpy(zero_copy_only=False), column), end], pa.large_binary())
        index[bounds[:-1]] = len(unique) + np.arange(n)
        index = np.insert(index, bounds[1:], len(values) - 1)
        ids = values.take(pa.array(index))
        places = np.frombuffer(ids.buffers()[1], np.int64)[: len(index) + 1][bounds + np.arange(n + 1)] // self.dtype.itemsize
        data = np.frombuffer(ids.buffers()[2], self.dtype, places[-1]) if places[-1] else np.empty(0, self.dtype)
        if len(self.pieces) > self.max_pieces:
            self._forget(unique)
        return data, places

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of the column: (first row, ids of its rows joined, their bounds); ``end_id`` is put after each row."""
        column = pc.fill_null(column.cast(pa.string()), "")
        end = b"" if end_id is None else self._packed([end_id])
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at, collecting = 0, gc.isenabled()
        while at < len(column):
            before = int(sizes[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            gc.disable()  # many small objects and no cycles
            try:
                data, places = self._slice(column.slice(at, stop - at), end)
            finally:
                if collecting:
                    gc.enable()
            yield at, data, places
            at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        out: list[bytes] = []
        for _, data, places in self.encode_column(pa.array(texts, pa.string())):
            out += [data[a:b].tobytes() for a, b in zip(places.tolist(), places[1:].tolist())]
        return out


def binary_rows(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """A binary array whose rows are the given ranges of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def cached_bpe(path: str, max_pieces: int = 700_000) -> CachedBpe:
    """This process's encoder for a vocabulary file; Python workers are reused, so the cache outlives a task, until another operator's task comes."""
    alone("bpe", _INSTANCES.clear)
    key = (path, max_pieces)
    if key not in _INSTANCES:
        _INSTANCES[key] = CachedBpe(path, max_pieces)
    return _INSTANCES[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
