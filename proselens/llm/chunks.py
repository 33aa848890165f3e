"""Encode texts chunk by chunk with a memory of chunks seen, where chunks are units that the tokenizer never joins.

Texts, chunks and ids stay in Arrow and numpy arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks and ids that one Python worker remembers. The memory only saves work; results don't depend on it.
REMEMBERED = 32 << 20

#: Ids of several strings: all of them in a row, and how many each string has.
Ids = tuple[np.ndarray, np.ndarray]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _of_lists(lists: list) -> Ids:
    return joined([np.array(x, np.int32) for x in lists]), np.fromiter(map(len, lists), np.int64, len(lists))


class ChunkEncoder:
    """Encodes whole texts.

    ``unsafe``: a pattern; after a plain split at spaces, a chunk that it finds touches a space where the text must not be cut;
    ``cut(text)``: the cut for texts that have such chunks, as (leading chunk, later chunks without their space);
    ``encode(chunks, leading)``: the ids of an array of chunks; ``leading`` chunks begin a text.
    """

    def __init__(self, unsafe: str, cut: Callable[[str], list[str]], encode: Callable[[pa.Array, bool], Ids], remembered: int = REMEMBERED):
        self.unsafe, self.cut, self.encode, self.remembered = unsafe, cut, encode, remembered
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def __call__(self, texts: pa.Array) -> Ids:
        """Ids of the texts (an array of strings without nulls)."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lists = pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        chunks, at, bounds = coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        at, bounds = at[bounds[0] : bounds[-1]], bounds - bounds[0]
        place = pc.index_in(chunks, value_set=self.known)
        lacking = place.is_null()
        odd = pc.and_(lacking, pc.match_substring_regex(chunks, self.unsafe)) if self.unsafe else None
        if pc.any(odd).as_py():
            bad = np.add.reduceat(odd.to_numpy(zero_copy_only=False)[at], bounds[:-1]) > 0
            return self._some_cut(texts, bad)
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        place[lacking.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(pc.sum(lacking).as_py() or 0)
        self._learn(chunks.filter(lacking))
        # the first chunk of each text is encoded as such; its place is after those of the others
        heads, head_sizes = self.encode(lists.values.take(pa.array(bounds[:-1] + lists.offsets[0].as_py())), True)
        at = place[at]
        at[bounds[:-1]] = len(self.sizes) + np.arange(len(texts))
        out = _gather(np.concatenate((self.ids, heads)), np.concatenate((self.sizes, head_sizes)), at)
        counts = np.concatenate((self.sizes, head_sizes))[at]
        ends = np.concatenate(([0], np.cumsum(counts)))[bounds]
        if self.known.nbytes + self.ids.nbytes + self.sizes.nbytes > self.remembered:
            self._forget()
        return out, np.diff(ends)

    def _learn(self, chunks: pa.Array) -> None:
        if len(chunks):
            ids, sizes = self.encode(chunks, False)
            self.known = pa.concat_arrays([self.known, chunks])
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))

    def _some_cut(self, texts: pa.Array, bad: np.ndarray) -> Ids:
        """The texts with odd chunks are cut with care, one by one; the others as ever."""
        ids, sizes = self(texts.filter(pa.array(~bad)))
        careful = [self.cut(t) for t in texts.filter(pa.array(bad)).to_pylist()]
        later = list({c: None for parts in careful for c in parts[1:]})
        name = {c: k for k, c in enumerate(later)}
        heads = pa.array([p[0] for p in careful], pa.string())
        own, own_sizes = (np.concatenate(x) for x in zip(self.encode(pa.array(later, pa.string()), False), self.encode(heads, True), strict=True))
        at = np.array([k for i, parts in enumerate(careful) for k in (len(later) + i, *[name[c] for c in parts[1:]])], np.int64)
        n_parts = np.fromiter(map(len, careful), np.int64, len(careful))
        slow = _gather(own, own_sizes, at)
        slow_sizes = np.add.reduceat(own_sizes[at], np.cumsum(n_parts) - n_parts)
        # back in the order of the texts
        order, both = np.argsort(np.concatenate((np.flatnonzero(~bad), np.flatnonzero(bad)))), np.concatenate((sizes, slow_sizes))
        return _gather(np.concatenate((ids, slow)), both, order), both[order]


def _gather(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` (of ``sizes``, one after another) in the order ``at``."""
    begin, own = (np.cumsum(sizes) - sizes)[at], sizes[at]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    where = np.repeat((begin - (ends - own)).astype(kind), own)
    where += np.arange(total, dtype=kind)
    return ids[where]


#: White space of the byte-level pattern, as RE2 spells it.
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_SPACE_IN_TEXT = re.compile(r"(?<=\S) (?=\S)")
_BEFORE_SPACE = re.compile(r"(?<=[^ ▁]) ")


def byte_level(model, encode_batch: Callable[[list[str]], list]) -> ChunkEncoder:
    """For byte-level BPE of the ``tokenizers`` library.

    Texts are cut before every single space between two characters that are no white space: the model's own pattern always
    ends a unit there, and no unit holds a later space. Chunks are encoded many at a time, joined; as cuts are unit
    boundaries, the byte lengths of the ids tell where each chunk's ids end.
    """
    width = np.zeros(model.get_vocab_size(), np.int64)
    for piece, i in model.get_vocab().items():
        width[i] = len(piece)  # byte-level pieces spell each byte as one character

    def encode(chunks: pa.Array, leading: bool) -> Ids:
        if leading:
            return _of_lists([x.ids for x in encode_batch(chunks.to_pylist())])
        found, sizes = [], []
        for a in range(0, len(chunks), 2000):
            own = chunks[a : a + 2000]
            text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), " ")[0].as_py()
            ids = np.array(encode_batch([text])[0].ids, np.int32)
            to = np.searchsorted(np.cumsum(width[ids]), np.cumsum(pc.binary_length(own).to_numpy().astype(np.int64) + 1)) + 1
            found.append(ids)
            sizes.append(np.diff(to, prepend=0))
        return joined(found), np.concatenate(sizes) if sizes else np.empty(0, np.int64)

    return ChunkEncoder(rf"^$|^{_WHITE}|{_WHITE}$", _SPACE_IN_TEXT.split, encode)


def pieces(encode_all: Callable[[list[str]], list[list[int]]], mark: int, remembered: int = REMEMBERED) -> ChunkEncoder:
    """For sentencepiece models with a dummy prefix and no piece that holds a space mark after another character.

    Texts are cut at every space after a character that is neither a space nor U+2581, and that space is dropped: encoding
    a chunk puts a space mark in front of it, as the dropped space would.
    """

    def encode(chunks: pa.Array, leading: bool) -> Ids:
        own = chunks.to_pylist()
        found = encode_all(own) if own else []
        return _of_lists([ids if c or leading else [mark] for c, ids in zip(own, found, strict=True)])

    return ChunkEncoder("^$|▁$", _BEFORE_SPACE.split, encode, remembered)
