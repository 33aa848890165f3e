"""SentencePiece encoding with byte spans, and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map, which also records for every
normalised byte the source byte it came from; every piece is projected through that record to the bytes of the original text
it stands for. Ids and decoded texts are those of the sentencepiece library.

Rows: a null text counts as empty (no ids). Repeated rows are kept as they are; a kept column with the name of an output gives
way to it. A text whose pieces don't add up to its normalised form (none is known) has null spans.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .shared import in_slices, short_batches
from .token_files import slices

#: Bytes of the texts that a worker encodes together; spans take many times the room of the texts.
SLICE = 250_000
#: Bytes of chunks and ids that a worker remembers; with small slices a small memory is looked up faster.
REMEMBERED = 4 << 20

SPACE_MARK = "▁"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- normalisation ---------------------------------------------------------------------------------------------------


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """The entries of a compiled character map: a double-array trie over UTF-8 keys, then the replacements, each ended by NUL."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size :]
    found: dict[bytes, bytes] = {}

    def step(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    todo = [(step(units[0]), b"")]  # a node's children are at its position XOR their byte
    while todo:
        base, key = todo.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at < len(units) and units[at] & 0x800000FF == byte:
                child = at ^ step(units[at])
                if units[at] >> 8 & 1:  # a key ends here
                    to = units[child] & 0x7FFFFFFF
                    found[key + bytes([byte])] = texts[to : texts.index(b"\0", to)]
                todo.append((child, key + bytes([byte])))
    return found


class Normalizer:
    """Longest-prefix replacement with a record of where each normalised byte came from."""

    def __init__(self, entries: dict[bytes, bytes], dummy_prefix: bool, squeeze: bool, escape: bool = True):
        self.entries, self.dummy, self.squeeze = entries, dummy_prefix, squeeze
        self.longest = max(map(len, entries), default=0)
        self.space = SPACE_MARK.encode() if escape else b" "

    def _replaced(self, raw: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, source start, source end) along the text."""
        at, n = 0, len(raw)
        while at < n:
            for size in range(min(self.longest, n - at), 0, -1):
                to = self.entries.get(raw[at : at + size])
                if to is not None:
                    break
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                to = raw[at : at + size]
            yield to, at, at + size
            at += size

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for their end the source byte at which it begins."""
        raw = text.encode()
        if not self.entries and not self.squeeze:
            return self._plain(raw)
        units = list(self._replaced(raw))
        if self.squeeze:
            while units and units[0][0] == b" ":
                units.pop(0)
            while units and units[-1][0] == b" ":
                units.pop()
        if not units:
            return b"", np.zeros(1, np.int64)
        out, source = bytearray(), []
        if self.dummy:
            out += self.space
            source += [units[0][1]] * len(self.space)
        after_space = self.squeeze
        for to, a, _ in units:
            if after_space and self.squeeze:
                to = to.lstrip(b" ")
            if to:
                after_space = to.endswith(b" ")
                to = to.replace(b" ", self.space)
                out += to
                source += [a] * len(to)
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                del source[-len(self.space) :]
        return bytes(out), np.array([*source, units[-1][2]], np.int64)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty map: only spaces change."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        width = np.where(data == 0x20, len(self.space), 1)
        # a character's bytes all come from where it begins
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        source = np.repeat(begins[np.cumsum((data & 0xC0) != 0x80) - 1], width)
        head = len(self.space) * self.dummy
        return (self.space if self.dummy else b"") + raw.replace(b" ", self.space), np.concatenate((np.zeros(head, np.int64), source, [len(raw)]))


# ---- model -----------------------------------------------------------------------------------------------------------


class Model:
    """A sentencepiece model with its character map, the byte length of each piece, and a memory of chunks."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.processor.serialized_model_proto())
        spec = proto.normalizer_spec
        self.normalize = Normalizer(character_map(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.byte_piece = np.array([p.type == 6 for p in proto.pieces])
        self.lengths = np.where(self.byte_piece, 1, [len(p.piece.encode()) for p in proto.pieces]).astype(np.int64)
        self.unknown = self.processor.unk_id()
        split = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        split &= not proto.trainer_spec.treat_whitespace_as_suffix and not any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in proto.pieces)
        split &= proto.trainer_spec.byte_fallback and all(p.type in (1, 2, 3, 6) for p in proto.pieces) and proto.trainer_spec.model_type == 2
        self.by_chunk = chunks.pieces(self._whole, self.processor.piece_to_id(SPACE_MARK), REMEMBERED) if split else None

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (strings without nulls)."""
        if not self.by_chunk:
            return [np.array(ids, np.int32) for ids in self._whole(texts.to_pylist())]
        ids, sizes = self.by_chunk(texts)
        ends = np.cumsum(sizes)
        return [ids[a:b] for a, b in zip(ends - sizes, ends, strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.processor.decode([x.tolist() for x in ids], num_threads=1) if ids else []

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Begin and end of each piece in the bytes of ``text``. Bytes of one character spelt by byte pieces all span that character.

        None if the pieces don't add up to the normalised text.
        """
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        normal, source = self.normalize(text)
        at = ids
        lengths = self.lengths[at]
        if (at == self.unknown).any():
            lengths = self._with_unknown(text, at)
        ends = np.cumsum(lengths)
        if ends[-1] != len(normal):
            return None
        begin = source[ends - lengths]
        to = source[ends]
        # inside a character: its end is where the next source position begins
        inside = to == begin
        if inside.any():
            later = np.unique(source)
            wide = self.byte_piece[at] & inside
            to = np.where(wide, later[np.minimum(np.searchsorted(later, begin, side="right"), len(later) - 1)], to)
        return begin, to

    def _with_unknown(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Lengths of pieces where unknown ones stand for as much text as the library says."""
        names = self.processor.encode(text, out_type=str)
        return np.array([1 if b else len(p.encode()) for p, b in zip(names, self.byte_piece[ids], strict=True)], np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


# ---- jobs ------------------------------------------------------------------------------------------------------------


ENCODED = ("n_tokens", "ids", "begins", "ends")


def _encoded(path: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in in_slices(batches):
            texts = pc.fill_null(batch.column("__text"), "")
            for a, b in slices(texts, SLICE):
                ids = model.encode(texts[a:b])
                spans = [model.spans(t, i) for t, i in zip(texts[a:b].to_pylist(), ids, strict=True)]
                lost = pa.array([x is None for x in spans])
                spans = [x or (i, i) for x, i in zip(spans, ids, strict=True)]
                bounds = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = lambda parts, kind, mask=None: pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([x.astype(np.int64) for x in parts]), kind), mask=mask)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[a:b] for c in kept], pa.array(list(map(len, ids)), pa.int64()), lists(ids, pa.int32()), *[lists([x[k] for x in spans], pa.int64(), lost) for k in (0, 1)]],
                    names=[*kept, *ENCODED],
                )

    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns ``keep``, then n_tokens, ids, and begins and ends: each piece's span in the UTF-8 bytes of ``text``."""
    kept = [c for c in keep if c not in ENCODED]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    rows = docs.select(*kept, F.col("text").alias("__text"))
    return short_batches(rows).mapInArrow(_encoded(path or model_path(), kept), f"{schema}n_tokens long, ids array<int>, begins array<long>, ends array<long>")


def _covered(spans: tuple[np.ndarray, np.ndarray] | None) -> int | None:
    if spans is None:
        return None
    begin, end = spans
    return int((end - np.maximum(begin, np.concatenate(([0], end[:-1])))).clip(0).sum())


def _digested(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        decimal = [str(i) for i in range(len(model.lengths))]
        for batch in in_slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in slices(texts, SLICE):
                ids = model.encode(texts[a:b])
                covered = [_covered(model.spans(text, own)) for text, own in zip(texts[a:b].to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[a:b],
                        pa.array(list(map(len, ids)), pa.int64()),
                        pa.array([hashlib.sha256(",".join([decimal[i] for i in own.tolist()]).encode()).hexdigest() for own in ids]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in model.decode(ids)]),
                        pa.array(covered, pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "bytes_covered"],
                )

    return run


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, bytes_covered (source bytes that the pieces' spans cover)."""
    return short_batches(docs).select("doc_id", "text").mapInArrow(_digested(path or model_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_covered long")
