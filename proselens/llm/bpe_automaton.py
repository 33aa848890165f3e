"""BPE encoding by a compiled tokenization automaton, and decoding by its arc labels.

The automaton reads token labels. It starts as one state with a loop for every base symbol, which accepts every spelling, and
each merge (u, v) adds its gadget, in order of rank: a copy of the state that u's arc leads to, without the arc v, to which
u's arc is turned; and an arc uv from every state that has an arc u, to where v led. What is left after the last merge accepts
of all spellings of a word exactly the one that the merges make. A gadget takes one state and one removed arc: a state keeps
its origin and the label that it lacks, and an arc that is no base symbol is there if its first half was there when it was
added, so the tables grow with the merges and not with states times labels.

A word is encoded by walking from position to position: a trie of the labels gives those that spell the next symbols, the
automaton the state that each leads to. Every prefix of a word is reached by one path only, so the walk is deterministic and
its work grows with the word's length. Many words take each step together, in arrays.

Texts are cut, normalised and split into words as the tokenizer's file says, special tokens first.

Rows: a null text counts as empty (no ids, empty decoded text). Repeated rows are kept as they are, other columns are left
out, a table without rows gives none, and texts of any length are encoded whole. There are no ties: the spelling is unique.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, Ids, joined
from .chunks import _gather as gather
from .shared import in_slices
from .token_files import slices

#: Bytes of texts that a worker encodes together, and of chunks that it remembers; symbols of a word above which it is encoded alone.
SLICE, REMEMBERED, LONG = 4_000_000, 24 << 20, 48

#: The rules of the given file. Where they hold, chunks of ASCII and of Latin letters are cut by a short pattern that
#: does the same to them; all others, and all of other files, by the library.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_EASY = "^[!-~À-ÖØ-öø-ÿ]+$"
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+| ")
#: Byte-level spelling of those letters: UTF-8 bytes from A1 (but AD) stand for themselves, the others, in order, for U+0100 and on after the 33 bytes up to 20 and 7F.
_SPELT = {c: "".join(chr(b) if 0xA1 <= b != 0xAD else chr(0x143 if b == 0xAD else 0x100 + 34 + b - 0x80) for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}

_NEVER = r"[^\x00-\x{10FFFF}]"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Automaton:
    """The automaton of a list of merges over base symbols. Labels are numbers: base symbols first, then one for each merge."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        self.n_symbols = len(symbols)
        self.names = [*symbols, *(u + v for u, v in merges)]
        number = {name: k for k, name in enumerate(self.names)}
        halves = [(number.get(u, len(number)), number.get(v, len(number))) for u, v in merges]
        for k, (u, v) in enumerate(halves):
            if max(u, v) >= len(symbols) + k or len(number) < len(self.names):
                raise ValueError(f"merge of {merges[k]}: a half that is not there yet, or a token made twice")
        idle: set[int] = set()
        while True:
            spelt, before = self._compile(halves, idle)
            # a merge whose halves never meet, as an earlier one takes the second half's symbols first, has no gadget
            there = self.has(before, np.array([v for _, v in halves], np.int64)) if halves else np.ones(0, bool)
            never = [k for k in np.flatnonzero(~there).tolist() if k not in idle]
            if not never:
                break
            idle.add(never[0])
            for k, pair in enumerate(halves):  # nor has one with a half that is never made
                if any(x - len(symbols) in idle for x in pair):
                    idle.add(k)
        self._build_trie([x if k - len(symbols) not in idle else () for k, x in enumerate(spelt)])

    def _compile(self, halves: list[tuple[int, int]], idle: set[int]) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """Applies the gadgets. Returns what each label spells, and the state that each merge's first half led to before it."""
        n = self.n_symbols
        left, target = [-1] * n, [0] * n  # a label's first half, and the state after its arc, the same from every state that has the arc
        spelt = [(k,) for k in range(n)]
        origin, lacks = [-1], [-1]  # of each state: what it is a copy of, and the label removed
        before = []
        for k, (u, v) in enumerate(halves):
            before.append(target[u])
            after = before[k] if u == v else target[v]
            left.append(u)
            spelt.append(spelt[u] + spelt[v])
            origin.append(before[k] if k not in idle else 0)  # the k-th merge makes the k-th state and the k-th label after the symbols
            lacks.append(v if k not in idle else -1)
            if k not in idle:
                target[u] = k + 1
            target.append(after)
        self.left, self.target = np.array(left, np.int32), np.array(target, np.int32)
        self.sizes = np.array([len(x) for x in spelt], np.int32)
        self._number_states(origin, lacks)
        return spelt, np.array(before, np.int64)

    def _number_states(self, origin: list[int], lacks: list[int]) -> None:
        """Depth-first places of the states, so that a state's copies and their copies have places in one range, and the states by what they lack."""
        children: list[list[int]] = [[] for _ in origin]
        for state, before in enumerate(origin[1:], 1):
            children[before].append(state)
        first, last = np.zeros(len(origin), np.int64), np.zeros(len(origin), np.int64)
        clock, todo = 0, [0]
        while todo:
            state = todo.pop()
            if state < 0:
                last[~state] = clock
                continue
            first[state] = clock
            clock += 1
            todo.append(~state)
            todo += children[state]
        self.place, self.n_states = first, len(origin)
        label = np.array(lacks[1:], np.int64)
        key = label * self.n_states + first[1:]
        order = np.argsort(key)[(label < 0).sum() :]
        self.lack_key, self.lack_label = key[order], label[order]
        self.lack_state, self.lack_last = order + 1, last[1:][order]

    def _build_trie(self, spelt: list[tuple[int, ...]]) -> None:
        """Labels by the symbols that they spell: a table of (node, symbol) to node, hashed with linear probing, and the label that ends at each node."""
        arcs: dict[int, int] = {}
        ends = {}
        for label, spelling in enumerate(spelt):
            at = 0
            if not spelling:
                continue
            for symbol in spelling:
                at = arcs.setdefault(at * self.n_symbols + symbol, len(arcs) + 1)
            ends[at] = label
        self._arcs = arcs
        self.ends = np.full(len(arcs) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        keys, to = np.fromiter(arcs, np.int64, len(arcs)), np.arange(1, len(arcs) + 1, dtype=np.int32)
        self.bits = max(1, (2 * len(arcs)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of those that meet in a slot, the last gets it
            placed = self.keys[slot] == keys
            self.to[slot[placed]] = to[placed]
            keys, to, slot = keys[~placed], to[~placed], (slot[~placed] + 1) & (len(self.to) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The node below each node by the symbol beside it, or -1."""
        keys = nodes.astype(np.int64) * self.n_symbols + symbols
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.to[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.to) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            found[todo[hit]] = self.to[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return found

    def has(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of the label beside it.

        It hasn't if the state or one that it is a copy of lacks the label. An arc that a merge made later than that is there only
        if its first half is, and so on.
        """
        there = np.ones(len(states), bool)
        at = np.arange(len(states))
        place, label, until = self.place[states], labels.astype(np.int64), np.full(len(states), self.n_states, np.int64)
        while len(at):
            # of the states that lack a label at most one is an origin of a given state
            found = np.searchsorted(self.lack_key, label * self.n_states + place, side="right") - 1
            gone = (found >= 0) & (self.lack_label[found] == label) & (place < self.lack_last[found]) & (self.lack_state[found] <= until)
            there[at[gone]] = False
            more = ~gone & (label >= self.n_symbols)
            at, place, label = at[more], place[more], label[more]
            until, label = label - self.n_symbols + 1, self.left[label].astype(np.int64)
        return there

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the only accepted spelling of each word, all in a row, and how many each word has. All words step together.

        ``symbols``: those of all words in a row, of ``lengths``, none of them 0.
        """
        order = np.argsort(-lengths, kind="stable")
        own = lengths[order]
        begin = (np.cumsum(lengths) - lengths)[order]
        # places between symbols: one more than symbols for each word
        gap = begin + order
        state = np.full(len(symbols) + len(lengths), -1, np.int32)
        came = np.full(len(symbols) + len(lengths), -1, np.int32)
        state[gap] = 0
        active = np.searchsorted(-own, -np.arange(int(own[0]) if len(own) else 0), side="left")
        for i, n in enumerate(active.tolist()):  # words longer than i
            word, node, at = np.arange(n), np.zeros(n, np.int32), i
            while len(word):
                to = self.child(node, symbols[begin[word] + at])
                on = to >= 0
                word, node = word[on], to[on]
                at += 1
                label, here = self.ends[node], gap[word] + at
                ask = np.flatnonzero((label >= 0) & (state[here] < 0))
                if len(ask):
                    ask = ask[self.has(state[gap[word[ask]] + i], label[ask])]
                    state[here[ask]] = self.target[label[ask]]
                    came[here[ask]] = label[ask]
                longer = own[word] > at
                word, node = word[longer], node[longer]
        return self._spellings(came, gap + own, order, len(lengths))

    def encode_long(self, symbols: list[int]) -> list[int]:
        """The labels of one word, step by step; what was asked of the automaton is kept for the word."""
        ends, known = memoryview(self.ends), {}
        states, came = [0, *[-1] * len(symbols)], [-1] * (len(symbols) + 1)
        for i in range(len(symbols)):
            state, node = states[i], 0
            for j in range(i, len(symbols)):
                node = self._arcs.get(node * self.n_symbols + symbols[j])
                if node is None:
                    break
                label = ends[node]
                if label >= 0 and states[j + 1] < 0:
                    if (state, label) not in known:
                        known[state, label] = bool(self.has(np.array([state]), np.array([label]))[0])
                    if known[state, label]:
                        states[j + 1], came[j + 1] = int(self.target[label]), label
        found, at = [], len(symbols)
        while at:
            found.append(came[at])
            at -= int(self.sizes[came[at]])
        return found[::-1]

    def _spellings(self, came: np.ndarray, last: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Back from each word's end, label by label."""
        steps, word, at = [], np.arange(n), last.copy()
        while len(word):
            label = came[at]
            steps.append((word, label))
            at = at - self.sizes[label]
            on = came[at] >= 0
            word, at = word[on], at[on]
        counts = np.zeros(n, np.int64)
        for word, _ in steps:
            counts[word] += 1
        sizes = np.empty(n, np.int64)
        sizes[order] = counts
        ends = np.cumsum(sizes)[order]
        out = np.empty(int(sizes.sum()), np.int32)
        for k, (word, label) in enumerate(steps):
            out[ends[word] - 1 - k] = label
        return out, sizes


class WordModel:
    """A tokenizer file of the kind "BPE with word ends" without decoder: words by its own rules, ids by the automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        if model["type"] != "BPE" or any((model.get(k) or None) != (v or None) for k, v in plain.items()) or spec["decoder"] or spec["post_processor"]:
            raise ValueError("only plain BPE models without decoder and post-processor are known")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that stand for themselves are known")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.latin = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLITTER
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {u + v for u, v in merges}
        symbols = [t for t in model["vocab"] if t not in made]
        self.automaton = Automaton(symbols, merges)
        self.end = model["end_of_word_suffix"] or ""
        number = {t: k for k, t in enumerate(symbols)}
        top = max(ord(c) for t in symbols for c in t) + 1
        self.inner, self.final = (np.array([number.get(chr(c) + end, -1) for c in range(top)], np.int32) for end in ("", self.end))
        self.id_of = np.array([model["vocab"][t] for t in self.automaton.names], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.find_special = re.compile("(" + "|".join(tokens or [r"(?!)"]) + ")")
        self.odd = "|".join([r"[\x{85}\p{Z}]", *tokens])
        named = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.labels = pa.array([named.get(i, "") for i in range(max(named) + 1)], pa.string())
        # white space ends a word whatever stands beside it, so texts are encoded chunk by chunk
        self.by_chunk = ChunkEncoder(_NEVER, lambda t: t.split(" "), lambda chunks, leading: self.chunks(chunks), REMEMBERED)

    def words(self, words: list[str]) -> Ids:
        """Ids of words spelt in the alphabet of the model, all in a row, and how many each word has. Long words go alone, as all words of a call step together."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        distinct = list(dict.fromkeys(words))
        number = {w: k for k, w in enumerate(distinct)}
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        code = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32)
        symbols, ends = self.inner[code], np.cumsum(lengths)
        symbols[ends - 1] = self.final[code[ends - 1]]
        if (symbols < 0).any():
            raise ValueError("a character outside the model's alphabet")
        short, long = np.flatnonzero(lengths <= LONG), np.flatnonzero(lengths > LONG)
        labels, sizes = self.automaton.encode(gather(symbols, lengths, short), lengths[short])
        alone = [self.automaton.encode_long(symbols[ends[k] - lengths[k] : ends[k]].tolist()) for k in long.tolist()]
        ids = self.id_of[np.concatenate((labels, *[np.array(x, np.int32) for x in alone]))]
        sizes, rank = np.concatenate((sizes, np.array([len(x) for x in alone], np.int64))), np.concatenate((short, long))
        place = np.empty(len(distinct), np.int64)
        place[rank] = np.arange(len(distinct))
        at = np.fromiter((number[w] for w in words), np.int64, len(words))
        return gather(ids, sizes, place[at]), sizes[place[at]]

    def chunks(self, chunks: pa.Array) -> Ids:
        """Ids of chunks without spaces. Those that may hold a special token or other white space are looked at one by one, the others joined."""
        odd = pc.match_substring_regex(chunks, self.odd).to_numpy(zero_copy_only=False)
        words, owner = [], []
        rest = ~odd & (pc.binary_length(chunks).to_numpy() > 0)
        if self.latin:
            easy = pc.match_substring_regex(chunks, _EASY).to_numpy(zero_copy_only=False) & rest
            rest &= ~easy
            cut = _LATIN.findall(" ".join(chunks.filter(pa.array(easy)).to_pylist()).lower())
            ends = np.fromiter((w == " " for w in cut), bool, len(cut))
            owner.append(np.flatnonzero(easy)[np.cumsum(ends)[~ends]])
            words += [w if w.isascii() else w.translate(_SPELT) for w in cut if w != " "]
        plain = np.flatnonzero(rest)
        if len(plain):
            text = self.normalizer.normalize_str(" ".join(chunks.take(pa.array(plain)).to_pylist()))
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            cut = self.splitter.pre_tokenize_str(text)
            words += [w for w, _ in cut]
            owner.append(plain[np.searchsorted(spaces, np.fromiter((o[0] for _, o in cut), np.int64, len(cut)))])
        for k in np.flatnonzero(odd).tolist():
            for part in self.find_special.split(chunks[k].as_py()):
                cut = [part] if part in self.special else [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
                words += cut
                owner.append(np.full(len(cut), k))
        owner = joined(owner).astype(np.int64)
        special = np.array([w in self.special for w in words], bool) if odd.any() else np.zeros(len(words), bool)
        special &= odd[owner] if len(owner) else special
        ids, sizes = self.words([w for w, s in zip(words, special.tolist(), strict=True) if not s])
        if special.any():
            all_sizes = np.ones(len(words), np.int64)
            all_sizes[~special] = sizes
            ends = np.cumsum(all_sizes)
            all_ids = np.empty(int(ends[-1]), np.int32)
            mask = np.ones(len(all_ids), bool)
            mask[ends[special] - 1] = False
            all_ids[mask] = ids
            all_ids[~mask] = [self.special[w] for w, s in zip(words, special.tolist(), strict=True) if s]
            ids, sizes = all_ids, all_sizes
        order = np.argsort(owner, kind="stable")
        return gather(ids, sizes, order), np.bincount(owner, sizes, len(chunks)).astype(np.int64)

    def encode(self, texts: pa.Array) -> Ids:
        """All ids of the texts (strings without nulls) in a row, and how many each text has."""
        return self.by_chunk(pc.replace_substring_regex(texts, "[\t-\r]", " "))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The labels of each list's ids, a space between them."""
        named = pa.ListArray.from_arrays(ids.offsets, self.labels.take(ids.values))
        return pc.binary_join(named, " ")


@lru_cache(maxsize=2)
def load(path: str) -> WordModel:
    return WordModel(path)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with the ids of their texts."""
    model = load(path)
    for batch in in_slices(batches):
        texts = pc.fill_null(batch.column("text"), "")
        for a, b in slices(texts, SLICE):
            yield batch.slice(a, b - a), *model.encode(texts[a:b])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int)."""
    path = path or model_path()

    def run(batches):
        for rows, ids, sizes in _encoded(path, batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _lists(ids, sizes)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: of the columns doc_id, ids; null ids give an empty text."""
    path = path or model_path()

    def run(batches):
        model = load(path)
        for batch in in_slices(batches):
            ids = batch.column("ids")
            lists = _lists(ids.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), model.decode(lists)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit integers), decoded_sha256."""
    path = path or model_path()

    def run(batches):
        for rows, ids, sizes in _encoded(path, batches):
            raw, ends = ids.astype("<u4"), np.cumsum(sizes)
            hashes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            texts = load(path).decode(_lists(ids, sizes)).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
