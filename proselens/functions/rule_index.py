"""Matches of many rules in a text, by an inverted index from words, and pairs of neighbouring words, to bit masks of rules.

A text's words are walked once. Rules of single words are matched by that walk itself. Of the others, one is asked only if the
text has a word or a pair without which it can't match, and one of its plain strings; then its pattern runs over the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import SPACE_CHARACTERS

HITS = "array<struct<rule:int,hits:array<string>>>"
_WORD = re.compile("[A-Za-z0-9_]+")


class RuleIndex:
    """Of patterns, as ``patterns`` writes them."""

    def __init__(self, rules: tuple[str, ...]):
        flags = re.IGNORECASE | re.ASCII  # boundaries and cases are those of ASCII, white space is spelt out
        self.rules = [(re.compile(P.python(p), flags).finditer, P.stems(p)) for p in rules]
        self.always = 0
        #: first word -> rules of that word alone, masks of rules by that word, and by the word after it
        self.index: dict[str, tuple[list[int], int, dict[str, int]]] = {}
        for k, pattern in enumerate(rules):
            known = P.triggers(pattern)
            self.always |= 0 if known else 1 << k
            for trigger in known:
                first, _, second = trigger.partition(" ")
                alone, mask, pairs = self.index.get(first, ([], 0, {}))
                if P.is_words(pattern):
                    alone = [*alone, k]
                elif second:
                    pairs = pairs | {second: pairs.get(second, 0) | 1 << k}
                else:
                    mask |= 1 << k
                self.index[first] = alone, mask, pairs

    def __call__(self, text: str) -> list[tuple[int, list[str]]]:
        """(place, trimmed matches) of the rules that match, in order of places."""
        words = _WORD.findall(text)
        lowered = [w.lower() for w in words]
        found: dict[int, list[str]] = {}
        mask, get = self.always, self.index.get
        for i, word in enumerate(lowered):
            known = get(word)
            if known:
                alone, own, pairs = known
                mask |= own
                for k in alone:
                    found.setdefault(k, []).append(words[i])
                if pairs and i + 1 < len(lowered):
                    mask |= pairs.get(lowered[i + 1], 0)
        low = text.lower() if mask else ""
        while mask:
            k = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            finditer, stems = self.rules[k]
            if not stems or any(s in low for s in stems):
                hits = [m[0].strip(SPACE_CHARACTERS) for m in finditer(text)]
                if hits:
                    found[k] = hits
        return sorted(found.items())


@lru_cache(maxsize=8)
def _index(rules: tuple[str, ...]) -> RuleIndex:
    return RuleIndex(rules)


def rule_hits(text: Column, rules: list[str]) -> Column:
    """The places of the matching rules, in order, with their matches; none for a null text."""
    own = tuple(rules)

    @F.arrow_udf(HITS)
    def found(texts: pa.Array) -> pa.Array:
        index = _index(own)
        each = [index(t.as_py()) if t.is_valid else [] for t in texts]
        flat = [x for hits in each for x in hits]
        bounds, ends = [0], [0]
        for hits in each:
            bounds.append(bounds[-1] + len(hits))
        for _, hits in flat:
            ends.append(ends[-1] + len(hits))
        strings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([h for _, hits in flat for h in hits], pa.string()))
        structs = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int32()), strings], names=["rule", "hits"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)

    return found(text)
