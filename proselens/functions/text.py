"""Text functions: normalising, counting, splitting and cleaning. All are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import SPACES, WS

WORD_CURLY = "[A-Za-z0-9][A-Za-z0-9'’-]*"
WORD_STRAIGHT = "[A-Za-z0-9][A-Za-z0-9'-]*"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _characters(span: str) -> str:
    """The characters of a class of plain ones, ``\\x{...}`` and ranges of these."""
    found = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), span.replace(r"\t", "\t").replace(r"\n", "\n").replace(r"\f", "\f").replace(r"\r", "\r").replace(r"\x0B", "\x0b"))
    return re.sub("(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), found, flags=re.DOTALL)


SPACE_CHARACTERS = _characters(SPACES)


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’ʼ“” ", "'''\"\" ")


def normalize(text: Column | str) -> Column:
    """Straight quotes, plain spaces, runs of blanks as one, trimmed; null as empty."""
    return trim_all(F.regexp_replace(straight_quotes(F.coalesce(_col(text), F.lit(""))), "[ \t]+", " "))


def count_words(text: Column | str, curly: bool = True) -> Column:
    return F.regexp_count(_col(text), F.lit(WORD_CURLY if curly else WORD_STRAIGHT))


def sentences(text: Column | str) -> Column:
    """Pieces of at least two words between sentence ends and newlines."""
    parts = F.split(_col(text), rf"(?<=[.!?]){WS}+(?=[A-Z0-9\"'(])|\n+")
    return F.filter(F.transform(parts, trim_all), lambda s: count_words(s) >= 2)


def text_lines(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(text), "\n+"), trim_all), lambda s: s != "")


def is_english(text: Column | str) -> Column:
    """Fewer than 20 letters, or more than 80 % of them ASCII."""
    # runs of other characters are removed: far fewer matches than letters
    letters = F.length(F.regexp_replace(_col(text), r"\P{L}+", ""))
    return (letters < 20) | (F.length(F.regexp_replace(_col(text), "[^A-Za-z]+", "")) / letters > 0.8)


def model_prep(text: Column | str) -> Column:
    """Straight quotes, lower case, numbers as 0, newlines as a mark of their own."""
    plain = F.lower(straight_quotes(F.coalesce(_col(text), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(plain, "[0-9]+", "0"), rf"{WS}*\n+{WS}*", " ¶ ")


def detokenize(text: Column | str) -> Column:
    """Undo the spacing of text that was split into tokens."""
    s = F.regexp_replace(_col(text), r"(?i) (n't|'s|'re|'ve|'ll|'d|'m)(?![\p{L}\p{N}_])", "$1")
    s = F.regexp_replace(s, r" ([.,!?;:%)\]}])", "$1")
    s = F.regexp_replace(s, r"([(\[{$]) ", "$1")
    s = F.regexp_replace(s, r"([\p{L}\p{N}_]) - ([\p{L}\p{N}_])", "$1-$2")
    s = F.regexp_replace(s, r'" ([^"]{1,200}?) "', '"$1"')
    return trim_all(F.when(F.contains(s, F.lit(" ' ")), F.regexp_replace(s, rf"{WS}+'{WS}*([\p{{L}}\p{{N}}_])", "'$1")).otherwise(s))


#: Entities in the order in which they are decoded.
ENTITIES = [("&#x27;", "'"), ("&quot;", '"'), ("&#x2F;", "/"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")]


def strip_html(text: Column | str) -> Column:
    """Paragraph tags as blank lines, no other tags, entities decoded."""
    s = F.regexp_replace(F.replace(_col(text), F.lit("<p>"), F.lit("\n\n")), "<[^>]+>", "")
    for entity, character in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(character))
    return trim_all(s)


def unescape(text: Column | str) -> Column:
    return trim_all(F.replace(F.replace(_col(text), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')))


def word_bounds(df: DataFrame, low: int, high: int | None = None, text: str = "text") -> DataFrame:
    """Rows with between ``low`` and ``high`` words."""
    n = count_words(text, curly=False)
    return df.where(n >= low if high is None else n.between(low, high))


#: Characters given to the model and to the second opinion.
MODEL_CHARS, OPINION_CHARS = 6_000, 20_000


def truncate(text: Column | str, n: int) -> Column:
    return F.substring(_col(text), 1, n)
