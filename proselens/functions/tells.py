"""Explainable signs of machine-written style, and the verdict on a text.

Every rule gives a tell (ord, id, label, count, weight, sample, fix) if it counts; ``ord`` is the order of the rules. Rules of
words and phrases are looked up in an index (``rule_index``), all of them in one pass over a text; the others are expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import patterns as P
from .rule_index import rule_hits
from .text import count_words, is_english, normalize, sentences, text_lines, trim_all

TELL = "struct<ord:int,id:string,label:string,count:int,weight:double,sample:string,fix:string>"
NONE = f"array<{TELL}>"
LOWEST_WORDS, DENSITY_WORDS = 8, 80

#: Places of the rules in order.
_CLUSTER = len(P.ON_SIGHT)
_DENSITY, _INTENSE, _BROCHURE = _CLUSTER + 1, _CLUSTER + 2, _CLUSTER + 3
_PHRASE = _CLUSTER + 4
_DASH = _PHRASE + len(P.PHRASES)
_EMOJI, _BOLD, _HEADING, _LINES, _RHYTHM, _TRIAD = range(_DASH + 1, _DASH + 7)


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, however often ``then`` and its own lambdas use it."""
    return F.transform(F.array(value), then)[0]


def hits(text: Column, pattern: Column | str, fold: bool = True) -> Column:
    """All matches, trimmed."""
    literal = F.lit(P.java(pattern, fold)) if isinstance(pattern, str) else pattern
    return F.transform(F.regexp_extract_all(text, literal, F.lit(0)), trim_all)


def _tell(ord: Column | int, id: Column | str, label: Column | str, count: Column, weight: Column | float, sample: Column, fix: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(ord).cast("int").alias("ord"), lit(id).alias("id"), lit(label).alias("label"), count.cast("int").alias("count"), lit(weight).cast("double").alias("weight"), sample.alias("sample"), lit(fix).alias("fix"))


def _one(when: Column, *tell) -> Column:
    return F.when(when, F.array(_tell(*tell))).otherwise(F.array().cast(NONE))


#: The patterns of all rules that are looked up in the index, and where each tier's begin.
INDEXED = [*[r.pattern for r in P.ON_SIGHT], *P.IN_CLUSTERS, *[r.pattern for r in P.PHRASES]]
_IN_CLUSTERS_FROM = len(P.ON_SIGHT)
_PHRASES_FROM = _IN_CLUSTERS_FROM + len(P.IN_CLUSTERS)


def _ruled(found: Column, rules: list[P.Rule], at: int, first: int, sample_chars: int | None = None) -> Column:
    """The tells of ``rules`` by their matches. They are at places from ``at`` on, and are ordered from ``first`` on."""
    listed = F.array(*[F.struct(F.lit(first + k).alias("ord"), F.lit(r.id).alias("id"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"), F.lit(r.cap).alias("cap"), F.lit(r.fix).alias("fix")) for k, r in enumerate(rules)])

    def tell(x: Column) -> Column:
        r, h, n = F.get(listed, x["rule"] - at), x["hits"], F.size(x["hits"])
        sample = h[0] if sample_chars is None else F.substring(h[0], 1, sample_chars)
        return _tell(r["ord"], r["id"], r["label"], n, r["weight"] * F.least(n, r["cap"]), sample, r["fix"])

    return F.transform(F.filter(found, lambda x: x["rule"].between(at, at + len(rules) - 1)), tell)


def _on_sight(found: Column) -> Column:
    return _ruled(found, P.ON_SIGHT, 0, 0)


def _phrases(found: Column, at: int = _PHRASES_FROM) -> Column:
    return _ruled(found, P.PHRASES, at, _PHRASE, 90)


def _cluster(found: Column, at: int = _IN_CLUSTERS_FROM) -> Column:
    own = F.transform(F.filter(found, lambda x: x["rule"].between(at, at + len(P.IN_CLUSTERS) - 1)), lambda x: x["hits"])
    # the aggregate binds the matches once
    add = lambda acc, h: F.struct((acc["rules"] + 1).alias("rules"), (acc["n"] + F.least(F.size(h), F.lit(2))).alias("n"), F.when(acc["rules"] < 5, F.concat(acc["words"], F.array(F.lower(h[0])))).otherwise(acc["words"]).alias("words"))
    zero = F.struct(F.lit(0).alias("rules"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("words"))
    tell = lambda acc: _one(acc["rules"] >= 2, _CLUSTER, "cluster", "buzzword cluster", acc["rules"], F.least(acc["n"] * 1.5, F.lit(7.0)), F.array_join(acc["words"], ", "), "plain verbs: use, help, build, lead")
    return F.aggregate(own, zero, add, tell)


def on_sight(text: Column) -> Column:
    return _on_sight(rule_hits(text, [r.pattern for r in P.ON_SIGHT]))


def phrases(text: Column) -> Column:
    return _phrases(rule_hits(text, [r.pattern for r in P.PHRASES]), 0)


def cluster(text: Column) -> Column:
    """Words that tell only together: two rules at least."""
    return _cluster(rule_hits(text, P.IN_CLUSTERS), 0)


def density(text: Column, words: Column) -> Column:
    n = F.regexp_count(text, F.lit(P.java(P.BY_DENSITY)))
    return _with(n, lambda n: _one((n >= 3) & (n / words >= 0.025), _DENSITY, "density", "vague praise density", n, 2.0, F.concat(n.cast("string"), F.lit(" in "), words.cast("string"), F.lit(" words")), "numbers and specifics"))


def intensifiers(text: Column, words: Column) -> Column:
    return _with(hits(text, P.INTENSIFIERS), lambda h: _one((F.size(h) >= 2) & (F.size(h) / words >= 0.012), _INTENSE, "intensifier", "hollow intensifiers", F.size(h), F.when(F.size(h) >= 4, 3.0).otherwise(2.0), F.array_join(F.slice(h, 1, 4), ", "), "cut them"))


def brochure(text: Column) -> Column:
    kinds = lambda h: F.size(F.array_distinct(F.transform(h, F.lower)))
    return _with(hits(text, P.BROCHURE), lambda h: _one(kinds(h) >= 2, _BROCHURE, "promo", "brochure adjectives", F.size(h), F.least(kinds(h) * 1.5, F.lit(5.0)), F.array_join(F.slice(h, 1, 4), ", "), "describe, don't sell"))


#: Patterns of structure.
DASH = r"—|\s--\s|[A-Za-z0-9_]--[A-Za-z0-9_]"
EMOJI_LINE = rf"(?m)^\s*[{P.PICTOGRAPH}]\x{{FE0F}}?\s*\S"
BOLD = r"\*\*[^*\n]{2,80}\*\*"
HEADING = r"(?m)^#{1,3} \S"
TRIAD = r"\b[A-Za-z0-9_-]+, [A-Za-z0-9_-]+,? and [A-Za-z0-9_-]+\b"
NOT_SPACE = f"[^{P.SPACES}]"


def structure_pattern(pattern: str) -> str:
    """For Spark; ``\\S`` is what isn't white space of any kind, lines end at newlines only."""
    return "(?d)" + P.java(pattern.replace(r"\S", NOT_SPACE), fold=False, words=False)


def _structural(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(structure_pattern(pattern)))


def dashes(text: Column, words: Column) -> Column:
    per = lambda n: n / words * 100
    return _with(_structural(text, DASH), lambda n: _one((n >= 2) & (per(n) >= 0.9), _DASH, "dash", "em-dash density", n, F.when(per(n) >= 2, 3.0).otherwise(2.0), F.concat(n.cast("string"), F.lit(" dashes")), "commas, periods"))


def emoji_bullets(text: Column) -> Column:
    return _with(_structural(text, EMOJI_LINE), lambda n: _one(n >= 2, _EMOJI, "emoji", "emoji bullets", n, F.when(n >= 4, 3.0).otherwise(2.0), F.concat(n.cast("string"), F.lit(" lines")), "plain sentences"))


def bold(text: Column) -> Column:
    return _with(hits(text, BOLD, fold=False), lambda h: _one(F.size(h) > 0, _BOLD, "bold", "markdown bold residue", F.size(h), 2.0, h[0], "no bold"))


def headings(text: Column) -> Column:
    return _with(_structural(text, HEADING), lambda n: _one(n >= 1, _HEADING, "heading", "markdown heading residue", n, 2.0, F.concat(n.cast("string"), F.lit(" headings")), "no headings"))


def one_line_paragraphs(text: Column) -> Column:
    brief = lambda s: F.when(count_words(s) <= 14, (F.size(sentences(s)) <= 1).cast("int")).otherwise(0)
    short = _with(text_lines(text), lambda lines: F.when(F.size(lines) >= 5, F.transform(lines, brief)).otherwise(F.array().cast("array<int>")))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    return _with(short, lambda x: _one((F.size(x) >= 5) & (total(x) / F.size(x) >= 0.75), _LINES, "broetry", "one-line paragraphs", F.size(x), 3.0, F.concat(total(x).cast("string"), F.lit(" of "), F.size(x).cast("string"), F.lit(" lines")), "join into paragraphs"))


def rhythm(text: Column) -> Column:
    """Sentences of much the same length."""
    lengths = F.transform(sentences(text), lambda s: count_words(s).cast("double"))
    moments = F.aggregate(lengths, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    mean = lambda m: m["s"] / m["n"]
    # whole numbers throughout, so the variance is exact up to one division
    cv = lambda m: F.sqrt(m["n"] * m["q"] - m["s"] * m["s"]) / m["s"]
    return _with(moments, lambda m: _one((m["n"] >= 6) & (mean(m) >= 11) & (cv(m) < 0.3), _RHYTHM, "rhythm", "metronome rhythm", m["n"], 2.0, F.concat(F.lit("sentence lengths vary by "), F.floor(cv(m) * 100 + 0.5).cast("string"), F.lit("%")), "mix short and long"))


def triads(text: Column, words: Column) -> Column:
    return _with(_structural(text, TRIAD), lambda n: _one((n >= 3) & (n / words >= 1 / 70), _TRIAD, "triad", "rule of three", n, 1.0, F.concat(n.cast("string"), F.lit(" triads")), "two or four"))


def all_tells(text: Column, words: Column, ruled: Column | None = None) -> Column:
    """The tells of a normalised text, heaviest first, then in the order of the rules. ``ruled``: its matches, if they are there already."""

    def found(x: Column) -> Column:
        t, n, own = x["text"], x["words"], x["ruled"]
        return F.concat(
            _on_sight(own), _cluster(own), density(t, n), intensifiers(t, n), brochure(t), _phrases(own), dashes(t, n),
            emoji_bullets(t), bold(t), headings(t), one_line_paragraphs(t), rhythm(t), triads(t, n),
        )

    each = F.struct(text.alias("text"), words.alias("words"), (rule_hits(text, INDEXED) if ruled is None else ruled).alias("ruled"))
    return rank_tells(_with(each, found))


def rank_tells(found: Column, top: int | None = None) -> Column:
    keyed = F.array_sort(F.transform(found, lambda t: F.struct((-t["weight"]).alias("w"), t["ord"].alias("o"), t.alias("tell"))))
    ranked = F.transform(keyed, lambda x: x["tell"])
    return ranked if top is None else F.slice(ranked, 1, top)


def raw_score(found: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda a, t: a + t["weight"])


def one_place(x: Column) -> Column:
    """To one decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def verdict(density_: Column, kinds: Column, sensitivity: str = "balanced") -> Column:
    slop, suspect = P.SENSITIVITY.get(sensitivity, P.SENSITIVITY["balanced"])
    return F.when((density_ >= slop) & (kinds >= 2), "slop").when((density_ >= suspect) & (kinds >= 2), "suspect").otherwise("clean")


def analyze(df: DataFrame, text: str = "text", sensitivity: str = "balanced", min_words: int = 0) -> DataFrame:
    """``df`` with ``analysis``: struct of words, raw, density, exact_density, verdict, skipped, tells.

    Texts below max(8, min_words) words, and texts that aren't English, have no tells and are clean.
    """
    ship(df.sparkSession)  # the rule index runs in Python workers
    steps = df.withColumn("__text", normalize(text)).withColumn("__words", count_words("__text"))
    enough = F.col("__words") >= max(LOWEST_WORDS, min_words)
    steps = steps.withColumn("__english", is_english("__text"))
    told = enough & F.col("__english")
    steps = steps.withColumn("__ruled", rule_hits(F.when(told, F.col("__text")), INDEXED))
    steps = steps.withColumn("__tells", F.when(told, all_tells(F.col("__text"), F.col("__words"), F.col("__ruled"))).otherwise(F.array().cast(NONE)))
    steps = steps.withColumn("__raw", raw_score(F.col("__tells")))
    steps = steps.withColumn("__density", F.col("__raw") * 100 / F.greatest("__words", F.lit(DENSITY_WORDS)))
    analysis = F.struct(
        F.col("__words").cast("int").alias("words"),
        one_place(F.col("__raw")).alias("raw"),
        one_place(F.col("__density")).alias("density"),
        F.col("__density").alias("exact_density"),
        verdict(F.col("__density"), F.size("__tells"), sensitivity).alias("verdict"),
        F.when(enough & ~F.col("__english"), F.lit("not english")).alias("skipped"),
        F.col("__tells").alias("tells"),
    )
    return steps.withColumn("analysis", analysis).drop("__text", "__words", "__english", "__ruled", "__tells", "__raw", "__density")


def draft_tells(df: DataFrame, text: str = "text") -> DataFrame:
    """For drafts of at least 12 words, strictly: n_tells (all counts) and lines ``“sample” → fix``."""
    scored = analyze(df, text, "strict").where("analysis.words >= 12")
    tells = F.col("analysis.tells")
    n = F.aggregate(tells, F.lit(0), lambda a, t: a + t["count"])
    lines = F.transform(tells, lambda t: F.concat(F.lit("“"), t["sample"], F.lit("” → "), F.when(t["fix"] == "", "rewrite").otherwise(F.coalesce(t["fix"], F.lit("rewrite")))))
    return scored.withColumns({"n_tells": n, "lines": lines})


def reason_line(verdict_: Column, p: Column, strict: Column, tells: Column) -> Column:
    """Why a block is marked: the verdict, the model's share where it counts, and the three heaviest tells."""
    word = F.when(verdict_ == "slop", "slop").when(verdict_ == "suspect", "maybe slop")
    share = F.when(p >= strict, F.concat(F.floor(p * 100 + 0.5).cast("string"), F.lit("% machine")))
    why = F.array_join(F.transform(F.slice(tells, 1, 3), lambda t: t["label"]), " · ")
    return F.when(word.isNotNull(), F.concat_ws(" ", word, share, F.when(why != "", why)))
