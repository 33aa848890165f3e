"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a long token, a value of 6 characters or more that is assigned to a name of a secret, or a private key between
its BEGIN and END lines. The forest looks at its length, its character classes and the transitions between its characters
(held against those of the corpus' frequent words), how much of it a dictionary covers (the same words and a fixed list), how
much it looks like a path, whether it has the form of an issued key, the name and sign before it, and the words around it (the
log-odds that the lessons give them).

It is trained on labelled findings. Where none are given, ``lessons`` plants known secrets and known look-alikes in passages of
the corpus, by a seeded generator (about FIT_FINDINGS, a fixed number whatever the corpus), finds them as candidates like any
others, and labels them by what was planted, not by what a feature says. A fifth of the lessons is held out of the training;
``quality`` reports precision and recall on it.

All of it is DataFrame operations and Spark ML.

Rows: null and empty texts have no findings. A value that a text holds several times is one finding, at its first place; its
surroundings are those of the place that speaks most for a secret. Repeated rows with one id are one finding, and are masked
alike. Ids may be null. With labelled findings of one kind only, there is no forest and no candidate is a secret.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stage

#: Findings that the forest is trained on, about: a documented bound.
FIT_FINDINGS = 8_000
TREES, DEPTH = 30, 9
MASK = "[SECRET]"
#: A word belongs to the corpus' dictionary if it makes at least this share of its words, so there are at most 100,000.
WORD_SHARE = 1e-5

_CHARACTERS = r"A-Za-z0-9+/_.\-"
_TOKEN = rf"(?<![{_CHARACTERS}])[{_CHARACTERS}]{{16,}}+(?:={{1,2}}(?!=|[\"']?[A-Za-z0-9]))?"  # the signs at its end are no assignment
_ASSIGN = r"[\"']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}[\"']?"
#: A name (its last 100 characters, if it is longer) and a sign, or a word.
_BEFORE = rf"[A-Za-z0-9_.\-]{{1,100}}(?:{_ASSIGN}|[ \t]+[\"']?)$"
#: The value is looked ahead to, not consumed, so that names in it are found too.
_ASSIGNED = (
    r"(?i)(?<![A-Za-z0-9_.\-])[A-Za-z0-9_.\-]*?(?:token|secret|passw|passphrase|pwd|api.?key|access.?key|auth(?!ors?(?![a-z]))|credential|private.?key|bearer)"
    rf"[A-Za-z0-9_.\-]*+{_ASSIGN}(?:(?:bearer|basic|digest)[ \t]+)?+(?=([^\s\"'\[][^\s\"']{{5,}}))"
)
_KEY_LINE = "PRIVATE KEY-----"
_KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----[^-]+-----END [A-Z0-9 ]{0,30}PRIVATE KEY-----"

#: Names that secrets are assigned to, and names of tokens that are none.
SECRET_NAME = r"(?i)(token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|credential|private.?key|bearer)"
BENIGN_NAME = (
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"  # a word of its own, not a part of one
    r"(?i:sha\d*|md5|hash|checksum|digest|commit|revision|uuid|guid|version|etag|integrity|example|card|phone|mail|url|href|src)s?(?![a-z])"
)
#: Public forms in which services issue keys and tokens.
ISSUED = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})$|^-----BEGIN"
)
#: Words of which names, paths and placeholders are made.
DICTIONARY = (
    "access account address admin agent album alpha android apple application archive article asset author auto back base beta block blog board "
    "book branch browser build cache change channel chapter check class client cloud code color comment common company config connect content "
    "context control copy core count create current data date debug default delete demo design detail device digital direct display document "
    "domain download draft edit email engine error event example export feature field file filter first folder form format forum frame "
    "function general group guide handler header help history home host image import index info input install instance internal item java "
    "key lang language last layer layout level library license line link list local location login main manage manager media member message "
    "meta method mobile mode model module name network news node note null number object office online open option order output package page "
    "param parent part password path person photo picture place platform player plugin point policy portal post print private process product "
    "profile program project public query question read record reference release remote report request resource response result review root "
    "route sample schema screen script search section secret secure server service session setting shop simple single site size social source "
    "space stack standard start state static status storage store stream string style subject summary support system table target task team "
    "template test text theme thread time title token tool topic track type under update upload user value vendor version video view visit "
    "voice watch web week widget window wiki word work world write year your https http www com org net html"
).split()

_FEATURES = [
    "length", "digits", "uppers", "lowers", "signs", "vowels", "different", "to_digit", "to_letter", "case_changes", "longest_letters",
    "transitions", "covered", "issued", "slashes", "dots", "secret_name", "benign_name", "assigned", "quoted", "around",
]


def _found(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(group))


def _places(gaps: Column, found: Column) -> Column:
    """Where each of ``found`` begins, given the text between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("own"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["own"]), F.lit(0))).alias("at"), F.concat(s["places"], F.array(s["at"] + F.length(x["gap"]))).alias("places")
    )
    return F.aggregate(pairs, start, step, lambda s: s["places"])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, value, place (characters before it), before (the word and sign before it), near (text around it).

    docs: doc_id, text, text_hash.
    """
    any_token, any_name, any_block = F.col("text").rlike(rf"[{_CHARACTERS}]{{16}}"), F.col("text").rlike(_ASSIGNED), F.col("text").contains(_KEY_LINE)
    parts = {
        "tokens": (any_token, _found(_TOKEN)), "gaps": (any_token, F.split("text", _TOKEN)),
        "names": (any_name, _found(_ASSIGNED)), "assigned": (any_name, _found(_ASSIGNED, 1)), "between": (any_name, F.split("text", _ASSIGNED)),
        "blocks": (any_block, _found(_KEY_BLOCK)), "outside": (any_block, F.split("text", _KEY_BLOCK)),
    }
    nothing = F.array().cast("array<string>")
    kept = docs.where(any_token | any_name | any_block).select("doc_id", "text_hash", *[F.when(has, x).otherwise(nothing).alias(name) for name, (has, x) in parts.items()])
    kept = kept.withColumns({"token_at": _places(F.col("gaps"), F.col("tokens")), "name_at": _places(F.col("between"), F.col("names")), "block_at": _places(F.col("outside"), F.col("blocks"))})
    one = lambda value, place, before, after, name=F.lit(None).cast("string"): F.struct(
        value.alias("value"), place.cast("long").alias("place"), F.right(before, F.lit(130)).alias("left"), F.left(after, F.lit(40)).alias("right"), F.right(name, F.lit(130)).alias("name")
    )

    def lone(token: Column, k: Column) -> Column:
        # what stands before a token: the token before it, which may be its name, and what is between them
        bare = F.regexp_replace(token, r"^[/_.\-]+", "")
        left = F.concat(F.when(k > 0, F.get("tokens", k - 1)).otherwise(""), F.get("gaps", k))
        return one(F.regexp_replace(bare, r"[/.\-]+$", ""), F.get("token_at", k) + F.length(token) - F.length(bare), left, F.get("gaps", k + 1))

    def given(value: Column, k: Column) -> Column:
        ends = F.when(value.rlike(r"[(\[{<]"), F.regexp_replace(value, r"[.,;:]+$", "")).otherwise(F.regexp_replace(value, r"[.,;:)\]}>]+$", ""))
        name = F.get("names", k)
        left = F.concat(F.right(F.get("between", k), F.lit(60)), name)
        return one(ends, F.get("name_at", k) + F.length(name), left, F.substr(F.get("between", k + 1), F.length(value) + 1), name)

    def block(value: Column, k: Column) -> Column:
        return one(value, F.get("block_at", k), F.get("outside", k), F.get("outside", k + 1))

    every = F.concat(F.transform("tokens", lone), F.transform("assigned", given), F.transform("blocks", block))
    raw = kept.select("doc_id", "text_hash", F.explode(F.array_distinct(every)).alias("x")).select("doc_id", "text_hash", "x.*").where("length(value) >= 6")
    told = raw.withColumn("before", F.coalesce("name", F.regexp_extract("left", _BEFORE, 0))).withColumn("near", F.concat_ws(" ", F.right("left", F.lit(60)), "right"))
    secret, assigned, benign = F.col("before").rlike(SECRET_NAME), F.col("before").rlike("[=:]"), F.col("before").rlike(BENIGN_NAME)
    telling = F.struct(secret & assigned & ~benign, secret & ~benign, secret, assigned, "before", "near")
    return told.groupBy("doc_id", "text_hash", "value").agg(F.min("place").alias("place"), F.max_by(F.struct("before", "near"), telling).alias("x")).select("doc_id", "text_hash", "value", "place", "x.before", "x.near")


# ---- what the corpus tells ---------------------------------------------------------------------------------------------

_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
_KINDS = len(_ALPHABET) + 1  # all other characters are one kind


def _kind(text: Column, k: Column) -> Column:
    return F.position(F.substr(text, k, F.lit(1)), F.lit(_ALPHABET))


def dictionary(docs: DataFrame) -> DataFrame:
    """word, n: the words of 3 to 20 letters that make at least WORD_SHARE of all of ``docs`` and occur twice; at most 1 / WORD_SHARE."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, 20))
    counted = stage(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    least = max(2.0, (counted.agg(F.sum("n")).first()[0] or 0) * WORD_SHARE)
    return stage(counted.where(F.col("n") >= least), "dictionary")


def transitions(words: DataFrame) -> list[float]:
    """Log-probability of the second of two characters given the first, among the words' letters; a table of _KINDS squared."""
    pairs = words.select("n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select((_kind(F.col("word"), F.col("k")) * _KINDS + _kind(F.col("word"), F.col("k") + 1)).alias("pair"), "n")
    logs = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("first", F.floor(F.col("pair") / _KINDS))
    seen = {(r["first"], r["pair"]): r["n"] for r in logs.collect()}  # at most _KINDS squared rows
    firsts = [sum(n for (f, _), n in seen.items() if f == a) for a in range(_KINDS)]
    return [math.log((seen.get((a, a * _KINDS + b), 0) + 1) / (firsts[a] + _KINDS)) for a in range(_KINDS) for b in range(_KINDS)]


def _words_of(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+"), F.lit(0)), F.lower)


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col("value"), F.lit(pattern)).cast("double")


class Corpus:
    """What the texts of a corpus say of candidates: its dictionary and its transitions of letters."""

    def __init__(self, docs: DataFrame):
        self.words = dictionary(docs)
        self.table = transitions(self.words)
        fixed = docs.sparkSession.createDataFrame([(w,) for w in DICTIONARY], "word string")
        self.known = small(stage(self.words.select("word").unionByName(fixed).distinct(), "known"))  # bounded by WORD_SHARE, words by 20 letters

    def features(self, findings: DataFrame) -> DataFrame:
        """``findings`` (value, before) with the columns that the forest looks at, but for ``around``."""
        n = F.length("value").cast("double")
        per_word = findings.select("value").distinct().select("value", F.explode(_words_of(F.col("value"))).alias("word")).where("length(word) >= 3")
        covered = per_word.join(self.known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered_letters"))
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.table)), ",").cast("array<double>")
        kinds = F.transform(F.split(F.lower("value"), ""), lambda c: F.position(c, F.lit(_ALPHABET)))
        pair = lambda first, second: F.element_at(table, first * _KINDS + second + 1)
        logs = F.zip_with("kinds", F.slice("kinds", F.lit(2), F.size("kinds")), pair)  # null for the last, which nothing follows
        longest = F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)), F.length))
        return findings.join(covered, "value", "left").withColumn("kinds", kinds).withColumns({
            "length": F.log(n),
            "digits": _count("[0-9]") / n,
            "uppers": _count("[A-Z]") / n,
            "lowers": _count("[a-z]") / n,
            "signs": _count("[^A-Za-z0-9]") / n,
            "vowels": _count("[AEIOUaeiou]") / n,
            "different": F.size(F.array_distinct(F.split("value", ""))) / n,
            "to_digit": _count("[A-Za-z](?=[0-9])") / n,
            "to_letter": _count("[0-9](?=[A-Za-z])") / n,
            "case_changes": _count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
            "longest_letters": F.coalesce(longest, F.lit(0)) / n,
            "transitions": F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.greatest(F.size("kinds") - 1, F.lit(1)),
            "covered": F.coalesce("covered_letters", F.lit(0)) / n,
            "issued": F.col("value").rlike(ISSUED).cast("double"),
            "slashes": _count("/") / n,
            "dots": _count(r"\.") / n,
            "secret_name": F.col("before").rlike(SECRET_NAME).cast("double"),
            "benign_name": F.col("before").rlike(BENIGN_NAME).cast("double"),
            "assigned": F.col("before").rlike("[=:]").cast("double"),
            "quoted": F.col("before").rlike("[\"']$").cast("double"),
        }).drop("covered_letters", "kinds")


def _near_words() -> Column:
    return F.explode(F.array_distinct(F.regexp_extract_all(F.lower("near"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("word")


def odds(labelled: DataFrame) -> DataFrame:
    """word, odds: smoothed log-odds of a secret beside each word that stands near eight or more of the findings (near, label)."""
    counted = labelled.select("label", _near_words()).groupBy("word").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    return counted.where("yes + no >= 8").select("word", F.log((F.col("yes") + 4) / (F.col("no") + 4)).alias("odds"))


def with_odds(findings: DataFrame, odds: DataFrame) -> DataFrame:
    """``findings`` with ``around``: the sum of the odds of the words near them."""
    near = findings.select("near").distinct().select("near", _near_words()).join(odds, "word").groupBy("near").agg(F.sum("odds").alias("around"))
    return findings.join(near, "near", "left").withColumn("around", F.coalesce("around", F.lit(0.0)))


# ---- lessons -----------------------------------------------------------------------------------------------------------

#: Names before planted secrets, names before look-alikes, signs between a name and a value.
_PLANTED_NAMES = ("token", "api_key", "apiKey", "secret", "client_secret", "password", "passwd", "access_token", "auth_token", "AWS_SECRET_ACCESS_KEY", "db_password", "private_key", "API_TOKEN", "TOKEN", "credential", "X-Auth-Token", "SECRET_KEY", "bearer")
_DIGEST_NAMES = ("sha256", "sha1", "md5", "commit", "checksum", "digest", "revision", "etag", "integrity", "hash", "fingerprint", "blob", "tree")
_ID_NAMES = ("id", "uuid", "request_id", "trace", "card", "phone", "order", "account", "isbn", "ref", "version", "timestamp", "size", "build")
_BENIGN_SECRET_NAMES = ("token_type", "token_count", "password_hint", "auth_url", "secret_name", "api_key_url", "password_field", "auth_method", "token_class", "credential_type")
_SIGNS = (' = "', '="', ": ", "=", ': "', '": "', " => ", " := '")
_PROSE = ("is", "with", "use", "see", "and", "the", "at", "for")


class _Draw:
    """Columns drawn by hashes of ``key``; each call draws anew, the same on every run."""

    def __init__(self, seed: int):
        self.seed = seed

    def number(self, below: int) -> Column:
        self.seed += 1
        return F.pmod(F.xxhash64(F.lit(self.seed), "key"), F.lit(below)).cast("int")

    def of(self, values) -> Column:
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), self.number(len(values)) + 1)

    def hexed(self) -> Column:
        """128 hexadecimal digits."""
        self.seed += 1
        return F.concat(*[F.sha2(F.concat_ws(":", F.lit(f"{self.seed}{x}"), "key"), 256) for x in "ab"])

    def cut(self, text: Column | str, low: int, high: int) -> Column:
        return F.substr(F.col(text) if isinstance(text, str) else text, F.lit(1), self.number(high - low + 1) + low)

    def word(self) -> Column:
        """A word of the passage."""
        return F.coalesce(F.get("words", self.number(1 << 20) % F.greatest(F.size("words"), F.lit(1))), F.lit("word"))

    def materials(self) -> dict[str, Column]:
        """Of what planted values are made: random characters, words of the passage and of the fixed list."""
        name = lambda: F.lower(F.regexp_replace(self.word(), r"[^A-Za-z]", ""))
        return {
            "hex": self.hexed(), "base64": F.regexp_replace(F.base64(F.unhex(F.concat(self.hexed(), self.hexed()))), r"\s", ""), "digits": F.translate(self.hexed(), "abcdef", "012345"),
            **{f"name{i}": name() for i in range(4)}, **{f"known{i}": self.of(DICTIONARY) for i in range(3)}, "host_end": self.of((".com", ".org", ".example.com", ".net", ".io")),
        }


def _first(text: Column | str, n: int) -> Column:
    return F.substr(F.col(text) if isinstance(text, str) else text, F.lit(1), F.lit(n))


def _planted(d: _Draw) -> list[tuple[float, tuple, Column, str]]:
    """label, names before it (none: prose), value, what it is; from the columns of ``materials`` and ``plain``, base64 without signs."""
    name, other, third = F.col("name0"), F.col("name1"), F.col("name2")
    known, known2, known3 = F.col("known0"), F.col("known1"), F.col("known2")
    uuid = F.regexp_replace(_first("hex", 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    host = F.concat(name, d.of((".", "-")), other, "host_end")
    digest = F.substr(F.col("hex"), F.lit(1), d.of((32, 40, 64)))
    longest = F.concat(name, other, third, "name3")
    few = F.substr(F.col("digits"), F.lit(1), d.of((1, 2, 3, 4)))
    issued = d.of((
        F.concat(F.lit("AKIA"), F.upper(_first("plain", 16))), F.concat(F.lit("ASIA"), F.upper(_first("plain", 16))), F.concat(F.lit("ghp_"), _first("plain", 36)), F.concat(d.of(("sk_live_", "rk_live_", "sk_test_")), d.cut("plain", 24, 40)),
        F.concat(F.lit("xoxb-"), _first("digits", 11), F.lit("-"), _first("plain", 24)), F.concat(F.lit("AIza"), _first("plain", 35)), F.concat(F.lit("glpat-"), _first("plain", 20)),
        F.concat(F.lit("eyJ"), d.cut("plain", 17, 40), F.lit(".eyJ"), d.cut(F.reverse("plain"), 20, 80), F.lit("."), F.right("plain", F.lit(43))),
    ))
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.regexp_replace(F.concat("base64", F.reverse("base64")), r"(.{64})", "$1\n"), F.lit("\n-----END RSA PRIVATE KEY-----"))
    return [
        (1.0, _PLANTED_NAMES, digest, "hexadecimal key"),
        (1.0, _PLANTED_NAMES, d.cut("plain", 16, 64), "key of letters and digits"),
        (1.0, _PLANTED_NAMES, d.cut("base64", 24, 88), "base64 key"),
        (1.0, _PLANTED_NAMES, issued, "issued key under a name"),
        (1.0, (), issued, "issued key in prose"),
        (1.0, _PLANTED_NAMES, d.cut("plain", 8, 15), "short random password"),
        (1.0, ("password", "passwd", "db_password", "pwd", "passphrase"), F.concat(name, d.of(("!", "#", "@", "$", "_", "")), few, d.of(("!", "?", "x", ""))), "password from a word"),
        (1.0, _PLANTED_NAMES, uuid, "uuid as a secret"),
        (1.0, (), d.cut("plain", 32, 64), "random token in prose"),
        (1.0, (), block, "private key block"),
        (0.0, _DIGEST_NAMES, digest, "digest"),
        (0.0, (), digest, "digest in prose"),
        (0.0, _ID_NAMES, uuid, "uuid"),
        (0.0, (), uuid, "uuid in prose"),
        (0.0, _ID_NAMES, d.cut("digits", 16, 24), "number"),
        (0.0, (), d.cut("digits", 16, 24), "number in prose"),
        (0.0, (), F.concat(d.of(("mail.", "www.", "api.", "mail7.")), host), "host"),
        (0.0, ("url", "href", "src", "auth_url", "endpoint"), F.concat(F.lit("https://"), host, F.lit("/"), known, F.lit("/"), other, d.of(("", ".html", ".php", "/index.html"))), "address"),
        (0.0, (), F.concat(d.of(("/usr/lib/", "/home/", "src/", "./")), known, F.lit("/"), known2, d.of(("_", "-", "/", "")), name, d.of((".py", ".so", ".txt", ".java", ""))), "path"),
        (0.0, (), F.concat(known, d.of(("_", "-", ".", "")), F.initcap(known2), d.of(("_", ".", "")), F.initcap(known3), F.initcap(name)), "identifier"),
        (0.0, (), F.substr(F.concat(F.regexp_replace(d.word(), r"[^\p{L}]", ""), longest), F.lit(1), d.of((16, 17, 18, 20, 24))), "long word"),
        (0.0, (), F.upper(F.substr(F.concat(longest, name), F.lit(1), d.of((16, 18, 22)))), "long word in capitals"),
        (0.0, (), F.concat(name, other, d.of((".", "!", "-")), few), "word and number"),
        (0.0, _PLANTED_NAMES, d.of((F.concat(F.lit("your_"), known, F.lit("_here")), "changeme", "xxxxxxxxxxxxxxxx", "<redacted>", "****************", F.concat(F.lit("${"), F.upper(known), F.lit("_TOKEN}")), "undefined", "required", "placeholder", F.concat(F.lit("example_"), known), F.concat(F.lit("get"), F.initcap(known), F.lit("Token()")), "os.environ.get(", F.concat(F.lit("settings."), known, F.lit(".token")))), "placeholder"),
        (0.0, _PLANTED_NAMES, F.concat(name, d.of(("", ",", ".", ")"))), "word after a name of a secret"),
        (0.0, _BENIGN_SECRET_NAMES, d.of((F.concat(known, F.lit("_"), known2), F.concat(known, F.lit("-"), known2, F.lit("_v2")), d.cut("digits", 6, 8), F.concat(F.lit("https://"), host, F.lit("/oauth2/token")))), "value that is no secret"),
        (0.0, ("data:image/png;base64,", "icon", "image", "src"), F.concat(F.lit("iVBORw0KGgo"), d.cut("base64", 40, 120)), "image data"),
        (0.0, _ID_NAMES, F.concat(F.lit("20"), _first("digits", 2), F.lit("-0"), _first("digits", 1), F.lit("-1"), _first("digits", 1), F.lit("T0"), _first("digits", 1), F.lit(":15:30.000Z")), "time"),
        (0.0, (), F.concat(F.lit("1."), _first("digits", 2), F.lit(".0-beta."), _first("digits", 1), F.lit("+build."), _first("digits", 5)), "version"),
    ]


def lessons(docs: DataFrame, findings: int = FIT_FINDINGS, seed: int = 1) -> DataFrame:
    """value, before, near, label, what, fold: planted secrets and look-alikes, found again in the corpus' passages. docs: text.

    A passage is a dozen or so words of a document, from a place drawn by hash.
    """
    told = docs.where(F.length("text") > 0)
    n = told.count()
    if not n:
        return docs.sparkSession.createDataFrame([], "value string, before string, near string, label double, what string, fold int")
    each = -(-findings // n)
    hashed = F.xxhash64(F.lit(seed), "text")
    drawn = told.where(F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30) < min(1.0, findings / n)).dropDuplicates(["text"])
    at = F.pmod(F.shiftright(hashed, 7), F.greatest(F.length("text") - 200, F.lit(1)).cast("long")).cast("int") + 1
    passages = drawn.select(F.substr("text", at, F.lit(200)).alias("passage"), hashed.alias("hash")).withColumn("words", F.filter(F.split("passage", r"\s+"), lambda w: F.length(w).between(1, 15)))
    rows = passages.select("words", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("copy"), "hash").withColumn("key", F.concat_ws(":", "hash", "copy"))
    d = _Draw(seed * 10_000)
    rows = stage(rows.select("key", "words", *[c.alias(name) for name, c in d.materials().items()]), "materials").withColumn("plain", F.regexp_replace("base64", "[+/=]", ""))
    kinds = _planted(d)
    sign = d.of(_SIGNS)
    lead = lambda names: F.concat(d.of(names), F.col("sign")) if names else F.concat(d.of((*_PROSE, d.word(), "")), d.of((" ", " ", "\n", ' "', " (")))
    plants = [F.struct(F.lit(label).alias("label"), lead(names).alias("lead"), value.alias("value"), F.lit(what).alias("what")) for label, names, value, what in kinds]
    # one secret for each look-alike
    of_label = lambda wanted: F.element_at(F.array(*[p for p, k in zip(plants, kinds, strict=True) if k[0] == wanted]), d.number(sum(k[0] == wanted for k in kinds)) + 1)
    made = rows.withColumn("sign", sign).withColumn("plant", F.when(d.number(2) == 1, of_label(1.0)).otherwise(of_label(0.0)))
    cut = d.number(8) + 4
    close = F.when(F.col("plant.lead").rlike("\"$"), F.lit('"')).when(F.col("plant.lead").rlike("'$"), F.lit("'")).otherwise(d.of(("", "", ".", ",")))
    text = F.concat(F.array_join(F.slice("words", 1, 12), " "), F.lit(" "), "plant.lead", "plant.value", close, F.lit(" "), F.array_join(F.slice("words", cut, 8), " "))
    texts = stage(made.select(F.xxhash64("key").alias("doc_id"), "plant.label", "plant.what", F.col("plant.value").alias("planted"), text.alias("text")).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id"]), "lessons")
    found = candidates(texts).join(texts.select("doc_id", "label", "what", "planted"), "doc_id")
    own = F.col("planted").contains(F.col("value")) | F.col("value").contains(F.col("planted"))
    whole = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("value"))))
    best = found.where(own).withColumn("order", whole).where("order = 1")
    return best.select("value", "before", "near", "label", "what", F.pmod(F.col("doc_id"), F.lit(5)).cast("int").alias("fold"))


# ---- the forest --------------------------------------------------------------------------------------------------------


class Judge:
    """A forest with what it needs to look at findings."""

    def __init__(self, corpus: Corpus, labelled: DataFrame, seed: int = 1):
        """``labelled``: value, before, near, label (1: secret). Without findings of both kinds there is no forest."""
        self.corpus = corpus
        rows = stage(labelled.select("value", "before", "near", "label"), "labelled")
        self.kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
        self.forest = None
        if self.kinds.keys() == {0.0, 1.0}:
            self.odds = small(stage(odds(rows), "odds"))  # words near at most FIT_FINDINGS findings
            weight = F.when(F.col("label") == 1, 1.0 / self.kinds[1.0]).otherwise(1.0 / self.kinds[0.0])
            looked = stage(self.features(rows).withColumn("weight", weight * sum(self.kinds.values()) / 2).select("label", "weight", *_FEATURES), "looked")
            forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featuresCol="features", labelCol="label", weightCol="weight")
            self.forest = forest.fit(self._assembled(looked))

    def features(self, findings: DataFrame) -> DataFrame:
        return with_odds(self.corpus.features(findings), self.odds)

    def _assembled(self, looked: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(looked)

    def score(self, findings: DataFrame) -> DataFrame:
        """``findings`` with score, the forest's probability that the value is a secret."""
        if self.forest is None:
            return findings.withColumn("score", F.lit(0.0))
        scored = self.forest.transform(self._assembled(self.features(findings)))
        return scored.withColumn("score", F.element_at(vector_to_array("probability"), 2)).select(*findings.columns, "score")


def train(docs: DataFrame, labelled: DataFrame | None = None) -> Judge:
    """From labelled findings, or from the training folds of ``lessons``."""
    return Judge(Corpus(docs), labelled if labelled is not None else lessons(docs).where("fold > 0"))


def quality(docs: DataFrame, least: float = 0.5) -> dict[str, float]:
    """precision and recall on the held-out lessons, of a forest that hasn't seen them, and n, their number."""
    taught = stage(lessons(docs), "taught")
    scored = Judge(Corpus(docs), taught.where("fold > 0")).score(taught.where("fold = 0"))
    hit, said = (F.col("label") == 1) & (F.col("score") >= least), F.col("score") >= least
    r = scored.agg(F.count_if(hit).alias("hit"), F.count_if(said).alias("said"), F.sum("label").alias("there"), F.count("*").alias("n")).first()
    return {"precision": r["hit"] / max(1, r["said"]), "recall": r["hit"] / max(1, r["there"] or 0), "n": r["n"]}


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, value, place, before, near, score for every candidate of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = stage(candidates(rows), "candidates")
    return train(rows, labelled).score(found)


def result(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, place, length, value_sha256, score, secret: every candidate and whether it stays after the forest."""
    return scan(docs).select("doc_id", "place", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 9).alias("score"), (F.col("score") >= least).alias("secret"))


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` masked, and n_chars, where there is such a column, counted anew for those texts."""
    secrets = scan(docs).where(F.col("score") >= least).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    # longer values first, so that none is masked in part
    per = secrets.agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("value").alias("n"), "value")))).alias("__secrets"))
    per = small(stage(per, "secrets"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    clean = F.aggregate("__secrets", F.col("text"), lambda text, s: F.replace(text, s["value"], F.lit(MASK)))
    masked = docs.join(per, same, "left").withColumn("text", F.when(F.col("__secrets").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("__secrets").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)
