"""Queries for the text functions and the tells, with oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, tells, text
from ..scratch import spread, table
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a planted text at the end of each."""
    added = F.element_at(F.array(*[F.lit(p) for p in S.PLANTED]), (F.col("doc_id") % len(S.PLANTED) + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), added).alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``planted``, but a quarter of the texts are of even sentences alone."""
    return planted(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(S.PLANTED[-1] + " "), "source")).otherwise(F.col("text")))


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _column(name: str, column, oracle: str, alias: str, source=None) -> None:
    rows = source or _documents
    add(name, lambda s, d: rows(s, d).select("doc_id", column().alias(alias)), oracle)


_C = "SELECT doc_id, {} AS {} FROM documents"
_column("t1_normalize", lambda: text.normalize("text"), _C.format(S.normalize("text"), "normal"), "normal")
_column("t2_count_words", lambda: text.count_words("text").cast("long"), _C.format(S.words("text"), "n_words"), "n_words")
_column("t2_count_words_straight", lambda: text.count_words("text", curly=False).cast("long"), _C.format(S.words("text", False), "n_words"), "n_words")
add("t3_sentences", lambda s, d: planted(s, d).select("doc_id", F.posexplode(text.sentences("text")).alias("no", "sentence")),
    f"WITH {S.PLANTED_SQL}, s AS (SELECT doc_id, {S.sentences('text')} AS s FROM planted) SELECT doc_id, unnest(range(len(s)))::INT AS no, unnest(s) AS sentence FROM s")
add("t4_lines", lambda s, d: planted(s, d).select("doc_id", F.posexplode(text.text_lines("text")).alias("no", "line")),
    f"WITH {S.PLANTED_SQL}, s AS (SELECT doc_id, {S.lines('text')} AS s FROM planted) SELECT doc_id, unnest(range(len(s)))::INT AS no, unnest(s) AS line FROM s")
_column("t5_is_english", lambda: text.is_english("text"), _C.format(S.english("text"), "english"), "english")
_column("t6_model_prep", lambda: text.model_prep("text"), _C.format(S.prep("text"), "prepared"), "prepared")

_SPLIT = " Should n't we go , said ( the man ) - you 're well - known . \" quoted words \" and ' s it ."
_letter = r"[\p{L}\p{N}_]"


def _detok_sql(x: str) -> str:
    steps = [(r"(?i) (n't|'s|'re|'ve|'ll|'d|'m)\b", r"\1"), (r" ([.,!?;:%)\]}])", r"\1"), (r"([(\[{$]) ", r"\1"), (rf"({_letter}) - ({_letter})", r"\1-\2"), (r'" ([^"]{1,200}?) "', r'"\1"')]
    for pattern, to in steps:
        x = f"regexp_replace({x}, {S.q(pattern)}, {S.q(to)}, 'g')"
    return x


_last = rf"{S.WS}+'{S.WS}*({_letter})"
add("t7_detokenize", lambda s, d: _documents(s, d).select("doc_id", text.detokenize(F.concat("text", F.lit(_SPLIT))).alias("joined")),
    f"WITH s AS (SELECT doc_id, {_detok_sql(f'text || {S.q(_SPLIT)}')} AS s FROM documents) "
    f"SELECT doc_id, {S.trim(f'''CASE WHEN contains(s, ' '' ') THEN regexp_replace(s, {S.q(_last)}, {S.q(chr(39) + chr(92) + '1')}, 'g') ELSE s END''')} AS joined FROM s")  # fmt: skip


def _html_sql(x: str) -> str:
    x = f"regexp_replace(replace({x}, '<p>', chr(10) || chr(10)), '<[^>]+>', '', 'g')"
    for entity, to in text.ENTITIES:
        x = f"replace({x}, {S.q(entity)}, {S.q(to)})"
    return S.trim(x)


add("t8_strip_html", lambda s, d: table(s, d, "pages").select("page_id", text.strip_html("html").alias("text")), f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
_ESCAPED = '\\n she said \\"yes\\" '
_column("t9_unescape", lambda: text.unescape(F.concat("text", F.lit(_ESCAPED))), _C.format(S.trim(f"replace(replace(text || {S.q(_ESCAPED)}, '\\n', chr(10)), '\\\"', '\"')"), "plain"), "plain")
add("t10_word_bounds", lambda s, d: text.word_bounds(table(s, d, "documents"), 40, 500).select("doc_id", "source"), f"SELECT doc_id, source FROM documents WHERE {S.words('text', False)} BETWEEN 40 AND 500")
add("t11_truncate", lambda s, d: table(s, d, "documents").select("doc_id", text.truncate("text", text.MODEL_CHARS).alias("for_model"), F.length(text.truncate("text", text.OPINION_CHARS)).alias("opinion_chars")),
    f"SELECT doc_id, substr(text, 1, {text.MODEL_CHARS}) AS for_model, length(substr(text, 1, {text.OPINION_CHARS})) AS opinion_chars FROM documents")


def _tells(name: str, find, where: str, source=planted, source_sql: str = S.PLANTED_SQL) -> None:
    """A row for each tell that one rule finds."""

    def query(s: SparkSession, d: str) -> DataFrame:
        rows = source(s, d).select("doc_id", text.normalize("text").alias("text")).withColumn("words", text.count_words("text"))
        return rows.select("doc_id", F.explode(find(F.col("text"), F.col("words"))).alias("t")).select("doc_id", *[F.col(f"t.{c}").alias(c) for c in ("ord", "id", "label", "count", "weight", "sample", "fix")])

    add(name, query, f"WITH {source_sql}, {S.tells_chain()} SELECT doc_id, ord, id, label, count::INT AS count, weight, sample, fix FROM tells WHERE {where}")


_tells("d1_on_sight", lambda t, w: tells.on_sight(t), "id LIKE 'w:%'")
_tells("d2_cluster", lambda t, w: tells.cluster(t), "id = 'cluster'")
_tells("d3_density", tells.density, "id = 'density'")
_tells("d4_intensifiers", tells.intensifiers, "id = 'intensifier'")
_tells("d5_brochure", lambda t, w: tells.brochure(t), "id = 'promo'")
_tells("d6_phrases", lambda t, w: tells.phrases(t), f"ord BETWEEN {tells._PHRASE} AND {tells._DASH - 1}")
_tells("d7_dashes", tells.dashes, "id = 'dash'")
_tells("d8_emoji_bullets", lambda t, w: tells.emoji_bullets(t), "id = 'emoji'")
_tells("d9_bold", lambda t, w: tells.bold(t), "id = 'bold'")
_tells("d10_headings", lambda t, w: tells.headings(t), "id = 'heading'")
_tells("d11_one_line_paragraphs", lambda t, w: tells.one_line_paragraphs(t), "id = 'broetry'")
_tells("d12_rhythm", lambda t, w: tells.rhythm(t), "id = 'rhythm'", even, S.EVEN_SQL)
_tells("d13_triads", tells.triads, "id = 'triad'")


def analyzed(s: SparkSession, d: str, **options) -> DataFrame:
    return tells.analyze(planted(s, d), **options)


_A = f"WITH {S.PLANTED_SQL}, {S.analysis_chain()}"
add("d14_score", lambda s, d: analyzed(s, d).select("doc_id", "analysis.raw", "analysis.density", F.size("analysis.tells").cast("long").alias("n_tells")), f"{_A} SELECT doc_id, raw, density, n_tells FROM analysis")
for _sensitivity in ("gentle", "strict"):
    add(f"d15_verdict_{_sensitivity}", lambda s, d, x=_sensitivity: analyzed(s, d, sensitivity=x).select("doc_id", "analysis.verdict"), f"WITH {S.PLANTED_SQL}, {S.analysis_chain(sensitivity=_sensitivity)} SELECT doc_id, verdict FROM analysis")
add("d16_gate", lambda s, d: analyzed(s, d).select("doc_id", F.col("analysis.words").cast("long").alias("words"), "analysis.skipped"), f"{_A} SELECT doc_id, words, skipped FROM analysis")
add("d17_rank_tells", lambda s, d: analyzed(s, d).select("doc_id", F.posexplode(F.slice("analysis.tells", 1, 6)).alias("rank", "t")).select("doc_id", "rank", F.col("t.id").alias("id"), F.col("t.weight").alias("weight")),
    f"{_A}, r AS (SELECT doc_id, id, weight, (row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, ord) - 1)::INT AS rank FROM kept) SELECT doc_id, rank, id, weight FROM r WHERE rank < 6")
add("d18_analyze", lambda s, d: analyzed(s, d).select("doc_id", F.col("analysis.words").cast("long").alias("words"), "analysis.raw", "analysis.density", "analysis.verdict", "analysis.skipped", F.transform("analysis.tells", lambda t: t["id"]).cast("string").alias("tells")),
    f"{_A}, i AS (SELECT doc_id, list(id ORDER BY weight DESC, ord) AS ids FROM kept GROUP BY doc_id) "
    "SELECT doc_id, words, raw, density, verdict, skipped, '[' || coalesce(array_to_string(ids, ', '), '') || ']' AS tells FROM analysis LEFT JOIN i USING (doc_id)")  # fmt: skip
_STRICT = f"WITH {S.PLANTED_SQL}, {S.analysis_chain(sensitivity='strict')}"
add("d19_draft_tells", lambda s, d: tells.draft_tells(planted(s, d)).select("doc_id", F.col("n_tells").cast("long").alias("n_tells"), F.array_join("lines", "\n").alias("lines")),
    f"{_STRICT}, i AS (SELECT doc_id, sum(count)::BIGINT AS n, string_agg('“' || sample || '” → ' || fix, chr(10) ORDER BY weight DESC, ord) AS lines FROM kept GROUP BY doc_id) "
    "SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tells, coalesce(lines, '') AS lines FROM analysis LEFT JOIN i USING (doc_id) WHERE words >= 12")  # fmt: skip
_P = "((doc_id * 7919) % 1000) / 1000.0::DOUBLE"


def p_column():
    """A made-up share, from the id."""
    return (F.col("doc_id") * 7919 % 1000) / F.lit(1000.0)


add("d20_reason_line", lambda s, d: analyzed(s, d).withColumn("p", p_column()).select("doc_id", tells.reason_line(F.col("analysis.verdict"), F.col("p"), F.lit(0.3558), F.col("analysis.tells")).alias("reason")),
    f"{_A}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, ord) AS rank FROM kept), i AS (SELECT doc_id, string_agg(label, ' · ' ORDER BY rank) AS why FROM k WHERE rank <= 3 GROUP BY doc_id) "
    f"SELECT doc_id, CASE WHEN verdict <> 'clean' THEN concat_ws(' ', CASE verdict WHEN 'slop' THEN 'slop' ELSE 'maybe slop' END, CASE WHEN {_P} >= 0.3558 THEN floor({_P} * 100 + 0.5)::BIGINT || '% machine' END, why) END AS reason FROM analysis LEFT JOIN i USING (doc_id)")  # fmt: skip

# ---- tokens and features -------------------------------------------------------------------------------------------------

add("m1_tokens", lambda s, d: _documents(s, d).select("doc_id", F.array_join(features.tokens("text"), " ").alias("tokens")), f"SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS tokens FROM documents")
add("m2_fnv1a32", lambda s, d: _documents(s, d).select(F.explode(features.tokens("text")).alias("token")).distinct().select("token", features.fnv1a32("token").alias("fnv")),
    f"WITH t AS (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM documents) SELECT token, {S.fnv('token')} AS fnv FROM t")
FEATURES_SQL = f"""t AS MATERIALIZED (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
k AS MATERIALIZED (SELECT doc_id, unnest(list_concat(list_transform(t, lambda x: 'u' || x), list_transform(range(1, len(t)), lambda i: 'b' || t[i] || ' ' || t[i + 1]))) AS key FROM t),
h AS MATERIALIZED (SELECT key, {S.fnv('key')} & 131071 AS bucket FROM (SELECT DISTINCT key FROM k)),
f AS MATERIALIZED (SELECT DISTINCT doc_id, bucket FROM k JOIN h USING (key))"""
add("m3_hash_features", lambda s, d: _documents(s, d).select("doc_id", features.hash_features("text").alias("f")).select("doc_id", F.array_join(F.transform("f", lambda b: b.cast("string")), ",").alias("buckets")),
    f"WITH {FEATURES_SQL} SELECT d.doc_id, coalesce(string_agg(bucket::VARCHAR, ',' ORDER BY bucket), '') AS buckets FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id")
