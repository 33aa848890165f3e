"""Queries for pages, second opinions, settings and image labels, with oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import count_words
from ..operators import pages as B
from ..operators import provenance as V
from ..scratch import materialise, table
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages")


_HOST = "CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(regexp_extract(url, '(?i)^https?://(?:[^@/?#]*@)?([^:/?#]*)', 1)) ELSE '' END"
add("b1_html_blocks", lambda s, d: B.html_blocks(_pages(s, d)))
add("b2_adapters", lambda s, d: _pages(s, d).select("page_id", B.host_of("url").alias("host")).withColumn("site", F.element_at(F.array(*[F.lit(x) for x in _SITES]), (F.col("page_id") % len(_SITES) + 1).cast("int"))).select("page_id", "host", "site", B.adapter_of("site").alias("selector")),
    None)
_SITES = ["x.com", "old.reddit.com", "www.linkedin.com", "m.youtube.com", "news.ycombinator.com", "bsky.app", "www.threads.net", "facebook.com", "example.org", "notx.com"]
_WHEN = " ".join(f"WHEN regexp_matches(site, {S.q(p)}) THEN {S.q(x)}" for p, x in B.ADAPTERS)
ORACLES["b2_adapters"] = f"WITH p AS (SELECT page_id, {_HOST} AS host, list_extract([{', '.join(map(S.q, _SITES))}], 1 + page_id % {len(_SITES)}) AS site FROM pages) SELECT page_id, host, site, CASE {_WHEN} END AS selector FROM p"


def _short(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as short leaves of one parent."""
    words = count_words("text")
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("page_id"), F.lit("h").alias("host"), F.col("turn").cast("int").alias("block_no"), F.lit(0).alias("parent_no"), F.when(words < 40, "short").otherwise("block").alias("kind"), "text", words.cast("int").alias("words"))
    return rows.where("words > 0")


add("b3_merge_short", lambda s, d: B.merge_short(_short(s, d)).select("page_id", "block_no", "text", F.col("words").cast("long").alias("words")),
    f"WITH r AS (SELECT conv_id AS page_id, turn::INT AS block_no, text FROM conversations WHERE {S.words('text')} BETWEEN 1 AND 39), m AS (SELECT page_id, min(block_no) AS block_no, string_agg(text, chr(10) ORDER BY block_no, text) AS text FROM r GROUP BY page_id HAVING count(*) >= 3) "
    f"SELECT page_id, block_no, text, {S.words('text')} AS words FROM m WHERE {S.words('text')} >= 40")  # fmt: skip
add("b4_dedupe_blocks", lambda s, d: B.dedupe_blocks(_short(s, d).withColumn("block_no", F.col("block_no") % 3), _short(s, d).where("page_id % 2 = 0").withColumn("block_no", F.col("block_no") % 3).withColumn("length", F.length("text"))).select("page_id", "block_no", "text"),
    f"WITH r AS (SELECT conv_id AS page_id, (turn % 3)::INT AS block_no, text, {S.words('text')} AS words FROM conversations WHERE {S.words('text')} > 0), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_no ORDER BY words DESC, text) AS k FROM r) "
    "SELECT page_id, block_no, text FROM o WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.page_id % 2 = 0 AND r.page_id = o.page_id AND r.block_no = o.block_no AND length(r.text) = length(o.text))")  # fmt: skip


def _paused(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).where("page_id % 50 = 7").select(B.host_of("url").alias("host")).where("host <> ''").distinct()


_PAUSED = f"paused AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE page_id % 50 = 7 AND {_HOST} <> '')"
add("b5_without_paused", lambda s, d: B.without_paused(_pages(s, d).select("page_id", B.host_of("url").alias("host")), _paused(s, d)),
    f"WITH {_PAUSED}, p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT host, page_id FROM p WHERE host NOT IN (SELECT host FROM paused)")
_V = "CASE doc_id % 5 WHEN 0 THEN 'slop' WHEN 1 THEN 'slop' WHEN 2 THEN 'suspect' ELSE 'clean' END"


def _verdict():
    return F.when(F.col("doc_id") % 5 <= 1, "slop").when(F.col("doc_id") % 5 == 2, "suspect").otherwise("clean")


def _units(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("source").alias("page_id"), _verdict().alias("verdict"), count_words("text").alias("words"))


add("b6_action_state", lambda s, d: _units(s, d).select("doc_id", B.action_state("verdict").alias("blur"), B.action_state("verdict", "label").alias("label")),
    f"SELECT doc_id, CASE {_V} WHEN 'slop' THEN 'blocked' WHEN 'suspect' THEN 'labelled' END AS blur, CASE {_V} WHEN 'clean' THEN NULL ELSE 'labelled' END AS label FROM documents")
add("b7_page_counts", lambda s, d: B.page_counts(_units(s, d), _units(s, d).where("host = 'src3'").select("host").distinct()).select("page_id", "n", "badge"),
    f"WITH c AS (SELECT source AS page_id, count(*) FILTER ({_V} = 'slop') AS n FROM documents GROUP BY source) SELECT page_id, n, CASE WHEN page_id = 'src3' THEN 'off' WHEN n = 0 THEN '' WHEN n > 999 THEN '999+' ELSE n::VARCHAR END AS badge FROM c")


def _opinions(s: SparkSession, d: str) -> DataFrame:
    """Opinions on every third text."""
    answer = F.when(F.col("doc_id") % 2 == 0, "Fully Human").otherwise("AI")
    return table(s, d, "documents").where("doc_id % 3 = 0").groupBy(B.text_hash("text").alias("text_hash")).agg(F.min_by(answer, "doc_id").alias("label"))


_OPINIONS = "opinions AS (SELECT sha256(text) AS text_hash, arg_min(CASE WHEN doc_id % 2 = 0 THEN 'Fully Human' ELSE 'AI' END, doc_id) AS label FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)"
add("b8_to_ask", lambda s, d: B.to_ask(_units(s, d), _opinions(s, d)), f"WITH {_OPINIONS} SELECT DISTINCT sha256(text) AS text_hash, text FROM documents WHERE sha256(text) NOT IN (SELECT text_hash FROM opinions)")
add("b9_apply_opinions", lambda s, d: B.apply_opinions(_units(s, d), _opinions(s, d)).select("doc_id", "final", "state"),
    f"WITH {_OPINIONS}, u AS (SELECT doc_id, {_V} AS verdict, coalesce({_V} = 'slop' AND {S.words('text')} >= 50 AND regexp_matches(label, '(?i)human'), false) AS spared FROM documents LEFT JOIN opinions ON sha256(text) = text_hash) "
    "SELECT doc_id, CASE WHEN spared THEN 'suspect' ELSE verdict END AS final, CASE WHEN spared THEN 'labelled' WHEN verdict = 'slop' THEN 'blocked' WHEN verdict = 'suspect' THEN 'labelled' END AS state FROM u")  # fmt: skip


def _answers(s: SparkSession, d: str) -> DataFrame:
    some = lambda k, x: F.when(F.col("doc_id") % k > 0, x)
    return table(s, d, "documents").select(
        F.col("doc_id").alias("text_hash"), some(2, F.lit("AI")).alias("prediction_short"), some(3, F.col("lang")).alias("headline"), some(4, F.col("source")).alias("detail"), some(5, F.lit(0.5)).alias("fraction_ai"),
        some(6, F.lit(0.25)).alias("fraction_ai_assisted"), some(7, F.lit(0.25)).alias("fraction_human"), F.when(F.col("doc_id") % 8 == 0, "STAGE_FAILED").otherwise("STAGE_SUCCESS").alias("stage"),
    )


add("b10_map_opinions", lambda s, d: B.map_opinions(_answers(s, d)),
    "SELECT doc_id AS text_hash, CASE WHEN doc_id % 2 > 0 THEN 'AI' ELSE '' END AS label, CASE WHEN doc_id % 3 > 0 THEN coalesce(lang, '') ELSE '' END AS headline, CASE WHEN doc_id % 5 > 0 THEN 0.5::DOUBLE ELSE 0 END AS ai, "
    "CASE WHEN doc_id % 6 > 0 THEN 0.25::DOUBLE ELSE 0 END AS assisted, CASE WHEN doc_id % 7 > 0 THEN 0.25::DOUBLE ELSE 0 END AS human, "
    "CASE WHEN doc_id % 8 = 0 THEN CASE WHEN doc_id % 3 > 0 THEN lang WHEN doc_id % 4 > 0 THEN source ELSE 'task failed' END END AS error FROM documents")  # fmt: skip
add("b11_settings", lambda s, d: table(s, d, "documents").select("doc_id", B.merge_settings(F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("action"), F.lit("label"), F.lit("mine"), F.col("lang")))).alias("m")).select("doc_id", F.explode("m").alias("key", "value")),
    "WITH d AS (SELECT doc_id, lang, unnest(['eat', 'sensitivity', 'action', 'images', 'cook', 'opinion', 'mine']) AS key, unnest(['true', 'balanced', 'blur', 'true', 'true', 'off', NULL]) AS value FROM documents) "
    "SELECT doc_id, key, CASE WHEN doc_id % 2 = 0 AND key = 'action' THEN 'label' WHEN key = 'mine' THEN lang ELSE value END AS value FROM d WHERE key <> 'mine' OR doc_id % 2 = 0")  # fmt: skip

# ---- image labels ----------------------------------------------------------------------------------------------------------

_MARKS = ["plain", "xmp compositeWithTrainedAlgorithmicMedia", "jumb trainedAlgorithmicMedia", "trainedAlgorithmicMedia", "parameters\0a cat, Steps: 20, Sampler: Euler", 'workflow\0{"class_type": 1}', "C2PA Adobe Firefly Imagen", "cai: camera", "prompt\0 nothing", "Midjourney"]


def _images(s: SparkSession, d: str) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("doc_id") % len(_MARKS) + 1).cast("int"))
    url = F.concat(F.when(F.col("doc_id") % 9 == 0, "data:").otherwise("https://h/"), (F.col("doc_id") % 300).cast("string"))
    return table(s, d, "documents").select("doc_id", F.encode(F.concat(mark, F.lit("\n"), "text"), "UTF-8").alias("content"), url.alias("url"), (F.col("doc_id") * 7 % 500).alias("width"), (F.col("doc_id") * 11 % 500).alias("height"))


_MARK_SQL = ", ".join(" || chr(0) || ".join(S.q(part) for part in m.split("\0")) for m in _MARKS)
_SCAN = f"""WITH t AS (SELECT doc_id, list_extract([{_MARK_SQL}], 1 + doc_id % {len(_MARKS)}) || chr(10) || text AS s FROM documents),
m AS (SELECT *, regexp_matches(s, '(?i)c2pa|jumb|cai:') AS c, coalesce({', '.join(f"CASE WHEN contains(s, {S.q(g)}) THEN {S.q(g)} END" for g in V.GENERATORS)}) AS g,
  strpos(s, 'parameters' || chr(0)) AS a, strpos(s, 'Steps: ') AS b, strpos(s, 'Sampler:') AS e, greatest(strpos(s, 'workflow' || chr(0)), strpos(s, 'prompt' || chr(0))) AS w, strpos(s, '"class_type"') AS k FROM t)
SELECT doc_id, CASE WHEN contains(s, 'compositeWithTrainedAlgorithmicMedia') THEN 'partly generated' WHEN contains(s, 'trainedAlgorithmicMedia') OR (a > 0 AND b BETWEEN a AND a + 4011 AND e BETWEEN b AND b + 410) OR (w > 0 AND k BETWEEN w AND w + 209) OR (c AND g IS NOT NULL) THEN 'generated'
  WHEN c THEN 'content credentials' ELSE 'no label' END AS kind,
 CASE WHEN contains(s, 'rainedAlgorithmicMedia') THEN CASE WHEN c THEN 'c2pa' ELSE 'iptc' END WHEN a > 0 AND b BETWEEN a AND a + 4011 AND e BETWEEN b AND b + 410 THEN 'stable diffusion metadata' WHEN w > 0 AND k BETWEEN w AND w + 209 THEN 'comfyui metadata'
  WHEN c AND g IS NOT NULL THEN 'c2pa · ' || g WHEN c THEN 'c2pa' ELSE '' END AS source FROM m"""
add("v1_scan", lambda s, d: _images(s, d).select("doc_id", V.scan("content").alias("x")).select("doc_id", "x.ai", "x.kind", "x.source"), f"SELECT doc_id, kind IN ('partly generated', 'generated') AS ai, kind, source FROM ({_SCAN})")
_W, _H = "(doc_id * 7 % 500)", "(doc_id * 11 % 500)"
add("v2_size_gate", lambda s, d: V.size_gate(_images(s, d)).select("doc_id", "width", "height"), f"SELECT doc_id, {_W} AS width, {_H} AS height FROM documents WHERE {_W} >= 200 AND {_H} >= 200 AND doc_id % 9 <> 0")
add("v3_once", lambda s, d: V.once(_images(s, d)).select("url"), "SELECT DISTINCT CASE WHEN doc_id % 9 = 0 THEN 'data:' ELSE 'https://h/' END || (doc_id % 300) AS url FROM documents")
