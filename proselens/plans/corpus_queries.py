"""Queries for sources and sinks: the tables take the shape of each source, are written, read back and cleaned."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Model
from ..scratch import new_folder, table
from ..sources import corpora as C
from . import sql as S
from .text_queries import _detok_sql, _html_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


@query("s1_jsonl", "SELECT doc_id, text, source FROM documents")
def jsonl(s: SparkSession, d: str) -> DataFrame:
    _docs(s, d).select("doc_id", "text", "source").write.json(path := new_folder(s, "jsonl"))
    return C.read_jsonl(s, path, "doc_id long, text string, source string")


@query("s2_json_array", "SELECT lang AS genre, text FROM documents")
def json_array(s: SparkSession, d: str) -> DataFrame:
    """Each array is a file of about a hundred texts, dealt by a hash of the id."""
    one = F.to_json(F.struct(F.col("lang").alias("genre"), "text"))
    docs = _docs(s, d)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // 100))).alias("part")
    files = docs.groupBy(part).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value"))
    path = new_folder(s, "arrays")
    files.write.partitionBy("part").text(path)
    return C.read_json_array(s, f"{path}/*")


def _raid(s: SparkSession, d: str) -> DataFrame:
    attack = F.when(F.col("doc_id") % 7 == 0, "swap").otherwise("none")
    domain = F.when(F.col("doc_id") % 5 == 0, "poetry").otherwise(F.col("lang"))
    return _docs(s, d).select(F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source_id"), F.col("lang").alias("model"), domain.alias("domain"), attack.alias("attack"), F.col("text").alias("generation"), "doc_id")


@query("s3_raid_rows", f"SELECT 'raid' AS src, lang AS domain, lang AS model, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS \"group\", {S.trim('text')} AS text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND {S.words('text', False)} >= 40")
def raid(s: SparkSession, d: str) -> DataFrame:
    _raid(s, d).write.parquet(path := new_folder(s, "raid"))
    return C.raid_rows(s.read.schema(C.RAID_IN).parquet(path))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
_ANSWER = f"{S.words('a', False)} >= 25"


def _qa_joined(x: str) -> str:
    last = rf"{S.WS}+'{S.WS}*([\p{{L}}\p{{N}}_])"
    return f"(SELECT {S.trim(f'''CASE WHEN contains(z, ' '' ') THEN regexp_replace(z, {S.q(last)}, {S.q(chr(39) + chr(92) + '1')}, 'g') ELSE z END''')} FROM (SELECT {_detok_sql(x)} AS z))"


@query("s4_qa_rows", f"""WITH l AS (SELECT source AS q, doc_id, unnest({_LINES}) AS a FROM documents),
k AS (SELECT q, a, doc_id % 2 AS label FROM l WHERE {_ANSWER}), z AS (SELECT q, label, a, {_detok_sql('a')} AS z FROM k)
SELECT q AS question, CASE label WHEN 0 THEN {S.trim(f"CASE WHEN contains(z, ' '' ') THEN regexp_replace(z, {S.q(rf"{S.WS}+'{S.WS}*([{chr(92)}p{{L}}{chr(92)}p{{N}}_])")}, {S.q(chr(39) + chr(92) + '1')}, 'g') ELSE z END")} ELSE {S.trim('a')} END AS text, 'set' AS source, label::INT AS label FROM z""")
def qa(s: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    side = lambda k: F.when(F.col("doc_id") % 2 == k, lines).otherwise(F.array().cast("array<string>"))
    rows = _docs(s, d).select(F.col("source").alias("question"), side(0).alias("human_answers"), side(1).alias("chatgpt_answers"), F.lit("set").alias("source"))
    rows.write.json(path := new_folder(s, "qa"))
    return C.qa_rows(C.read_jsonl(s, path, C.QA))


_SINCE = "(doc_id * 9973)"


@query("s5_comment_rows", f"WITH c AS (SELECT {_html_sql(f'''text || '<p>&lt;b&gt; &amp;amp; <i>end</i>' ''')} AS text, {_SINCE} AS t FROM documents) SELECT text FROM c WHERE t > 0 AND t < 14 * 26 * 86400 AND t % (26 * 86400) BETWEEN 1 AND 86399 AND {S.words('text', False)} BETWEEN 40 AND 600")
def comments(s: SparkSession, d: str) -> DataFrame:
    hit = F.struct(F.concat("text", F.lit("<p>&lt;b&gt; &amp;amp; <i>end</i>")).alias("comment_text"), (F.col("doc_id") * 9973 + 1_514_764_800).alias("created_at_i"))
    _docs(s, d).select(F.array(hit).alias("hits")).write.json(path := new_folder(s, "dump"))
    return C.comment_rows(C.read_jsonl(s, path, C.DUMP), 1_514_764_800, 26, 14, 40, 600)


_HEAD, _TAIL = "head\n*** START OF BOOK ***\n", "\n*** END OF BOOK ***\nCHAPTER"
_PARAS = f"regexp_split_to_array(substr(w, strpos(w, '*** START OF') + strpos(substr(w, strpos(w, '*** START OF')), chr(10)) - 1, strpos(w, '*** END OF') - (strpos(w, '*** START OF') + strpos(substr(w, strpos(w, '*** START OF')), chr(10)) - 1)), {S.q(chr(92) + 'r?' + chr(92) + 'n' + S.WS + '*' + chr(92) + 'r?' + chr(92) + 'n')})"


@query("s6_book_paragraphs", f"WITH b AS (SELECT doc_id AS title, {S.q(_HEAD)} || replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) || {S.q(_TAIL)} AS w FROM documents), p AS (SELECT title, {_PARAS} AS p FROM b), "
       f"u AS (SELECT title, unnest(range(len(p)))::INT AS para_no, unnest(list_transform(p, lambda x: {S.trim(f'regexp_replace(x, {S.q(S.WS + chr(43))}, chr(32), {S.q(chr(103))})')})) AS text FROM p) SELECT title, para_no, text FROM u WHERE {S.words('text', False)} BETWEEN 60 AND 400 AND NOT regexp_matches(text, {S.q(C.BOOK_JUNK)})")  # fmt: skip
def books(s: SparkSession, d: str) -> DataFrame:
    book = F.concat(F.lit(_HEAD), F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n")), F.lit(_TAIL))
    return C.book_paragraphs(_docs(s, d).select(F.col("doc_id").alias("title"), book.alias("text")))


@query("s7_images", "SELECT count(*) AS n, sum(least(octet_length(encode(t)), 196608))::BIGINT AS bytes FROM (SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY doc_id // 100)")
def images(s: SparkSession, d: str) -> DataFrame:
    """A file for every hundred ids, so that no file grows with a source; only the heads are kept."""
    path = new_folder(s, "images")
    rows = _docs(s, d).select(F.expr("doc_id div 100").alias("part"), "text", "doc_id")
    rows.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    heads = C.read_images(s, path).where(F.col("path").rlike(r"part-[^/]*$"))
    return heads.agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query("s8_heldout", "SELECT source AS \"set\", quality AS label, text FROM documents JOIN labels USING (doc_id)")
def heldout(s: SparkSession, d: str) -> DataFrame:
    rows = _docs(s, d).join(table(s, d, "labels"), "doc_id").select(F.col("source").alias("set"), F.col("quality").alias("label"), "text")
    C.write_heldout(rows, path := new_folder(s, "heldout"))
    return C.read_heldout(s, path)


@query("s9_model", "SELECT (n_chars % 4096)::INT AS bucket, count(*) AS n, ((n_chars % 4096) * 7919 % 255 - 127)::INT AS w FROM documents GROUP BY ALL")
def model(s: SparkSession, d: str) -> DataFrame:
    """A model is saved and loaded; the documents' lengths then look weights up in it."""
    made = Model(((np.arange(4096) * 7919) % 255 - 127).astype(np.int8), 0.01, 0.5, 12, {"strict": 0.3})
    C.save_model(s, made, path := new_folder(s, "model"))
    loaded = C.load_model(s, path)
    weights = F.array(*[F.lit(int(w)) for w in loaded.weights])
    counts = _docs(s, d).groupBy((F.col("n_chars") % 4096).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.select("bucket", "n", F.element_at(weights, F.col("bucket") + 1).alias("w"))


@query("s10_corpus", "SELECT source AS src, count(*) AS n FROM documents GROUP BY source")
def corpus(s: SparkSession, d: str) -> DataFrame:
    return C.write_corpus(_docs(s, d).select(F.col("source").alias("src"), "text"), new_folder(s, "corpus"))
