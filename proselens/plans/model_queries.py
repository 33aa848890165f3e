"""Queries for the model, splits, samples and evaluation, with oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import fold, hash_features, to_vectors
from ..functions.text import count_words
from ..operators import evaluation as E
from ..operators import model as M
from ..operators import sampling as P
from ..scratch import materialise, spread, table
from . import sql as S
from .text_queries import _P, FEATURES_SQL, analyzed, p_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def labelled(s: SparkSession, d: str) -> DataFrame:
    """Documents with the label that stands in for the class."""
    return table(s, d, "documents").select("doc_id", "text", "lang", "source").join(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


_L = "labelled AS (SELECT doc_id, text, lang, source, quality AS label FROM documents JOIN labels USING (doc_id))"
SYNTHETIC = M.Model(((np.arange(1 << 17, dtype=np.int64) * 7919) % 255 - 127).astype(np.int8), 0.01, -0.1)
THRESHOLDS = {"gentle": 0.8, "balanced": 0.6, "strict": 0.4}

# ---- model -----------------------------------------------------------------------------------------------------------------


def _vectors(s: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = to_vectors(table(s, d, "documents").select("doc_id", hash_features("text", 12).alias("features")), 12)
    values = vector_to_array("vector")
    return rows.select("doc_id", F.size("features").cast("long").alias("n"), F.round(F.array_max(values), 9).alias("value"))


add("m4_vectors", _vectors, f"WITH {FEATURES_SQL}, g AS (SELECT DISTINCT doc_id, bucket & 4095 AS b FROM f), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n, round(coalesce(1 / sqrt(n), 0), 9) AS value FROM documents d LEFT JOIN n USING (doc_id)")  # fmt: skip


def _fitted(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d).select("doc_id", "label", F.lit(1.0).alias("weight"), hash_features("text").alias("features"))
    rows = materialise(rows, "hashed")  # fitted and scored: hashed once
    model = M.fit(rows, hashed="features", width=M.BITS)
    return rows.select("doc_id", "label", F.round(M.probability("features", model, s), 6).alias("p"))


add("m5_fit", _fitted)
add("m6_balance", lambda s, d: M.balance(labelled(s, d).withColumn("weight", (F.col("doc_id") % 3 + 1).cast("double"))).select("doc_id", "label", F.round("weight", 9).alias("weight")),
    f"WITH {_L}, w AS (SELECT doc_id, label, (doc_id % 3 + 1)::DOUBLE AS w FROM labelled), c AS (SELECT label, sum(w) AS c FROM w GROUP BY label), a AS (SELECT sum(w) AS a FROM w) SELECT doc_id, label, round(w * (a / (2 * c)), 9) AS weight FROM w JOIN c USING (label), a")
add("m7_quantize", lambda s, d: M.quantize_table(table(s, d, "documents").groupBy(F.length("source").alias("k"), "source").agg(F.sum("n_chars").alias("n")).select(F.col("source").alias("bucket"), ((F.col("n") % 1001 - 500) / F.lit(7.0)).alias("weight"))).select("bucket", F.col("q").cast("int").alias("q"), F.round("scale", 9).alias("scale")),
    "WITH w AS (SELECT source AS bucket, (sum(n_chars)::BIGINT % 1001 - 500) / 7.0::DOUBLE AS weight FROM documents GROUP BY source), s AS (SELECT max(abs(weight)) / 127 AS scale FROM w) "
    "SELECT bucket, greatest(least(round_even(weight / scale, 0), 127), -127)::INT AS q, round(scale, 9) AS scale FROM w, s")  # fmt: skip
_SCORE_SQL = f"{FEATURES_SQL}, z AS (SELECT doc_id, sum(bucket * 7919 % 255 - 127) AS s, count(*) AS n FROM f GROUP BY doc_id), p AS (SELECT d.doc_id, coalesce(1 / (1 + exp(-(-0.1::DOUBLE + s * 0.01::DOUBLE / sqrt(n)))), 0.5) AS p FROM documents d LEFT JOIN z USING (doc_id))"
add("m8_probability", lambda s, d: M.score(spread(table(s, d, "documents")).select("doc_id", "text"), SYNTHETIC).select("doc_id", F.round("p", 9).alias("p")), f"WITH {_SCORE_SQL} SELECT doc_id, round(p, 9) AS p FROM p")


def _joined(s: SparkSession, d: str) -> DataFrame:
    weights = s.range(1 << 17).select(F.col("id").cast("int").alias("bucket"), (F.col("id") * 7919 % 255 - 127).alias("w"))
    return M.score_by_join(table(s, d, "documents").select("doc_id", hash_features("text").alias("features")), weights, 0.01, -0.1).select("doc_id", F.round("p", 9).alias("p"))


add("m8_probability_by_join", _joined, f"WITH {_SCORE_SQL} SELECT doc_id, round(p, 9) AS p FROM p")
add("m9_calibrate", lambda s, d: M.calibrate(labelled(s, d).where("label = 0 AND source <> 'src0'").withColumn("p", p_column())).select(*[F.round(k, 9).alias(k) for k in M.BUDGETS]),
    f"WITH {_L} SELECT " + ", ".join(f"round(quantile_cont({_P}, 1 - {v}::DOUBLE), 9) AS {k}" for k, v in M.BUDGETS.items()) + " FROM labelled WHERE label = 0 AND source <> 'src0'")


def decided(s: SparkSession, d: str, rows: Callable = None) -> DataFrame:
    """doc_id, words, p, local (the tells' verdict), and the verdict at each sensitivity. One pass of tells serves all three."""
    from ..functions.tells import verdict

    scored = analyzed(s, d).withColumn("p", p_column()).withColumn("words", count_words("text"))
    kinds = F.size("analysis.tells")
    return scored.select("doc_id", "lang", "source", "text", "words", "p", "analysis", *[M.decide(verdict(F.col("analysis.exact_density"), kinds, k), F.col("p"), F.col("words"), THRESHOLDS, k).alias(k) for k in THRESHOLDS])


def _verdict_sql(k: str) -> str:
    from ..functions.patterns import SENSITIVITY

    slop, suspect = SENSITIVITY[k]
    model = f"(p >= {THRESHOLDS[k]} AND nw >= 40)"
    maybe = f"(p >= {THRESHOLDS['strict']} AND p < {THRESHOLDS[k]} AND nw >= 40)"
    return f"CASE WHEN {model} OR (exact >= {slop} AND n_tells >= 2) THEN 'slop' WHEN {maybe} OR (exact >= {suspect} AND n_tells >= 2) THEN 'suspect' ELSE 'clean' END AS {k}"


_DECIDED = f"{S.PLANTED_SQL}, {S.analysis_chain()}, dd AS (SELECT doc_id, lang, source, {S.words('text')} AS nw, {_P} AS p FROM planted), decided AS (SELECT dd.*, exact, n_tells, {', '.join(_verdict_sql(k) for k in THRESHOLDS)} FROM dd JOIN analysis USING (doc_id))"
add("m10_decide", lambda s, d: decided(s, d).select("doc_id", *THRESHOLDS), f"WITH {_DECIDED} SELECT doc_id, {', '.join(THRESHOLDS)} FROM decided")


def _widths(s: SparkSession, d: str) -> DataFrame:
    rows = P.group_split(labelled(s, d).withColumn("weight", F.lit(1.0)), "source", part=5)
    found = M.compare_bits(rows.where(~F.col("is_test")), rows.where("is_test"), [16, 17, 18])
    return found.groupBy("bits", "label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"))


add("m11_compare_bits", _widths)


def _folded(s: SparkSession, d: str) -> DataFrame:
    hashed = spread(table(s, d, "documents")).select("doc_id", hash_features("text", 18).alias("wide"))
    each = F.array(*[F.struct(F.lit(bits).alias("bits"), fold("wide", bits).alias("f")) for bits in (16, 17, 18)])
    return hashed.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.bits", F.size("x.f").cast("long").alias("n"), F.aggregate("x.f", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


_WIDE_SQL = FEATURES_SQL.replace("& 131071", "& 262143")
add("m11_folded_widths", _folded,
    f"WITH {_WIDE_SQL}, w AS (SELECT doc_id, bits, bucket & ((1 << bits) - 1) AS bucket FROM f, (VALUES (16), (17), (18)) AS x(bits)), c AS (SELECT doc_id, bits, count(DISTINCT bucket) AS n, sum(DISTINCT bucket)::BIGINT AS total FROM w GROUP BY ALL) "
    "SELECT d.doc_id, x.bits, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0)::BIGINT AS total FROM documents d CROSS JOIN (VALUES (16), (17), (18)) AS x(bits) LEFT JOIN c ON c.doc_id = d.doc_id AND c.bits = x.bits")  # fmt: skip


def _sql_probability(s: SparkSession, d: str) -> DataFrame:
    M.register(s, SYNTHETIC)
    return spread(table(s, d, "documents")).select("doc_id", F.round(F.expr("probability(text)"), 9).alias("p"), F.size(F.expr("hash_features(text)")).cast("long").alias("n_features"))


add("m8_sql_probability", _sql_probability, f"WITH {_SCORE_SQL} SELECT p.doc_id, round(p, 9) AS p, coalesce(n, 0)::BIGINT AS n_features FROM p LEFT JOIN z USING (doc_id)")

# ---- splits and samples ------------------------------------------------------------------------------------------------------


def _ticket(*keys: str) -> str:
    return f"md5(concat_ws(':', '0', {', '.join(f'coalesce({k}::VARCHAR, {S.q(str())})' for k in keys)}))"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "source")


add("p1_group_split", lambda s, d: P.group_split(_docs(s, d), "source"),
    f"WITH k AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY {_ticket('source')}, source) <= (SELECT count(*) // 10 FROM k) AS is_test FROM k) SELECT doc_id, lang, d.source, is_test FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source")
add("p2_fraction_split", lambda s, d: P.fraction_split(_docs(s, d), 0.85, "doc_id"),
    f"SELECT doc_id, lang, source, row_number() OVER (ORDER BY {_ticket('doc_id')}, doc_id) <= (SELECT floor(count(*) * 0.85::DOUBLE) FROM documents) AS is_train FROM documents")
add("p3_cell_cap", lambda s, d: P.cell_cap(_docs(s, d), ["source", "lang"], "doc_id", most=5, uncapped=F.col("lang") == "fr"),
    f"WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source, lang ORDER BY {_ticket('doc_id')}, doc_id) AS k FROM documents) SELECT doc_id, lang, source FROM r WHERE lang = 'fr' OR k <= 5")
add("p4_class_cap", lambda s, d: P.class_cap(labelled(s, d).select("doc_id", "label"), "label", "doc_id", {0: 150, 1: 120}),
    f"WITH {_L}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_ticket('doc_id')}, doc_id) AS k FROM labelled) SELECT doc_id, label FROM r WHERE k <= CASE label WHEN 0 THEN 150 ELSE 120 END")
add("p5_family_split", lambda s, d: P.family_split(_docs(s, d), "source", ["src1", "src2"], "doc_id", final=True),
    f"WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY {_ticket('doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) "
    "SELECT doc_id, lang, source, CASE WHEN coalesce(source NOT IN ('src1', 'src2'), true) OR k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'heldout' END AS side FROM r")  # fmt: skip
add("p5_family_unseen", lambda s, d: P.family_split(_docs(s, d), "source", ["src1", "src2"], "doc_id").groupBy("side").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'unseen' ELSE 'train' END AS side, count(*) AS n FROM documents GROUP BY 1")
add("p6_weighted_union", lambda s, d: P.weighted_union([(_docs(s, d).where("lang = 'en'"), 0, 1.0), (_docs(s, d).where("lang = 'fr'"), 0, 2.0), (_docs(s, d).where("lang = 'de'"), 1, 12.0)], ["doc_id", "source"]),
    "SELECT doc_id, source, CASE lang WHEN 'de' THEN 1 ELSE 0 END AS label, CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 2.0 ELSE 12.0 END::DOUBLE AS weight FROM documents WHERE lang IN ('en', 'fr', 'de')")
add("p7_systematic", lambda s, d: P.systematic(_docs(s, d), "source", ["doc_id"], most=7),
    "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, greatest(count(*) OVER (PARTITION BY source) // 7, 1) AS step FROM documents) SELECT doc_id, lang, source FROM r WHERE k % step = 0 AND k / step < 7")
add("p8_page_sample", lambda s, d: P.page_sample(_docs(s, d), "lang", "doc_id", 60),
    f"WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {_ticket('lang', '(doc_id // 100)')}, doc_id) AS k FROM documents) SELECT doc_id, lang, source FROM r WHERE k <= 60")
_GRID = "SELECT DISTINCT {} FROM {}"
add("p9_prompt_grid", lambda s, d: P.prompt_grid(s, table(s, d, "region").select(F.col("r_name").alias("genre")), table(s, d, "nation").select(F.col("n_name").alias("topic")), table(s, d, "documents").select(F.concat(F.lit(" In "), "lang", F.lit(".")).alias("length")).distinct(), 50),
    f"WITH g AS (SELECT r_name AS genre, n_name AS topic, length, 'Write a ' || r_name || ' about ' || n_name || '.' || length AS prompt FROM region, nation, (SELECT DISTINCT ' In ' || lang || '.' AS length FROM documents)) SELECT * FROM g ORDER BY {_ticket('prompt')} LIMIT 50")

# ---- evaluation --------------------------------------------------------------------------------------------------------------


def judged(s: SparkSession, d: str) -> DataFrame:
    tells = F.transform("analysis.tells", lambda t: F.struct(t["label"].alias("label")))
    scored = decided(s, d).withColumns({"n_tells": F.size("analysis.tells").cast("long"), "tells": tells, "text": F.substring("text", 1, E.FLAG_CHARS)})
    scored = materialise(scored.drop("analysis"), "decided")
    return scored.join(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").withColumnRenamed("source", "set")


_J = f"{_DECIDED}, judged AS (SELECT decided.*, quality AS label, source AS \"set\" FROM decided JOIN labels USING (doc_id))"
add("e1_flagged_by_set", lambda s, d: E.flagged_by_set(judged(s, d), {k: k for k in THRESHOLDS}).select("set", "n", *[F.round(k, 6).alias(k) for k in THRESHOLDS]),
    f"WITH {_J} SELECT \"set\", count(*) AS n, {', '.join(f'''round(avg(CASE WHEN {k} = 'slop' THEN 100.0::DOUBLE ELSE 0 END), 6) AS {k}''' for k in THRESHOLDS)} FROM judged GROUP BY \"set\"")
add("e2_model_only", lambda s, d: E.model_only_by_set(judged(s, d), THRESHOLDS).select("set", "n", *[F.round(k, 6).alias(k) for k in THRESHOLDS]),
    f"WITH {_J} SELECT \"set\", count(*) AS n, {', '.join(f'round(avg(CASE WHEN nw >= 40 AND p >= {t} THEN 100.0::DOUBLE ELSE 0 END), 6) AS {k}' for k, t in THRESHOLDS.items())} FROM judged GROUP BY \"set\"")
add("e3_auc", lambda s, d: E.auc(labelled(s, d).withColumn("p", p_column())).select(F.round("auc", 9).alias("auc")),
    f"WITH {_L}, x AS (SELECT {_P} AS p, label FROM labelled), r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM x) "
    "SELECT round(((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)))::DOUBLE, 9) AS auc FROM r")  # fmt: skip


def trained(s: SparkSession, d: str) -> tuple[M.Model, DataFrame]:
    """A model of four fifths of the sources, and the documents of the others. A seventh of the human texts is left to calibrate it."""
    rows = P.group_split(labelled(s, d), "source", part=5)
    rest = P.fraction_split(rows.where("NOT is_test AND label = 0"), 0.85, "doc_id")
    human, machine = rest.where("is_train"), rows.where("NOT is_test AND label = 1")
    return M.train(P.weighted_union([(human, 0, 1.0), (machine, 1, 2.0)], ["doc_id", "text"]), rest.where("NOT is_train")), rows.where("is_test")


def evaluate_model(s: SparkSession, rows: DataFrame, model: M.Model) -> DataFrame:
    """doc_id, set, label, words, p, and the verdict at each sensitivity of the model's thresholds."""
    from ..functions.tells import analyze, verdict

    scored = analyze(M.score(rows, model)).withColumn("words", count_words("text"))
    local = lambda k: verdict(F.col("analysis.exact_density"), F.size("analysis.tells"), k)
    return scored.select("doc_id", F.col("source").alias("set"), "label", "words", "p", *[M.decide(local(k), F.col("p"), F.col("words"), model.thresholds, k).alias(k) for k in model.thresholds])


def _train_evaluate(s: SparkSession, d: str) -> DataFrame:
    model, rows = trained(s, d)
    judged = materialise(evaluate_model(s, rows, model), "judged")
    flagged = E.flagged_by_set(judged.withColumn("set", F.concat_ws(":", "set", "label")), {k: k for k in model.thresholds})
    return flagged.join(F.broadcast(E.auc(judged))).select("set", "n", *[F.round(k, 4).alias(k) for k in model.thresholds], F.round("auc", 6).alias("auc"))  # one row


add("e0_train_evaluate", _train_evaluate)
_SETS = "^src1"
_SHOWN = f"{_J}, reasons AS (SELECT doc_id, string_agg(label, ' · ' ORDER BY weight DESC, ord) AS why FROM kept GROUP BY doc_id)"
_SHOWN_COLUMNS = "j.doc_id, \"set\", p, coalesce(why, '') AS why, replace(substr(t.text, 1, {}), chr(10), ' ') AS excerpt FROM judged j JOIN planted t ON t.doc_id = j.doc_id LEFT JOIN reasons r ON r.doc_id = j.doc_id"
add("e4_misses", lambda s, d: E.misses(judged(s, d), _SETS, verdict="balanced").select("doc_id", "set", "p", "n_tells", "why", "excerpt"),
    f"WITH {_SHOWN} SELECT n_tells, {_SHOWN_COLUMNS.format(E.MISS_CHARS)} WHERE label = 1 AND regexp_matches(\"set\", '{_SETS}') AND balanced <> 'slop'")
add("e5_wrong_flags", lambda s, d: E.wrong_flags(judged(s, d), verdict="balanced").select("doc_id", "set", "p", "why", "excerpt"), f"WITH {_SHOWN} SELECT {_SHOWN_COLUMNS.format(E.FLAG_CHARS)} WHERE label = 0 AND balanced = 'slop'")
add("e6_corpus_sizes", lambda s, d: E.corpus_sizes(labelled(s, d)), f"WITH {_L} SELECT label, count(*) AS n FROM labelled GROUP BY label")
