"""Worked examples of rules, features, model, pages, provenance and sampling."""

import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proselens.functions import features, patterns, rule_index, tells, text
from proselens.operators import model as M
from proselens.operators import pages, provenance, sampling
from proselens.scratch import new_folder
from proselens.sources import corpora

SAMPLES = os.environ.get("STYLE_SAMPLES", "")  # a JSON array of machine-written texts


def analysed(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["analysis"] for r in tells.analyze(df, **options).orderBy("id").collect()]


def test_disclaimers_are_named(spark):
    (a,) = analysed(spark, "As an AI language model, I don't have personal opinions. I hope this helps with all of your questions today!")
    assert a["verdict"] == "slop" and {t["label"] for t in a["tells"]} >= {"model disclaimer", "chatbot tic"}


def test_plain_short_foreign_and_null(spark):
    plain = "Of course, we left late — the bus was full and it rained the whole way, so nobody talked much until we reached the coast."
    german = "Dies ist ein deutscher Text über größere Häuser, für ältere Bürger, mit süßen Äpfeln, öfter übermäßig schön."
    found = analysed(spark, plain, "two words", german, None, "")
    assert [a["verdict"] for a in found] == ["clean"] * 5
    assert found[3]["words"] == 0 and found[3]["tells"] == []


def test_every_tell_has_sample_and_fix(spark):
    (a,) = analysed(spark, "We delve into this robust tapestry. Moreover, we harness and foster innovation. In conclusion, the future is bright for everyone here.")
    assert len(a["tells"]) >= 4 and all(t["sample"] and t["fix"] for t in a["tells"])


@pytest.mark.skipif(not os.path.isfile(SAMPLES), reason="needs the samples")
def test_most_samples_are_flagged(spark):
    rows = corpora.read_json_array(spark, SAMPLES)
    verdicts = [r[0] for r in tells.analyze(rows).select("analysis.verdict").collect()]
    assert verdicts.count("slop") >= 0.85 * len(verdicts)


def test_boundaries_are_ascii():
    rule = re.compile(patterns.java(r"\bdelve\b").replace(r"\x{", "\\x{"))
    assert len(rule.findall("édelve delveé delve _delve")) == 3


def _example(pattern):
    """A text that a rule matches: optional parts gone, first alternatives, first characters of classes."""
    from re import _parser

    def walk(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "BRANCH":
                out += walk(arg[1][0])
            elif name == "SUBPATTERN":
                out += walk(arg[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                out += walk(arg[2]) * max(arg[0], 0)
            elif name == "IN":
                first = next((x for x in arg if str(x[0]) != "NEGATE"), arg[0])
                kind = str(first[0])
                out += "x" if str(arg[0][0]) == "NEGATE" else chr(first[1]) if kind == "LITERAL" else chr(first[1][0]) if kind == "RANGE" else {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "1"}.get(str(first[1]), "x")
            elif name in ("ANY", "NOT_LITERAL"):
                out += "x"
        return out

    return walk(_parser.parse(pattern))


@pytest.mark.parametrize("rule", patterns.ON_SIGHT + patterns.PHRASES, ids=lambda r: r.id)
def test_stems_are_needed(rule):
    """A text that a rule matches holds a stem of the rule, or the rule has none."""
    kept = patterns.stems(rule.pattern)
    assert all(s == s.lower() and s for s in kept)
    example = _example(rule.pattern)
    if re.search(rule.pattern, example, re.IGNORECASE):
        assert not kept or any(s in example.lower() for s in kept)


def test_bait_emoji_needs_a_word_before(spark):
    df = spark.createDataFrame([("x♻️",), ("♻️ x",)], "t string")
    counts = [r[0] for r in df.select(F.regexp_count("t", F.lit(patterns.java(next(p for p in patterns.PHRASES if p.id == "bait").pattern)))).collect()]
    assert counts == [1, 0]


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, World 2024!\n🚀 Go",), (None,)], "t string")
    found = [r[0] for r in df.select(features.tokens("t")).collect()]
    assert found == [["hello", ",", "world", "0", "!", "¶", "EMO", "go"], []]


def test_fnv_goldens(spark):
    assert features.fnv1a(["", "a", "foobar"]).tolist() == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string")
    assert [r[0] for r in df.select(features.fnv1a32("t")).collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=20))
def test_fnv_is_plain_fnv(strings):
    def slow(s):
        h = 0x811C9DC5
        for b in s.encode():
            h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
        return h

    strings = [s.encode("utf-8", "ignore").decode() for s in strings]
    assert features.fnv1a(strings).tolist() == [slow(s) for s in strings]


def test_probe_features(spark):
    probe = "It's not just a tool — it's a game-changer. Let's dive in!\nHere's why."
    df = spark.createDataFrame([(probe,)], "t string")
    assert len(df.select(features.hash_features("t")).first()[0]) == 34


def test_model_round_trip_and_width(spark):
    weights = np.arange(-128, 128).clip(-127, 127).astype(np.int8)
    model = M.Model(weights, 0.5, -0.25, 8, {"strict": 0.4}, {"human": 1, "machine": 2})
    corpora.save_model(spark, model, path := new_folder(spark, "m"))
    loaded = corpora.load_model(spark, path)
    assert (loaded.weights == weights).all() and (loaded.scale, loaded.bias, loaded.thresholds) == (0.5, -0.25, {"strict": 0.4})
    with pytest.raises(ValueError):
        M.Model(weights, 1.0, 0.0, 9)


def test_fit_tells_classes_apart(spark):
    rows = [(k, f"we delve into the tapestry number {k} of it" if k % 2 else f"the bus came late on day {k} again", k % 2, 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label int, weight double")
    scored = M.score(df, M.fit(df, bits=10, most_steps=20)).collect()
    assert all((r["p"] > 0.5) == bool(r["label"]) for r in scored)
    empty = spark.createDataFrame([("",)], "text string")
    assert M.score(empty, M.Model(np.ones(1024, np.int8), 1.0, 3.0, 10)).first()["p"] == 0.5


def test_decide_abstains_below_forty_words(spark):
    df = spark.createDataFrame([("clean", 0.9, 39), ("clean", 0.9, 40), ("suspect", None, 50), ("clean", 0.5, 50)], "v string, p double, w int")
    verdict = M.decide(F.col("v"), F.col("p"), F.col("w"), {"balanced": 0.6, "strict": 0.4})
    assert [r[0] for r in df.select(verdict).collect()] == ["clean", "slop", "suspect", "suspect"]


def test_provenance(spark):
    cases = [b"", b"xx compositeWithTrainedAlgorithmicMedia", b"jumb..OpenAI", b"c2pa camera", b"parameters\0cat\nSteps: 20, Sampler: Euler", b'prompt\0{"class_type": 1}']
    df = spark.createDataFrame([(bytearray(c),) for c in cases], "content binary")
    found = [tuple(r[0]) for r in df.select(provenance.scan("content")).collect()]
    assert found == [
        (False, "no label", ""), (True, "partly generated", "iptc"), (True, "generated", "c2pa · OpenAI"), (False, "content credentials", "c2pa"),
        (True, "generated", "stable diffusion metadata"), (True, "generated", "comfyui metadata"),
    ]


def test_blocks(spark):
    long = "word " * 45
    html = f"<nav><p>{long}</p></nav><article><p>{long}<p>{long}<br>end</article><div>" + "".join(f"<p>short line {k} of some few words that go on and on here</p>" for k in range(5)) + "</div>"
    pages_df = spark.createDataFrame([(1, "https://example.org/a", html), (2, "ftp://x", "<li>few"), (3, None, None)], "page_id long, url string, html string")
    rows = pages.html_blocks(pages_df).collect()
    assert sorted((r["page_id"], r["kind"]) for r in rows) == [(1, "block"), (1, "block"), (1, "merged")]
    assert any(r["text"].endswith("\nend") for r in rows)


def test_adapters_and_hosts(spark):
    df = spark.createDataFrame([("https://old.reddit.com/r",), ("http://notx.com/",), ("file:///x",), (None,)], "url string")
    rows = df.select(pages.host_of("url").alias("h")).select("h", pages.adapter_of("h").alias("a")).collect()
    assert [r["h"] for r in rows] == ["old.reddit.com", "notx.com", "", ""] and rows[0]["a"] and not rows[1]["a"]


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(997).select(F.col("id"), (F.col("id") % 50).alias("g"))
    parts = sampling.group_split(df, "g").collect()
    assert len(parts) == 997 and len({r["g"] for r in parts if r["is_test"]}) == 5
    assert not {r["g"] for r in parts if r["is_test"]} & {r["g"] for r in parts if not r["is_test"]}
    assert sampling.fraction_split(df, 0.8, "id").where("is_train").count() == int(997 * 0.8)
    again = sampling.fraction_split(df.repartition(7), 0.8, "id").where("is_train")
    assert again.exceptAll(sampling.fraction_split(df, 0.8, "id").where("is_train")).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert tells.analyze(empty).count() == 0
    assert sampling.fraction_split(empty, 0.5, "doc_id").count() == 0
    assert sampling.group_split(empty, "source").count() == 0


def test_count_grows_with_text(spark):
    df = spark.createDataFrame([("a b. C d!", "x y")], "a string, b string")
    r = df.select(text.count_words("a").alias("x"), text.count_words(F.concat("a", F.lit(" "), "b")).alias("y")).first()
    assert r["y"] >= r["x"]


def test_models_are_fitted_at_the_reference_s_widths(spark, monkeypatch):
    from proselens.operators import model
    from proselens.plans import model_queries

    asked = []

    def fit(df, bits=model.BITS, most_steps=100, **columns):
        asked.append((bits, most_steps))
        return model.Model(np.zeros(1 << bits, np.int8), 1.0, 0.0, bits)

    monkeypatch.setattr(model, "fit", fit)
    docs = spark.createDataFrame([(k, f"some text {k}", "en", f"src{k % 20}", k % 2) for k in range(40)], "doc_id long, text string, lang string, source string, label int")
    monkeypatch.setattr(model_queries, "labelled", lambda s, d: docs)
    model_queries.QUERIES["m5_fit"](spark, "")
    found = model_queries.QUERIES["m11_compare_bits"](spark, "")
    assert asked == [(17, 100), (16, 100), (17, 100), (18, 100)]
    assert {r["bits"] for r in found.collect()} == {16, 17, 18}


def test_texts_are_hashed_once_for_a_fit(spark, monkeypatch):
    """As often as there are rows, and the query's scores need no more; without texts of no token the fit is the same."""
    from proselens.operators import model
    from proselens.plans import model_queries

    calls, plain = spark.sparkContext.accumulator(0), features.hash_features

    @F.arrow_udf("array<int>")
    def counted(lists):
        calls.add(len(lists))
        return lists

    for module in (model, model_queries):
        monkeypatch.setattr(module, "hash_features", lambda text, bits=17: counted(plain(text, bits)))
    rows = [(k, f"we delve into the tapestry number {k} of it" if k % 2 else f"the bus came late on day {k} again", k % 2) for k in range(40)] + [(40, "", 0), (41, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, label int")
    monkeypatch.setattr(model_queries, "labelled", lambda s, d: docs)
    found = M.fit(docs.withColumn("weight", F.lit(1.0)), bits=12, most_steps=5)
    assert calls.value == len(rows) and found.counts == {"human": 20, "machine": 20}
    scored = model_queries.QUERIES["m5_fit"](spark, "").collect()
    assert calls.value == 2 * len(rows)
    assert {r["p"] for r in scored if r["doc_id"] >= 40} == {0.5} and all((r["p"] > 0.5) == bool(r["label"]) for r in scored if r["doc_id"] < 40)


def test_calibration_hashes_its_own_texts_once(spark, monkeypatch):
    """Not those that a join leaves out, and not again for each use of a score."""
    from proselens.operators import model

    calls, plain = spark.sparkContext.accumulator(0), features.hash_features

    @F.arrow_udf("array<int>")
    def counted(lists):
        calls.add(len(lists))
        return lists

    monkeypatch.setattr(model, "hash_features", lambda text, bits=17: counted(plain(text, bits)))
    path = new_folder(spark, "docs")
    rows = [(k, f"we delve into the tapestry number {k} of it" if k % 2 else f"the bus came late on day {k} again", k % 2) for k in range(60)]
    spark.createDataFrame(rows, "doc_id int, text string, label int").write.parquet(path)
    docs = spark.read.parquet(path)
    fitting = docs.where("doc_id < 40").withColumn("weight", F.lit(1.0))
    chosen = spark.createDataFrame([(k,) for k in range(40, 60, 2)], "doc_id int")
    found = M.train(fitting, docs.join(F.broadcast(chosen), "doc_id"), bits=12, most_steps=5)
    assert calls.value == 40 + 10 and set(found.thresholds) == set(M.BUDGETS)
    p = sorted(r["p"] for r in M.score(docs.where("doc_id >= 40 AND label = 0"), found).collect())
    assert found.thresholds["strict"] == pytest.approx(float(np.quantile(p, 0.97)))


def test_written_vectors_are_vectors(spark):
    df = spark.createDataFrame([(0, [3, 5, 9]), (1, []), (2, None), (3, [15])], "id int, features array<int>")
    found = {r["id"]: r["vector"] for r in features.written_vectors(df, 4).collect()}
    want = {r["id"]: r["vector"] for r in features.to_vectors(df.where("features IS NOT NULL"), 4).collect()}
    assert found == want | {2: want[1]}


def test_folded_buckets_are_those_of_the_smaller_hash(spark):
    df = spark.createDataFrame([("Some words, some more words here — and a few.",), ("",), (None,), ("w " * 900,)], "text string")
    row = df.select(features.hash_features("text", 18).alias("wide"), *[features.hash_features("text", b).alias(f"b{b}") for b in (4, 16, 17)])
    for r in row.select("*", *[features.fold("wide", b).alias(f"f{b}") for b in (4, 16, 17)]).collect():
        assert all(r[f"f{b}"] == r[f"b{b}"] for b in (4, 16, 17))


def test_functions_in_sql(spark):
    model = M.Model((np.arange(1 << 17) * 7919 % 255 - 127).astype(np.int8), 0.01, -0.1)
    M.register(spark, model)
    rows = [("It's a ‘test’ of 12 things\n\nnext “line” 🚀",), ("",), (None,), ("a\u00a0b — c!",)]
    df = spark.createDataFrame(rows, "text string")
    df.createOrReplaceTempView("some_texts")
    found = spark.sql("SELECT text, probability(text) AS p, hash_features(text) AS f, fnv1a32(text) AS h FROM some_texts").collect()
    want = M.score(df, model).withColumn("f", features.hash_features("text")).collect()
    key = lambda r: r.text or ""
    assert [(r.p, r.f) for r in sorted(found, key=key)] == [(r.p, r.f) for r in sorted(want, key=key)]


# ---- the path from labelled texts to figures --------------------------------------------------------------------------------


def test_train_quantise_calibrate_score_decide_evaluate(spark):
    import random

    from proselens.operators import evaluation
    from proselens.plans.model_queries import evaluate_model

    rnd = random.Random(3)
    plain, machine = "we met at noon and talked about the plan for an hour then went home by train in rain".split(), "leverage robust seamless tapestry vibrant pivotal realm foster elevate journey insight crucial landscape".split()

    def document(k, label):
        words = [rnd.choice(machine if label and rnd.random() < 0.2 else plain) for _ in range(rnd.randint(45, 80))]
        return (k, " ".join(words), f"s{k % 4}", label)

    rows = spark.createDataFrame([document(k, k % 2) for k in range(240)], "doc_id long, text string, source string, label int")
    fitting, human = rows.where("doc_id < 140").withColumn("weight", F.lit(1.0)), rows.where("doc_id >= 140 AND doc_id < 200 AND label = 0")
    model = M.train(fitting, human, bits=14, most_steps=30)
    assert set(model.thresholds) == set(M.BUDGETS) and model.counts == {"human": 70, "machine": 70}
    path = new_folder(spark, "model")
    corpora.save_model(spark, model, path)
    loaded = corpora.load_model(spark, path)
    assert (loaded.weights == model.weights).all() and loaded.thresholds == model.thresholds
    judged = evaluate_model(spark, rows.where("doc_id >= 200"), loaded).collect()
    # scores by a join with the saved weights, and verdicts, AUC and shares by plain loops
    weights = spark.read.parquet(f"{path}/weights")
    joined = M.score_by_join(rows.where("doc_id >= 200").select("doc_id", features.hash_features("text", 14).alias("features")), weights, model.scale, model.bias)
    p = {r["doc_id"]: r["p"] for r in joined.collect()}
    assert all(abs(p[r["doc_id"]] - r["p"]) < 1e-9 for r in judged)
    ones, zeros = ([r["p"] for r in judged if r["label"] == x] for x in (1, 0))
    wanted = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    df = spark.createDataFrame([tuple(r) for r in judged], "doc_id long, set string, label int, words int, p double, gentle string, balanced string, strict string")
    assert evaluation.auc(df).first()[0] == pytest.approx(wanted) and wanted > 0.9
    for r in judged:
        if r["p"] >= model.thresholds["balanced"]:
            assert r["balanced"] == "slop"
    for row in evaluation.flagged_by_set(df, {"balanced": "balanced"}).collect():
        own = [r for r in judged if r["set"] == row["set"]]
        assert row["n"] == len(own) and row["balanced"] == pytest.approx(100 * sum(r["balanced"] == "slop" for r in own) / len(own))


def test_a_changed_model_is_refused(spark):
    model = M.Model((np.arange(1 << 10) % 200 - 100).astype(np.int8), 0.02, -0.1, 10, {"strict": 0.3})
    path = new_folder(spark, "model")
    corpora.save_model(spark, model, path)
    assert corpora.load_model(spark, path).bits == 10
    other = new_folder(spark, "model")
    corpora.save_model(spark, model, other)
    spark.read.parquet(f"{path}/weights").withColumn("w", (-F.col("w")).cast("tinyint")).write.mode("overwrite").parquet(f"{other}/weights")
    with pytest.raises(ValueError, match="probe"):
        corpora.load_model(spark, other)


def test_one_class_and_zero_weights(spark):
    from proselens.operators import evaluation

    assert evaluation.auc(spark.createDataFrame([(0.3, 1), (0.4, 1)], "p double, label int")).first()[0] is None
    zero = M.quantize_table(spark.createDataFrame([(0, 0.0), (1, 0.0)], "bucket int, weight double")).collect()
    assert [(r["q"], r["scale"]) for r in zero] == [(0, 1.0), (0, 1.0)]


@given(st.text(alphabet=st.sampled_from(list(" \t\n\x0b\u00a0\u2003\ufeffab.")), max_size=20))
@settings(max_examples=30, deadline=None)
def test_trimming_is_the_pattern_s(value):
    assert value.strip(text._SPACE) == re.sub(rf"^[{text._SPACE}]+|[{text._SPACE}]+$", "", value)


def test_deep_pages_keep_their_structure(spark):
    """A block far down is a leaf, and what is within a skipped element is skipped, however deep."""
    words = " ".join(f"word{k}" for k in range(60))
    deep = "<div>" * 3000 + f"<p>{words}</p>" + "<div>" * 3000 + f"<nav>{'<div>' * 500}<p>{words} hidden</p></nav>"
    rows = spark.createDataFrame([(1, "https://h.example/", deep), (2, "https://h.example/", None)], "page_id long, url string, html string")
    found = pages.leaves(rows).collect()
    assert [(r["page_id"], r["kind"], r["text"]) for r in found] == [(1, "block", words)]


INDEXED = list(dict.fromkeys(tells.INDEXED))


@pytest.mark.parametrize("pattern", INDEXED, ids=lambda p: p[:40])
def test_triggers_are_needed(pattern):
    """A match has one of its rule's words or pairs; a near miss, a letter put into that word, matches only if another is there."""
    known = patterns.triggers(pattern)
    rule = re.compile(patterns.python(pattern), re.IGNORECASE | re.ASCII)
    index = rule_index.RuleIndex((pattern,))
    example = _example(pattern)
    for text_ in (example, f"Then {example} again, and {example}.", f"é{example}é", example.upper()):
        want = [m[0].strip(text.SPACE_CHARACTERS) for m in rule.finditer(text_)]
        assert dict(index(text_)).get(0, []) == want
        tokens = re.findall("[a-z0-9_]+", text_.lower())
        assert not want or not known or any(" ".join(tokens[i : i + t.count(" ") + 1]) == t for t in known for i in range(len(tokens)))
    for trigger in known:
        broken = re.sub(rf"\b{trigger.split()[0]}\b", lambda m: m[0][:1] + "q" + m[0][1:], example, flags=re.IGNORECASE)
        assert dict(index(broken)).get(0, []) == [m[0].strip(text.SPACE_CHARACTERS) for m in rule.finditer(broken)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*INDEXED, " ", ". ", "\n", "-", "é", "_", "İ", "x"]), max_size=12))
def test_index_finds_what_patterns_find(parts):
    found = "".join(_example(p) if p in INDEXED else p for p in parts)
    rules = tuple(INDEXED)
    each = [(k, hits) for k, p in enumerate(rules) if (hits := [m[0].strip(text.SPACE_CHARACTERS) for m in re.finditer(patterns.python(p), found, re.IGNORECASE | re.ASCII)])]
    assert rule_index._index(rules)(found) == each


def test_opinions_meet_hashes_not_texts(spark):
    from pyspark.sql import types as T

    texts = [("the same text " * 30, "slop", 90)] * 50 + [(f"text {k} " * 30, "slop" if k % 2 else "suspect", 60) for k in range(20)] + [(None, "slop", 60), ("short", "slop", 2)]
    blocks = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "block int, text string, verdict string, words int")
    hashed = blocks.select("block", pages.text_hash("text").alias("text_hash"))
    opinions = hashed.where("block IN (0, 51, 52, 53, 71)").select("text_hash", F.when(F.col("block") == 53, "AI").otherwise("Human, mostly").alias("label"))
    found = {r.block: (r.final, r.state) for r in pages.apply_opinions(blocks, opinions).collect()}
    spared = {*range(50), 51}
    assert found == {k: ("suspect", "labelled") if k in spared or t[1] == "suspect" else ("slop", "blocked") for k, t in enumerate(texts)}
    plan = pages.apply_opinions(blocks, opinions)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    asked = pages.to_ask(blocks, opinions)
    assert isinstance(asked.schema["text"].dataType, T.StringType)
    assert sorted(r.text or "" for r in asked.collect()) == sorted({t[0] or "" for k, t in enumerate(texts) if k > 49 and k not in (51, 52, 53, 71)})
