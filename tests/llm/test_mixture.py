"""Mixing where rows repeat: every source comes within one document of its target."""

from collections import defaultdict

from proselens.llm import waterfill

DOCS = "doc_id long, text string, source string, size long, spare string"


def mixed(spark, rows):
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], DOCS).repartition(4)
    found = defaultdict(lambda: [0, 0.0, 0, 0])
    for r, source in ((r, None) for r in waterfill.result(df).collect()):
        assert source is None and r.taken <= 2 * r.size
        own = found[r.source_size, r.target]
        own[0] += r.taken
        own[1], own[2] = r.target, max(own[2], r.size)
        own[3] += 1
    return found, waterfill.repeat(df)


def near(found):
    for taken, target, most, _ in found.values():
        assert abs(taken - target) <= most, (taken, target, most)


def test_one_document_a_hundred_times(spark):
    rows = [(1, "ten words of text that are here to be counted", "a")] * 100 + [(k, f"w{k} " * 30, "b") for k in range(60)] + [(k, "x y", "c") for k in range(510)]
    found, repeated = mixed(spark, rows)
    near(found)
    assert sum(x[3] for x in found.values()) == len(rows)
    words = sum(len(r.text.split()) for r in repeated.collect())
    assert words == sum(x[0] for x in found.values())


def test_null_ids_and_empty_texts_repeat(spark):
    rows = [(None, "a b c", None)] * 40 + [(None, f"t{k} u v w", "s") for k in range(50)] + [(3, "", "s")] * 30 + [(3, None, "s")] * 30 + [(4, "z", "e")]
    near(mixed(spark, rows)[0])


def test_a_third_of_all_rows_is_one(spark):
    rows = [(7, "the same text again and again", "hot")] * 700 + [(k, f"text {k} of its own" + " more" * (k % 7), f"s{k % 7}") for k in range(1400)]
    first, second = mixed(spark, rows)[0], mixed(spark, rows)[0]
    near(first)
    assert first == second
