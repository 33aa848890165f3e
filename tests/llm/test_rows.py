"""The same awkward rows through every operator on documents: null and repeated ids, null, empty and long texts, clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from proselens.llm import bottomk, collide, langid, license_scan, pieces, rendezvous, token_files, vptree, waterfill
from proselens.llm.shared import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row", "node", "sign", "text_hash", "size", "shard", "n", "value", "best", "hash", "bin", "label", "score", "weight", "part", "start", "ids", "key", "place", "length")
WORDS = "alpha beta Gamma delta ocean river stone cloud light paper seven green mit license".split()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(15)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    out = [(k, say(rnd.randint(1, 60)), ["en", None][k % 2], ["a", None, "b"][k % 3], k) for k in range(30)]
    out += [(None, say(20), None, None, None), (None, out[4][1], "en", "a", 1), (5, say(30), "en", "a", 1), (5, None, "en", "a", 1), (6, "", "en", None, 1), (7, say(30_000), "en", "b", 1)]
    return [*out, out[0], out[0], out[30], (99, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


def texts_of(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_token_files(docs, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_files.tokenizer_path())
    wanted = Counter()
    for k, t in texts_of(rows):
        ids = [*model.encode(t, add_special_tokens=False).ids, 2]
        wanted[k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = sorted(token_files.round_trip(docs).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == wanted
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found]).tolist()[:-1]]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0))


def test_token_files_layout(spark, docs):
    """Encodings, row groups and page indexes, as a reader of the files sees them."""
    path = new_path(spark, "layout")
    many = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta "), F.md5(F.col("id").cast("string"))).alias("text"))
    token_files.write_tokens(many, path, partitions=1, layout=token_files.Layout(row_group_bytes=64 << 10, page_rows=500))
    (name,) = [r[0] for r in spark.read.parquet(f"{path}/tokens").select(F.input_file_name()).distinct().collect()]
    file = pq.ParquetFile(name.removeprefix("file://"))
    assert file.metadata.num_row_groups > 1
    for g in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            assert column.has_column_index and column.has_offset_index
            is_ids = column.path_in_schema.startswith("ids")
            assert ("RLE_DICTIONARY" in column.encodings) == is_ids and ("DELTA_BINARY_PACKED" in column.encodings) != is_ids, (column.path_in_schema, column.encodings)
    assert token_files.read_tokens(spark, path).where("doc_id = 4321").count() == 1


def test_licenses(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = Counter()
    for k, t in texts_of(rows):
        w = word.findall(t.lower())
        at = [i for i in range(len(w)) if w[i : i + 2] == ["mit", "license"]]
        wanted[k, len(w), len(at), min(at, default=None), max(at, default=None)] += 1
    found = license_scan.result(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in found) == wanted


def test_language(docs, rows):
    found = langid.result(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert Counter(r["lang_pred"] for r in found)["und"] == sum(not t for _, t in texts_of(rows))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) for r in found)


def test_pieces(docs, rows):
    model = pieces.load(pieces.model_path()).processor
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    wanted = Counter((k, digest(model.encode(t)), hashlib.sha256(model.decode(model.encode(t)).encode()).hexdigest()) for k, t in texts_of(rows))
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digest(docs).collect()) == wanted


def test_near_duplicates(docs, rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in texts_of(rows):
        w = word.findall(t.lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    least = defaultdict(list)
    for k, x in enumerate(root):
        least[x].append((rows[k][0] is not None, rows[k][0] or 0, rows[k][0]))
    wanted = Counter((rows[k][0], len(sets[k]), min(least[root[k]])[2]) for k in range(len(rows)))
    found = bottomk.result(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def _draw(key, shard, seed=0):
    """xxHash64 carried from column to column, as Spark does, and the draw of a shard for a key."""
    state = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    state = xxhash.xxh64_intdigest(struct.pack("<i", shard), state)
    if key is not None:
        state = xxhash.xxh64_intdigest(struct.pack("<q", key), state)
    return -1.0 / np.log(((state >> 11) + 0.5) / float(1 << 53))


def test_shards_win_by_the_largest_draw(spark, docs, rows):
    found = rendezvous.assign(docs, [1.0] * 8).collect()
    assert len(found) == len(rows)
    for r in found:
        draws = [_draw(r["doc_id"], k) for k in range(9)]
        assert r["shard"] == int(np.argmax(draws[:8])) and r["grown_shard"] == int(np.argmax(draws))
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_mixture(docs, rows):
    found = waterfill.result(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((k, size(t)) for k, t in texts_of(rows))
    per_source = Counter()
    for r in rows:
        per_source[r[3]] += size(r[1] or "")
    assert {r["source_size"] for r in found} == set(per_source.values()) and all(r["taken"] <= 2 * r["size"] for r in found)
    assert Counter(map(tuple, found)) == Counter(map(tuple, waterfill.result(docs.repartition(7)).collect()))


def test_vectors(spark):
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal(8).tolist()
    data = [(None, base, 1), (3, base, 1), (3, base, 1), (4, [x * 2 for x in base], 1), (5, base, 2), (6, None, 1), (7, base, None), (None, None, None), (8, [-x for x in base], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    for name in ("node", "root", "row", "vector", "n", "n_links", "links", "hash", "copies"):
        df = df.withColumn(name, F.lit("clash"))
    found = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in collide.classify(df).collect())
    assert found == Counter([(None, 3, None, True), (3, 3, None, False), (3, 3, None, False), (4, 3, None, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, True), (8, 0, 8, True)])
    assert vptree.search(df, every=1).where("query_id = 3").count() == 5  # ids 4, 5, 7 and 8, and the row without id
    assert not vptree.search(df, every=1).where("query_id IS NULL").count()
    assert vptree.search(df, every=1).count() > 0


def test_pipeline_stages_keep_rows_and_columns(spark, docs, rows):
    at = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, at, "")
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert {r["n"] for r in kept} <= {"clash"}
        if name == "language":
            assert Counter(r["doc_id"] for r in kept) == Counter(k for k, t in texts_of(rows) if t)
        at = spark.createDataFrame(kept, out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert len(last) == len(kept) and all(len(r["ids"]) == r["n_tokens"] for r in last)
