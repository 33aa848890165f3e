"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters counts as a space, and runs of 1 to 3 characters are hashed to DIMENSIONS
features. Document frequencies are counted over every training row, by language. The regression is trained by
follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties on about FIT_ROWS labelled rows, about as many of each
language, drawn by a hash of id and text; a fifth of them is left out to fit the temperature that calibrates the scores.

A text's language can be told only if its n-grams are those of a language: ``familiar`` is the share of them that COMMON of some
language's training rows hold. Random characters, keys, markup and languages that were not learned share few. ``keep_known``
rejects texts below a bar that is calibrated on the rows left out: MARGIN times what all but one in 200 of them reach, LEAST_BAR
at the most. The rows that stay go on with the language told: a missing label is filled from a score of LIKELY on, and a learned
label that the text contradicts is replaced from CERTAIN on. Labels that weren't learned stay, as do all where there is but one.

Rows: null texts and texts without a letter are ``und`` with score and familiar 0; without any labelled row every text is
``und``, and familiar is null. Equal scores go to the language first in order. Repeated rows get equal results; extra columns
are kept by ``annotate``, those with its names give way. Of more than MOST_LANGUAGES labels the most frequent are learned.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_text, in_slices, short_batches, stage
from .words import mix

UNDETERMINED = "und"
DIMENSIONS = 1 << 15
#: Bound on the labelled rows that the regression is fitted on, and on the languages that it tells apart (the model's size).
FIT_ROWS, MOST_LANGUAGES = 3_000, 200
#: An n-gram is familiar if this share of a language's rows holds it; how the bar on the familiar share follows from rows left out.
COMMON, MARGIN, LEAST_BAR = 0.01, 0.9, 0.8
#: Calibrated scores from which a prediction fills a missing label, and from which it replaces another one.
LIKELY, CERTAIN = 0.5, 0.99
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-3, 3
#: Characters of a text that are looked at together; longer texts are counted in parts.
PART = 1 << 20

_letter = regex.compile(r"\p{L}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text and how often each occurs."""
    total = np.zeros(DIMENSIONS, np.int64)
    for a in range(0, len(text), PART):
        code = np.frombuffer(text[max(0, a - 2) : a + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = _letters()[code].astype(np.uint64)
        code = np.concatenate(([32], code, [32])).astype(np.uint64)
        one = code * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(0xD1342543DE82EF95) + code[1:]
        three = two[:-1] * np.uint64(0xD1342543DE82EF95) + code[2:]
        blank = code == 32
        grams = np.concatenate((one[~blank], two[~(blank[:-1] & blank[1:])], three[~(blank[1:-1])]))
        total += np.bincount((mix(grams) >> np.uint64(49)).astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text and _letter.search(text))


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights (logarithmic counts) of length one."""
    x = (1 + np.log(n)) * idf[at]
    size = np.sqrt((x * x).sum())
    return x / size if size else x


# ---- training --------------------------------------------------------------------------------------------------------


def _frequencies(classes: list[str]):
    """Sparse vectors of document frequencies by language, one a task; feature -1 counts documents."""
    number = {lang: k for k, lang in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(classes), DIMENSIONS + 1), np.int32)
        for batch in in_slices(batches):
            for text, lang in zip(*[batch.column(c).to_pylist() for c in ("text", "lang")], strict=True):
                total[number[lang], 0] += 1
                total[number[lang], counts(text)[0] + 1] += 1
        lang, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(feature - 1, pa.int32()), pa.array(total[lang, feature], pa.int64())], names=["label", "feature", "n"])

    return run


def _as_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts become their features and how often each occurs."""
    for batch in in_slices(batches):
        found = [counts(t) for t in batch.column("text").to_pylist()]
        bounds = pa.array(np.cumsum([0, *[len(at) for at, _ in found]]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([x[k] for x in found]) if found else [], pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), batch.column("hash"), *lists], names=["label", "fold", "hash", "at", "times"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights (DIMENSIONS, classes) by FTRL-proximal over rows of (features, values)."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    random = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)):
            at, x = rows[k]
            w = weights(at)
            error = _softmax(x @ w)
            error[labels[k]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The factor on the logits under which the labels are likeliest, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = np.log(np.maximum(_softmax(logits * np.exp(t)), 1e-12))
        right = p[np.arange(len(labels)), labels]
        return -((1 - doubt) * right + doubt * (p.sum(axis=1) - right) / max(1, p.shape[1] - 1)).mean()

    doubt = 1 / (len(labels) + 2)  # else rows without an error would call for certainty
    low, high, ratio = -3.0, 5.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _train(classes: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, folds = [], [], []
        frequency, seen = np.zeros((len(classes), DIMENSIONS)), np.zeros(len(classes))
        for batch in batches:
            for label, fold, feature, n, at, times in zip(*[batch.column(c).to_pylist() for c in ("label", "fold", "feature", "n", "at", "times")], strict=True):
                if feature is None:
                    rows.append((np.array(at, np.int64), np.array(times, np.int64)))
                    labels.append(label)
                    folds.append(fold)
                elif feature < 0:
                    seen[label] = n
                else:
                    frequency[label, feature] = n
        idf = np.log((1 + seen.sum()) / (1 + frequency.sum(axis=0))) + 0.05
        common = (frequency >= COMMON * np.maximum(seen, 1)[:, None]).any(axis=0) & (frequency.sum(axis=0) > 0)
        data = [(at, vector(at, n, idf)) for at, n in rows]
        labels, held = np.array(labels, np.int64), np.array(folds, np.int64) == 0
        if held.all():
            held[:] = False
        own, out = np.flatnonzero(~held), np.flatnonzero(held)
        weights = fit([data[k] for k in own], labels[own], len(classes)) if len(own) else np.zeros((DIMENSIONS, len(classes)))
        logits = np.array([data[k][1] @ weights[data[k][0]] for k in out]).reshape(-1, len(classes))
        reached = np.quantile([familiar(*rows[k], common) for k in out], 1 / 200) if len(out) else 0.0
        used = np.flatnonzero(weights.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(
            used=used, weights=weights[used].astype(np.float32), idf=idf.astype(np.float32), scale=np.array(temperature(logits, labels[held])),
            common=np.flatnonzero(common).astype(np.int32), bar=np.array(min(LEAST_BAR, MARGIN * reached)),
        )], pa.binary())], names=["model"])

    return run


def familiar(at: np.ndarray, n: np.ndarray, common: np.ndarray) -> float:
    """The share of a text's n-grams that are common in some language."""
    return float(n[common[at]].sum() / n.sum()) if len(n) else 0.0


class Model:
    def __init__(self, classes: list[str], packed: bytes | None):
        self.classes = classes
        if packed:
            data = np.load(io.BytesIO(packed))
            self.idf, self.scale = data["idf"].astype(np.float64), float(data["scale"])
            self.weights = np.zeros((DIMENSIONS, len(classes)))
            self.weights[data["used"]] = data["weights"]
            self.common, self.bar = np.zeros(DIMENSIONS, bool), float(data["bar"])
            self.common[data["common"]] = True

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """Language, score and familiar share."""
        if not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        if not self.classes:
            return UNDETERMINED, 0.0, None
        at, n = counts(text)
        p = _softmax(self.scale * (vector(at, n, self.idf) @ self.weights[at]))
        best = int(np.argmax(p))
        return self.classes[best], float(p[best]), familiar(at, n, self.common)

    def tell(self, text: str | None, label: str | None) -> tuple[bool, str | None]:
        """Whether the text's language can be told, and the language to go on with."""
        lang, score, share = self.predict(text)
        sure = score >= LIKELY if label is None else label in self.classes and score >= CERTAIN
        return share is None or (has_letter(text) and share >= self.bar), lang if sure and len(self.classes) > 1 else label


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], bytes | None]:
    """Learn from ``docs`` (doc_id, text, lang): (languages, packed model). Rows without language, or without a letter, teach nothing."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    per_lang = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not per_lang:
        return [], None
    sizes = {r["lang"]: r["n"] for r in per_lang}
    classes = sorted(sizes)
    learned = known.where(F.col("lang").isin(classes))
    of_lang = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]
    hashed = F.xxhash64(F.lit(5), "doc_id", "text")
    draw = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    frequencies = short_batches(learned).select("text", "lang").mapInArrow(_frequencies(classes), "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    drawn = learned.where(draw < of_lang({lang: min(1.0, fit_rows / len(classes) / n) for lang, n in sizes.items()}))
    drawn = drawn.select("text", of_lang({lang: k for k, lang in enumerate(classes)}).alias("label"), F.pmod(F.shiftright(hashed, 32), F.lit(5)).cast("int").alias("fold"), hashed.alias("hash"))
    taught = drawn.mapInArrow(_as_counts, "label int, fold int, hash long, at array<int>, times array<int>")
    gathered = stage(frequencies.unionByName(taught, allowMissingColumns=True), "lessons").coalesce(1).sortWithinPartitions("hash", "label", "feature")  # FIT_ROWS and MOST_LANGUAGES bound it
    return classes, gathered.mapInArrow(_train(classes), "model binary").first()["model"]


# ---- prediction ------------------------------------------------------------------------------------------------------


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared)
        for batch in in_slices(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            columns = [*batch.columns, *[pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *PREDICTED])

    return run


def _known(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared)
        for batch in in_slices(batches):
            told = [model.tell(text, label) for text, label in zip(*[batch.column(c).to_pylist() for c in ("text", "lang")], strict=True)]
            at = batch.schema.get_field_index("lang")
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array([lang for _, lang in told], field.type)).filter(pa.array([known for known, _ in told], pa.bool_()))

    return run


PREDICTED = ("lang_pred", "score", "familiar")


def annotate(docs: DataFrame, model: tuple[list[str], bytes | None]) -> DataFrame:
    """``docs`` with lang_pred, score and familiar, in place of any such columns. The packed model (DIMENSIONS x MOST_LANGUAGES numbers at most) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(*PREDICTED)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    return short_batches(rows).mapInArrow(_predicted(shared), T.StructType([*rows.schema.fields, *map(T.StructField, PREDICTED, kinds)]))


_models: dict[int, Model] = {}


def _loaded(shared) -> Model:
    classes, packed = shared.value
    key = hash((*classes, packed))
    if key not in _models:
        _models.clear()
        _models[key] = Model(classes, packed)
    return _models[key]


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_text(doc_id) % 4 == 2


def result(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, familiar; learned from the rows that aren't held out."""
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.where(~held_out()))
    return annotate(rows.drop("lang"), model).select("doc_id", held_out().alias("held_out"), *PREDICTED)


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told (no letter, or a familiar share below the calibrated bar), ``lang`` as told.

    Learned from their own labels; if no row is labelled, only texts without a letter go, and ``lang`` stays.
    """
    return short_batches(docs).mapInArrow(_known(docs.sparkSession.sparkContext.broadcast(train(docs))), docs.schema)
