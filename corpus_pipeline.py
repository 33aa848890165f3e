"""A corpus made ready for training, as five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last keep the columns of ``documents``; an empty table stays empty.

1. language: texts whose language can't be told go; missing and contradicted labels become the language told.
2. near_duplicates: one document of each group of near-duplicates stays.
3. secrets: secrets are masked in the texts; no document goes.
4. mixture: sources are mixed to target weights; documents are left out, kept or repeated.
5. tokens: texts become sentencepiece ids with the bytes that each stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proselens.llm import bottomk, langid, pieces, secret_forest, waterfill
from proselens.llm.shared import stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the texts that have no letter or whose n-grams are those of no language of the corpus (noise, keys, markup).

    ``lang`` becomes the language told where it was missing, or where the text clearly is of another.
    """
    return langid.keep_known(docs)


#: Two documents are near-duplicates if they share this percentage of their five-word shingles.
NEAR_PERCENT = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each class of near-duplicates. Texts without words stay."""
    return bottomk.keep_one(docs, NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with secrets masked."""
    return secret_forest.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` as often as the mix takes each."""
    return waterfill.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, begins, ends (each piece's span in the text's bytes)."""
    return pieces.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: Trained models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
