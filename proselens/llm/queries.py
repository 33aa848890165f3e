"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bottomk, bpe_automaton, collide, langid, license_scan, phrases, pieces, rendezvous, secret_forest, token_files, vptree, waterfill, whitening
from .shared import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.result(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.result(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op5_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.result(table(spark, sf_dir, "documents"))


def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.assign(table(spark, sf_dir, "documents"), [1.0] * 8)


def op7_collide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collide.classify(table(spark, sf_dir, "embeddings"))


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(table(spark, sf_dir, "embeddings"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.result(table(spark, sf_dir, "documents"))


def op10_waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waterfill.result(table(spark, sf_dir, "documents"))


def op11_bidiagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digest(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_license_scan, op3_langid, op4_pieces, op5_bottomk, op6_rendezvous, op7_collide, op8_vptree, op9_secret_forest, op10_waterfill, op11_bidiagonal, op12_bpe_automaton, op13_phrases)}
ORACLES = {"op5_bottomk": bottomk.ORACLE, "op7_collide": collide.ORACLE, "op10_waterfill": waterfill.ORACLE, "op13_phrases": phrases.ORACLE}
