"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import assign

    docs = assign(table(spark, sf_dir, "documents"))
    first = F.round(F.try_element_at("copies", F.lit(1))["position"], 6).alias("position")
    return docs.select("doc_id", "size", "source_size", "target", "taken", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), context=2048, end=1, digest=True)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store

    return store(table(spark, sf_dir, "documents"), media=False)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import HISTORY, remove

    return remove(table(spark, sf_dir, "documents"), k=13, history=HISTORY)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op11_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocation import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_jaccard, op3_resampling, op4_rules, op5_secrets, op6_packing, op7_substring, op8_warc, op9_media, op10_lm, op11_collocation, op12_clustering, op13_toxicity)}
