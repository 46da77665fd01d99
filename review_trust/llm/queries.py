"""One query per operator over its whole table, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from review_trust.llm import bpe, chat, jaccard, licenses, lines, merkle, periodic, quality, repair, simhash, urls, warc, winnow
from review_trust.llm.common import session


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op6_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(_table(spark, sf_dir, "conversations"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = jaccard.similar_documents(_table(spark, sf_dir, "documents"), shingle_words=4, percent=85)
    return similar.select("doc_id", "n_shingles", "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(_table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(messages), messages)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_merkle": op5_merkle,
    "op6_url_trust": op6_url_trust,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_chat": op8_chat,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_licenses": op10_licenses,
    "op11_periodic": op11_periodic,
    "op12_simhash": op12_simhash,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op3_line_dedup": lines.SQL,
    "op4_decontaminate": winnow.SQL,
    "op6_url_trust": urls.SQL,
    "op8_chat": chat.SQL,
    "op10_licenses": licenses.SQL,
}
