"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, hard_negatives, merkle, site_style, warc
from .ann import nearest
from .chat_format import chat_digests, format_chats
from .common import table
from .language_id import language_id
from .lm_score import lm_scores
from .media import media_features, text_media
from .mixing import mixing_rates
from .packing import pack
from .simhash_dedup import simhash_components
from .token_counts import token_counts


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


#: The conversation that holds control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{TRICKY}'), (-7L, 1L, 'assistant', '{TRICKY}') AS t(conv_id, turn, role, text)")
    return chat_digests(format_chats(turns.unionByName(more)))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=3, radius=2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"), least_revisit_bytes=0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = text_media(table(spark, sf_dir, "documents"), width=64, kinds=("ppm", "bmp"))
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    return media_features(stored, ["doc_id", "n_bytes"], side=16).select(columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, F.expr(hard_negatives.NOISY))


def op12_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.site_texts(table(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_token_counts": op2_token_counts,
    "op3_chat_format": op3_chat_format,
    "op4_media": op4_media,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_site_style": op12_site_style,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op3_chat_format": chat_format.sql(extra=f"UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'"),
    "op10_warc": warc.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_site_style": site_style.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
