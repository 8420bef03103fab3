"""The queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm.common import Query, table


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftlink.llm.bpe import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.secrets import digests, scan

    return digests(scan(table(spark, sf_dir, "documents")))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.licenses import digests, scan

    return digests(scan(table(spark, sf_dir, "documents")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.langid import held_out, identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.html import extract, with_lengths

    return with_lengths(extract(table(spark, sf_dir, "pages")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.pii import digests, find

    return digests(find(table(spark, sf_dir, "documents")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.minhash import groups

    return groups(table(spark, sf_dir, "documents"))


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.hnsw import linked

    return linked(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_licenses, op2_minhash, op3_html, op4_pii, op5_urls, op6_bpe, op7_langid, op8_secrets, op9_decontaminate, op10_hnsw)}


def oracle_sql() -> dict[str, str]:
    from weftlink.llm import oracles, urls

    return {"op1_licenses": oracles.licenses(), "op2_minhash": oracles.groups(), "op5_urls": urls.oracle(), "op10_hnsw": oracles.vectors()}
