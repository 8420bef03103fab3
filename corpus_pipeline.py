"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; run() writes
it as Parquet in the shared folder and reads it again for the next. Stages but the last return the columns of
``documents``. Null ids, null and empty texts, repeated rows and extra columns are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftlink.llm import bpe, decontaminate, langid, minhash, pii
from weftlink.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits a byte over which no learned language explains a text better than no model at all.
MOST_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are in no learned language: null, without letters, or costing over 8 bits a byte in all of them. The predicted language replaces a missing label only."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, keep=("lang", "source", "n_chars"), with_text=True)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits") <= MOST_BITS))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return minhash.first_of_groups(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each text, and whether decoding gave the text back."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, room=bpe.TIGHT)
    return bpe.digests(coded)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("personal_data", personal_data), ("tokens", tokens)]

#: Language models, signatures and expectation-maximisation have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
