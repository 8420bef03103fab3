"""Reading and checking records, truth and results; all text, tab-separated, without quoting."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """A tab-separated file with a header; nothing is inferred or unquoted, and null becomes ''."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="").fillna("")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def audit(records: DataFrame, source: int, id_col: str = "entity_id") -> DataFrame:
    """One row: rows, distinct ids, and ids without the source's prefix."""
    return records.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("n_ids"), F.count_if(~F.startswith(F.col(id_col), F.lit(f"S{source}-"))).alias("n_foreign"))


def checked(records: DataFrame, source: int) -> DataFrame:
    """records, or an error where ids repeat or are foreign."""
    row = audit(records, source).first()
    if row["n"] != row["n_ids"] or row["n_foreign"]:
        raise ValueError(f"source {source}: {row.asDict()}")
    return records


def numbered(records: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """A number for each row in the order of ids, without bringing all rows to one task: ranks within ranges plus the ranges' offsets."""
    parts = records.repartitionByRange(F.col(id_col)).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(id_col)))
    return ranked.join(F.broadcast(before), "_part").withColumn("idx", F.col("_before") + F.col("_k") - 1).drop("_part", "_n", "_before", "_k")


def true_pairs(truth: DataFrame) -> DataFrame:
    """(s1, qid, src) from one row a reference with comma-joined ids; src is the number in the id's prefix."""
    x = truth.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("qid"))
    x = x.withColumn("qid", F.trim("qid")).filter(F.col("qid") != "")
    return x.withColumn("src", F.regexp_extract("qid", r"^S([0-9]+)-", 1).cast("int"))


def union_sources(*sources: tuple[int, DataFrame]) -> DataFrame:
    out = None
    for number, df in sources:
        df = df.withColumn("src", F.lit(number))
        out = df if out is None else out.unionByName(df)
    return out


def labelled(pairs: DataFrame, references: DataFrame, queries: DataFrame) -> DataFrame:
    """True pairs with both sides' raw name and address."""
    side = lambda df, key, k: df.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"n{k}"), F.col("business_address").alias(f"a{k}"), *(["country"] if k == 1 else []))
    return pairs.join(side(references, "s1", 1), "s1").join(side(queries, "qid", 2), "qid")


def id_lists(references: DataFrame, pairs: DataFrame, name: str, key: str = "id") -> DataFrame:
    """One row for every reference with its sorted distinct ids, comma-joined; '' for none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set(F.col("qid").cast("string"))), ",").alias(name))
    return references.select(F.col(key).alias("s1")).join(lists, "s1", "left").fillna("", [name])


def contract(references: DataFrame, matches: DataFrame, cand: DataFrame) -> DataFrame:
    """One row: references, matches, and matches that are no candidate (there must be none)."""
    foreign = matches.select("s1", "qid").distinct().join(cand.select("s1", "qid"), ["s1", "qid"], "left_anti").agg(F.count("*").alias("n_foreign"))
    n = matches.select("s1", "qid").distinct().agg(F.count("*").alias("n_matches"))
    r = references.agg(F.count("*").alias("n_refs"), F.count_distinct("id").alias("n_ref_ids"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(r).join(one(n), "_one").join(one(foreign), "_one").drop("_one")


def save_config(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
