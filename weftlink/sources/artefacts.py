"""What steps leave for others: ingested records, id lookups, feature parts, models, and the folders that hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftlink.sources import tables

#: Rows of a file of features, at most.
PART_ROWS = 1_000_000
#: Sources' numbers stand in the high bits of a query's number.
SOURCE_BITS = 23


@dataclass(frozen=True)
class Layout:
    """Names below one folder; a world's tag keeps its artefacts apart."""

    root: str
    world: str = ""

    def raw(self, split: str, source: int) -> str:
        return f"{self.root}/{split}/{split}_source{source}.tsv"

    def truth(self, split: str) -> str:
        return f"{self.root}/{split}/{split}_ground_truth.tsv"

    def work(self, kind: str, split: str, level: int = 1) -> str:
        tag, stage = f"_{self.world}" if self.world else "", "" if level == 1 else str(level)
        return f"{self.root}/work/{kind}{stage}_{split}{tag}"


def query_number(source, idx):
    """One number for a record of sources 2 and up: the source over the row's number."""
    return ((source.cast("bigint") - 2) * (1 << SOURCE_BITS) + idx.cast("bigint")).cast("bigint")


def ingest(spark: SparkSession, layout: Layout, split: str, source: int) -> DataFrame:
    """A source's records, checked, numbered in the order of their ids and written as Parquet."""
    rows = tables.numbered(tables.checked(tables.read_tsv(spark, layout.raw(split, source)), source))
    path = layout.work(f"source{source}", split)
    rows.select("idx", *tables.RECORD).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def id_lookup(records: DataFrame) -> DataFrame:
    """(idx, entity_id): the way back from numbers to ids."""
    return records.select("idx", "entity_id")


def with_ids(pairs: DataFrame, references: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of numbers (s1, qid) as pairs of ids."""
    return pairs.join(id_lookup(references).toDF("s1", "_s"), "s1").join(id_lookup(queries).toDF("qid", "_q"), "qid").select(F.col("_s").alias("s1"), F.col("_q").alias("qid"))


def write_results(references: DataFrame, matches: DataFrame, candidates: DataFrame, folder: str) -> None:
    """The two result files, one row for each reference (id); matches that are no candidates are an error."""
    bad = tables.contract(references, matches, candidates).first()
    if bad["n_foreign"] or bad["n_refs"] != bad["n_ref_ids"]:
        raise ValueError(f"the results break their contract: {bad.asDict()}")
    for pairs, name, file in ((matches, "matched_entity_ids", "matching_results"), (candidates, "candidate_entity_ids", "candidate_pairs")):
        tables.write_tsv(tables.id_lists(references, pairs, name).withColumnRenamed("s1", "source1_entity_id"), f"{folder}/{file}")


def write_features(features: DataFrame, path: str, rows: int = PART_ROWS) -> None:
    """Features in files of bounded length."""
    features.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def feature_names(df: DataFrame, leave: tuple[str, ...] = ()) -> list[str]:
    """The columns that a model takes: neither ids and labels nor those that ``leave`` names."""
    return [c for c in df.columns if c not in ("qid", "s1", "y", "cluster", "fold", "u", "country", *leave)]


def save_models(models: list, path: str) -> None:
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path}/fold={k}")


def load_models(path: str, folds: int) -> list:
    return [GBTClassificationModel.load(f"{path}/fold={k}") for k in range(folds)]


def importances(models: list, names: list[str], top: int = 30) -> list[tuple[str, float]]:
    """The ``top`` features by their mean importance over the folds."""
    mean = [(name, sum(float(m.featureImportances[i]) for m in models) / len(models)) for i, name in enumerate(names)]
    return sorted(mean, key=lambda x: (-x[1], x[0]))[:top]
