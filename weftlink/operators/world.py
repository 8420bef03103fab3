"""Training worlds: which references stay, and which queries meet them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from weftlink.functions.sampling import bucket

BUCKETS = 10_000


@dataclass(frozen=True)
class World:
    """kept: the share of references by country (others stay); decoys: the share of queries without a kept reference."""

    kept: dict[str, float] = field(default_factory=dict)
    decoys: dict[str, float] = field(default_factory=dict)
    decoys_else: float = 0.4
    seed: int = 77


def _by(values: dict[str, float], key: Column, other: float) -> Column:
    out = F.lit(float(other))
    for name, value in values.items():
        out = F.when(key == name, F.lit(float(value))).otherwise(out)
    return out


def kept(references: DataFrame, world: World) -> DataFrame:
    limit = F.floor(_by(world.kept, F.col("country"), 1.0) * BUCKETS)
    return references.filter(bucket(F.col("id"), world.seed, BUCKETS) < limit)


def dropped(references: DataFrame, world: World) -> DataFrame:
    return references.join(kept(references, world).select("id"), "id", "left_anti")


def select_queries(queries: DataFrame, truth: DataFrame, kept_: DataFrame, world: World) -> DataFrame:
    """Queries of kept references, and decoys thinned to the wanted share: natural ones (without a reference) up to their natural rate, then those whose reference was dropped. Thresholds come from one small aggregate a country."""
    matched = truth.select(F.col("qid").alias("id"), F.lit(True).alias("has"))
    true = truth.join(kept_.select(F.col("id").alias("s1")), "s1", "left_semi").select(F.col("qid").alias("id"), F.lit(True).alias("true"))
    x = queries.join(matched, "id", "left").join(true, "id", "left").fillna(False, ["has", "true"])
    kind = F.when(F.col("true"), "true").when(F.col("has"), "orphan").otherwise("natural")
    x = x.withColumn("_kind", kind)
    n = x.groupBy("country").agg(*[F.count_if(F.col("_kind") == k).alias(k[0]) for k in ("true", "orphan", "natural")], F.count("*").alias("all"))
    target = _by(world.decoys, F.col("country"), world.decoys_else)
    n = n.withColumn("want", F.least(F.col("n") + F.col("o"), F.round(F.col("t") * target / (1 - target))))
    n = n.withColumn("want_n", F.least(F.col("n"), F.round(F.col("n") / F.col("all") * (F.col("t") + F.col("want")))))
    n = n.withColumn("want_o", F.least(F.col("o"), F.col("want") - F.col("want_n")))
    n = n.select("country", *[F.coalesce(F.ceil(F.try_divide(BUCKETS * F.col(w), F.col(k))), F.lit(0)).alias(f"_{w}") for w, k in (("want_n", "n"), ("want_o", "o"))])
    h = bucket(F.col("id"), world.seed + 1, BUCKETS)
    stay = F.when(F.col("_kind") == "true", True).when(F.col("_kind") == "natural", h < F.col("_want_n")).otherwise(h < F.col("_want_o"))
    return x.join(n, "country").filter(stay).select(*queries.columns)


def select_anchored(queries: DataFrame, truth: DataFrame, kept_: DataFrame, first: DataFrame) -> DataFrame:
    """Queries of kept references, and those without any reference whose best candidate (``first``: qid, s1 of rank 1) is kept."""
    ids = kept_.select(F.col("id").alias("s1"))
    true = truth.join(ids, "s1", "left_semi").select(F.col("qid").alias("id"))
    near = first.select("qid", "s1").join(truth.select("qid"), "qid", "left_anti").join(ids, "s1", "left_semi").select(F.col("qid").alias("id"))
    return queries.join(true.unionByName(near).distinct(), "id", "left_semi")


def with_folds(pairs: DataFrame, truth: DataFrame, folds: int = 4) -> DataFrame:
    """pairs with y, the cluster (the query's true reference, else the query), its fold and its u in [0, 1): all pairs of an entity share a fold."""
    x = pairs.join(truth.select("qid", F.col("s1").alias("_true")), "qid", "left")
    x = x.withColumn("y", F.coalesce(F.col("s1") == F.col("_true"), F.lit(False)).cast("int"))
    x = x.withColumn("cluster", F.coalesce(F.concat(F.lit("s"), F.col("_true").cast("string")), F.concat(F.lit("q"), F.col("qid").cast("string")))).drop("_true")
    return x.withColumns({"fold": bucket(F.col("cluster"), 11, folds), "u": bucket(F.col("cluster"), 23, 1000) / 1000.0})
