"""Blocking: references and queries that share rare keys, scored by the keys' IDF."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftlink.operators.keys import CAP_CLASS, with_keys


@dataclass(frozen=True)
class Caps:
    """References a key may have, by class: a floor, and a number for each million references of the country."""

    single: tuple[int, int] = (10, 60)
    cross: tuple[int, int] = (10, 80)
    other: tuple[int, int] = (20, 200)

    def of(self, ty: Column, n: Column) -> Column:
        out = F.lit(0)
        for name in ("single", "cross", "other"):
            floor, rate = getattr(self, name)
            kinds = [k for k, c in CAP_CLASS.items() if c == name]
            out = F.when(ty.isin(kinds), F.greatest(F.lit(floor), F.round(rate * n / 1_000_000).cast("int"))).otherwise(out)
        return out


def key_weights(keys: DataFrame, references: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """(country, ty, key, df, w) of reference keys within their cap; w = ln N - ln df, N: the country's references.

    The cap bounds every key's fan-out before the join, so no key, however common, can grow it.
    """
    n = references.groupBy("country").agg(F.count("*").alias("n_ref"))
    df = keys.groupBy("country", "ty", "key").agg(F.count("*").alias("df"))
    capped = df.join(n, "country")  # one row a country: broadcast at run time where that is small
    return capped.filter(F.col("df") <= caps.of(F.col("ty"), F.col("n_ref"))).select("country", "ty", "key", "df", (F.log("n_ref") - F.log("df")).alias("w"))


def candidates(references: DataFrame, queries: DataFrame, caps: Caps = Caps(), top: int = 12) -> DataFrame:
    """(qid, s1, score, nk, rank): the ``top`` references of each query by the summed weights of shared keys.

    Ties go to the smaller reference id. Records of different countries never meet.
    """
    ref_keys = with_keys(references, True)
    weights = key_weights(ref_keys, references, caps)
    weighed = ref_keys.join(weights, ["country", "ty", "key"]).select("country", "ty", "key", F.col("id").alias("s1"), "w")
    query_keys = with_keys(queries, False).withColumnRenamed("id", "qid")
    return ranked(summed(query_keys.join(weighed, ["country", "ty", "key"]).select("qid", "s1", "w")), top)


def summed(shared: DataFrame) -> DataFrame:
    """(qid, s1, score, nk) of shared keys' weights (qid, s1, w), added one after the other in rising order.

    Sums of parts differ from that in their last bit, and prune() compares scores as they are: ties such as three
    keys against ten of equal weight would go by how rows were dealt. Ranking needs a query's rows together anyway.
    """
    return shared.repartition("qid").sortWithinPartitions("qid", "s1", "w").groupBy("qid", "s1").agg(F.sum("w").alias("score"), F.count("*").alias("nk"))


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """Ranks rows of a query by rounded score, so that the order of a sum can't decide, then by reference."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "s1")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def prune(cand: DataFrame, top: int = 5, share: float = 0.3) -> DataFrame:
    """Candidates with rank <= top and score >= share of the query's best, with the query's statistics from before the cut and the reference's from after it."""
    q = Window.partitionBy("qid")
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(q)
    x = cand.withColumns({"best": F.max("score").over(q), "second": F.coalesce(second, F.lit(0.0)), "q_ncand_raw": F.count("*").over(q)})
    x = x.filter((F.col("rank") <= top) & (F.col("score") >= share * F.col("best")))
    s = Window.partitionBy("s1")
    by_score = Window.partitionBy("s1").orderBy(F.round("score", 6).desc(), "qid")
    return x.select(
        "qid", "s1", "score", "nk", "rank", F.try_divide("score", "best").alias("rel"), (F.col("best") - F.col("score")).alias("gap_best"), (F.col("score") - F.col("second")).alias("gap_second"),
        "q_ncand_raw", F.count("*").over(s).alias("s_ncand"), F.row_number().over(by_score).cast("long").alias("s_rank"),
    )


def oracle_report(cand: DataFrame, truth: DataFrame, references: DataFrame, at: tuple[int, ...] = (1, 2, 3, 5, 8, 12)) -> DataFrame:
    """One row: recall of true pairs by rank, the best macro F0.5 that candidates allow, and references that lose all their records."""
    found = truth.join(cand.select("qid", "s1", "rank"), ["qid", "s1"], "left")
    recall = found.agg(F.count("*").alias("n_true"), F.count("rank").alias("n_found"), *[F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias(f"recall_at_{k}") for k in at])
    by = references.select(F.col("id").alias("s1")).join(found.groupBy("s1").agg(F.count("*").alias("g"), F.count("rank").alias("tp")), "s1", "left").fillna(0, ["g", "tp"])
    best = F.when(F.col("g") == 0, 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (F.col("tp") + 0.25 * F.col("g")))
    ceiling = by.agg(F.round(F.avg(best), 6).alias("oracle_f05"), F.count_if((F.col("g") > 0) & (F.col("tp") == 0)).alias("lost"))
    return recall.withColumn("_one", F.lit(1)).join(ceiling.withColumn("_one", F.lit(1)), "_one").drop("_one")
