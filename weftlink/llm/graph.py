"""Connected components without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftlink.llm.common import removed, written


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: links move to the least neighbour. Minima are pre-aggregated; the joins hold no more rows than the links, and a hub's rows can be split."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select("a", "b", "m")
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b; any order, repeats and loops allowed); component: the smallest id reachable.

    Alternating star contraction; each round is written in the shared folder. Ends when a round changes nothing, or
    with an error after ``most`` rounds, which would need a path of over 2^most links.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(now)
    for _ in range(most):
        last, now = now, written(_starred(now), name)
        removed(last)
        if (after := sign(now)) == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
