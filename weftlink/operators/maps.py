"""Maps learned from true pairs: words of Indic scripts, and substitutions in addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftlink.functions.text import ADDRESS_ABBREVIATIONS, INDIC, words


def _stripped(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,()\[\]]+|[.,()\[\]]+$", "")), lambda w: w != "")


def indic_words(pairs: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(word, latin) from true pairs (n1 Latin, n2) of equally many words: the commonest partner, seen ``least`` times and in ``share`` of cases; ties go to the first in order."""
    x = pairs.filter(F.col("n2").rlike(INDIC)).select(_stripped(F.lower("n1")).alias("a"), _stripped(F.col("n2")).alias("b")).filter(F.size("a") == F.size("b"))
    x = x.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.b").alias("word"), F.col("z.a").alias("latin")).filter(F.col("word").rlike(INDIC) & ~F.col("latin").rlike(INDIC))
    return _majority(x, ["word"], "latin").filter((F.col("n") >= least) & (F.col("n") / F.col("total") >= share)).select("word", "latin")


def _majority(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n and total: the commonest value of each key. Counted before the window, so a common key is no hot one."""
    counts = x.groupBy(*keys, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    return counts.withColumns({"total": F.sum("n").over(by), "_k": F.row_number().over(by.orderBy(F.col("n").desc(), value))}).filter("_k = 1").drop("_k")


def substitutions(pairs: DataFrame, reference_items: DataFrame, least: int = 25, share: float = 0.5) -> DataFrame:
    """(country, x, y) from pairs (country, a1, a2) of item arrays that differ by one item, x on side 2 for y on side 1.

    Kept with enough support and share, without digits, where x is rare among ``reference_items`` (country, item) and
    no abbreviation's standard form.
    """
    add, gone = F.array_except("a2", "a1"), F.array_except("a1", "a2")
    x = pairs.filter((F.size(add) == 1) & (F.size(gone) == 1)).select("country", F.get(add, F.lit(0)).alias("x"), F.get(gone, F.lit(0)).alias("y"))
    best = _majority(x, ["country", "x"], "y").filter((F.col("n") >= least) & (F.col("n") / F.col("total") >= share))
    held = reference_items.groupBy("country", F.col("item").alias("x")).agg(F.count("*").alias("held"))
    best = best.filter(~F.concat("x", "y").rlike("[0-9]") & ~F.col("x").isin(sorted(set(ADDRESS_ABBREVIATIONS.values()))))
    return best.join(held, ["country", "x"], "left").filter(F.coalesce("held", F.lit(0)) <= 0.2 * F.col("n")).select("country", "x", "y")


def learned_components(truth: DataFrame, queries: DataFrame, references: DataFrame, least: int = 25) -> DataFrame:
    """(country, x, y): parts of addresses (``ad_parts``, arrays) that true pairs exchange one for one."""
    return _learned(truth, queries.withColumn("items", F.col("ad_parts")), references.withColumn("items", F.col("ad_parts")), least)


def learned_tokens(truth: DataFrame, queries: DataFrame, references: DataFrame, least: int = 25) -> DataFrame:
    """(country, x, y): words of addresses (``ad``) that true pairs exchange one for one, of records normalised with the learned parts."""
    return _learned(truth, queries.withColumn("items", words(F.col("ad"))), references.withColumn("items", words(F.col("ad"))), least)


def _learned(truth: DataFrame, queries: DataFrame, references: DataFrame, least: int) -> DataFrame:
    of = truth.join(queries.select(F.col("id").alias("qid"), "country", F.col("items").alias("a2")), "qid")
    pairs = of.join(references.select(F.col("id").alias("s1"), F.col("items").alias("a1")), "s1").select("country", "a1", "a2")
    held = references.select("country", F.explode(F.array_distinct("items")).alias("item"))
    return substitutions(pairs, held, least)
