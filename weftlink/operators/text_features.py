"""Text statistics of records: shared values, common words, TF-IDF cosine."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftlink.functions.text import words

#: Terms whose weights are broadcast, at most.
VOCABULARY = 200_000


def shared_counts(references: DataFrame, field: str, name: str) -> DataFrame:
    """(country, field, name): how many references of a country hold a value; empty values are left out."""
    return references.filter(F.col(field) != "").groupBy("country", field).agg(F.count("*").alias(name))


def core_address(records: DataFrame, share: float = 0.02, field: str = "ad", out: str = "adk") -> DataFrame:
    """(id, out): the address without words, other than numbers, that over ``share`` of the country's records hold. Words keep their order; repeats stay.

    Document frequencies are counted once a record, and common words are few, so they come back as one small map a country.
    """
    n = records.groupBy("country").agg(F.count("*").alias("n"))
    df = records.select("country", F.explode(F.array_distinct(words(F.col(field)))).alias("t")).groupBy("country", "t").agg(F.count("*").alias("df"))
    common = df.join(n, "country").filter((F.col("df") > share * F.col("n")) & ~F.col("t").rlike("^[0-9]+$"))
    lists = common.groupBy("country").agg(F.collect_set("t").alias("common"))  # at most 1/share words a record on average
    x = records.join(lists, "country", "left")
    kept = F.filter(words(F.col(field)), lambda w: ~F.coalesce(F.array_contains("common", w), F.lit(False)))
    return x.select("id", F.array_join(kept, " ").alias(out))


def terms(text: Column, grams: int = 0) -> Column:
    """The words of folded text, or the letter n-grams of each padded word."""
    tokens = words(text)
    if not grams:
        return tokens
    return F.flatten(F.transform(tokens, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - grams, F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(grams)))))


def tfidf(records: DataFrame, field: str, grams: int = 0) -> DataFrame:
    """(id, t, w): unit TF-IDF rows over words, or over the letter n-grams of each padded word. tf: 1 + ln; idf: ln((1 + n) / (1 + df)) + 1."""
    tf = records.select("id", F.explode(terms(F.col(field), grams)).alias("t")).groupBy("id", "t").agg(F.count("*").alias("n"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    total = records.agg(F.count("*").alias("n")).first()["n"]
    raw = tf.join(df, "t").select("id", "t", ((1 + F.log("n")) * (F.log((1.0 + total) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "t", (F.col("w") / F.col("norm")).alias("w"))


def cosine(pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(qid, s1, name): the TF-IDF cosine of candidate pairs only; pairs without a common term have 0."""
    left = pairs.select("qid", "s1").join(rows.select(F.col("id").alias("qid"), "t", F.col("w").alias("wq")), "qid")
    both = left.join(rows.select(F.col("id").alias("s1"), "t", F.col("w").alias("ws")), ["s1", "t"])
    found = both.groupBy("qid", "s1").agg(F.sum(F.col("wq") * F.col("ws")).alias(name))
    return pairs.select("qid", "s1").join(found, ["qid", "s1"], "left").fillna(0.0, [name])


def vocabulary_cosine(records: DataFrame, field: str, grams: int = 0, most: int = VOCABULARY) -> Callable[[Column, Column], Column] | None:
    """The cosine of tfidf() as a function of two text columns of ``records``' field, 0 where a side has no terms; None if the records have over ``most`` terms.

    Rows of terms are neither written nor joined: every task has the terms' idf and works from both texts.
    """
    df = records.select(F.explode(F.array_distinct(terms(F.col(field), grams))).alias("t")).groupBy("t").agg(F.count("*").alias("df")).limit(most + 1)
    total = records.count()
    found = df.select("t", (F.log((1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    if len(found) > most:
        return None
    shared = records.sparkSession.sparkContext.broadcast({r["t"]: r["idf"] for r in found})

    def row(text: str, idf: dict[str, float]) -> dict[str, float]:
        n: dict[str, int] = {}
        for w in text.split(" "):
            if w:
                padded = f" {w} "
                for t in (padded[i : i + grams] for i in range(max(len(padded) + 1 - grams, 1))) if grams else (w,):
                    n[t] = n.get(t, 0) + 1
        out = {t: idf[t] if k == 1 else (1 + math.log(k)) * idf[t] for t, k in n.items()}
        norm = math.sqrt(sum(w * w for w in out.values()))
        return {t: w / norm for t, w in out.items()}

    @F.pandas_udf("double")
    def cosine_of(left: pd.Series, right: pd.Series) -> pd.Series:
        idf, rows = shared.value, {}
        of = lambda text: rows[text] if text in rows else rows.setdefault(text, row(text, idf))
        return pd.Series([sum(w * b[t] for t, w in of(x or "").items() if t in b) if (b := of(y or "")) else 0.0 for x, y in zip(left, right, strict=True)], dtype="float64")

    return cosine_of
