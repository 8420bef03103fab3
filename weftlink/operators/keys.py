"""Blocking keys: eleven kinds of strings that two records of one entity are likely to share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftlink.functions.text import words

#: Kinds by number, and the class of cap that each falls under.
KINDS = {0: "n", 1: "nb", 2: "p4", 3: "a", 4: "ab", 5: "#", 6: "nh", 7: "th", 8: "hw", 9: "tw", 10: "nc"}
CAP_CLASS = {0: "single", 1: "other", 2: "other", 3: "single", 4: "single", 5: "single", 6: "other", 7: "cross", 8: "cross", 9: "cross", 10: "other"}


def pairs(a: Column, b: Column, sep: str = "|") -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(sep), y))))


def bigrams(a: Column) -> Column:
    """Neighbours joined by _."""
    return F.when(F.size(a) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))), lambda x, y: F.concat(x, F.lit("_"), y)))


def numbers(address: Column) -> Column:
    """Distinct digit runs without leading zeros."""
    runs = F.regexp_extract_all(address, F.lit("[0-9]+"), 0)
    return F.array_distinct(F.transform(runs, lambda d: F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0"))))


def number_variants(d: Column) -> Column:
    """Runs, and for those of three digits or more what dropping the first digit (and the zeros then leading) or the last gives."""
    short = F.filter(d, lambda x: F.length(x) >= 3)
    first = F.transform(short, lambda x: F.coalesce(F.nullif(F.ltrim(F.substring(x, F.lit(2), F.length(x)), F.lit("0")), F.lit("")), F.lit("0")))
    last = F.transform(short, lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
    return F.array_distinct(F.concat(d, first, last))


def with_keys(records: DataFrame, reference_side: bool, keep: tuple[str, ...] = ("id", "country")) -> DataFrame:
    """(keep..., ty, key), distinct, from records with ``nm``, ``nm_cmp`` and ``ad``. Null fields count as ''. One row in the plan's Generate, no shuffle."""
    nm, cmp_, ad = (F.coalesce(c, F.lit("")) for c in ("nm", "nm_cmp", "ad"))
    x = records.select(*keep, F.filter(words(nm), lambda w: F.length(w) > 1).alias("t"), words(ad).alias("u"), cmp_.alias("c"), numbers(ad).alias("d"))
    x = x.withColumn("w", F.filter("u", lambda w: ~w.rlike("^[0-9]+$") & (F.length(w) > 2)))
    prefixes = F.array_sort(F.transform("t", lambda w: F.substring(w, 1, 4)))
    none = F.array().cast("array<string>")
    name = F.when(F.length("c") > 0, F.array("c")).otherwise(none)
    by_kind = {
        0: F.col("t"), 1: bigrams(F.col("t")), 2: F.when(F.size("t") >= 2, F.array(F.array_join(prefixes, "_"))).otherwise(none),
        3: F.col("w"), 4: bigrams(F.col("u")), 5: number_variants(F.col("d")) if reference_side else F.col("d"),
        6: pairs(name, F.col("d")), 7: pairs(F.col("t"), F.col("d")), 8: pairs(F.col("d"), F.col("w")), 9: pairs(F.col("t"), F.col("w")),
        10: F.when(F.length("c") > 2, F.array("c")).otherwise(none),
    }
    tag = lambda ty: lambda k: F.struct(F.lit(ty).alias("ty"), k.alias("key"))
    tagged = [F.transform(F.array_distinct(a), tag(ty)) for ty, a in by_kind.items()]
    return x.select(*keep, F.explode(F.concat(*tagged)).alias("k")).select(*keep, "k.ty", "k.key")
