"""Two linkage tasks in the tables at hand.

A: businesses. Each customer is a reference, with a name and an address made of its key; each order is a record of its
customer, written in one of sixteen ways for the name and sixteen for the address, and one order in 32 is a record
of a business that has no reference. RAW_SQL makes the raw text, in SQL that Spark and DuckDB read alike.
B: passages. Items of ``benchmark`` are references, documents that contain their text are their queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftlink.functions.text import fold, with_address, with_name, words
from weftlink.operators import block
from weftlink.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digit(h: str, i: int) -> str:
    """The value of a hash's i-th hexadecimal digit."""
    return f"(instr('0123456789abcdef', substr({h}, {i}, 1)) - 1)"


def _word(h: str, i: int) -> str:
    """A pronounceable word of five letters from five digits of a hash."""
    letters = ("bdfghjklmnprstvz", "aeiouaeiouaeioua")
    return "concat(" + ", ".join(f"translate(substr({h}, {i + k}, 1), '0123456789abcdef', '{letters[k % 2]}')" for k in range(5)) + ")"


def _title(word: str) -> str:
    return f"concat(upper(substr({word}, 1, 1)), substr({word}, 2))"


def _case(value: str, kinds: dict[int, str], other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {v}" for k, v in kinds.items()) + f" ELSE {other} END"


LEGAL = _case(_digit("h", 11), {0: "' Inc'", 1: "' Inc'", 2: "' Inc'", 3: "' LLC'", 4: "' LLC'", 5: "' Ltd'", 6: "' Corporation'", 7: "' SARL'"}, "''")
GENERIC = _case(_digit("h", 12), {0: "' Services'", 1: "' Services'", 2: "' Group'", 3: "' Trading'"}, "''")
STREET = _case(_digit("h", 25), {0: "'Avenue'", 1: "'Avenue'", 2: "'Road'", 3: "'Lane'", 4: "'Boulevard'", 5: "'Drive'"}, "'Street'")
UNIT = _case(_digit("h", 26), {0: "', Apt 5'", 1: "', Suite 12'", 2: "', Floor 3'"}, "''")
NAME_WAYS = {
    4: "concat(substr(w1, 1, 2), substr(w1, 4), ' ', w2, generic, legal)", 5: "concat(w2, ' ', w1, generic, legal)", 6: "upper(concat(w1, ' ', w2, generic, legal))",
    7: "concat(replace(w1, 'o', '0'), ' ', replace(w2, 'i', '1'), generic, legal)", 8: "replace(replace(concat(w1, ' ', w2, generic, legal), 'e', 'é'), 'a', 'à')",
    9: "lower(concat('www.', w1, w2, '.com'))", 10: "concat(other, ' LLC dba ', w1, ' ', w2, generic, legal)", 11: "lower(concat('@', w1, w2))",
    12: "concat(w1, ' ', w2, generic, legal, ' (ID: ', o, ')')", 13: "concat(w1, ' ', w2)", 14: "concat(substr(w1, 1, 1), substr(w2, 1, 1))", 15: "concat('The ', w1, ' & ', w2, generic)",
}
ADDRESS_WAYS = {
    6: "concat(hn, ' ', road, ' ', replace(replace(replace(street, 'Street', 'St.'), 'Avenue', 'Ave'), 'Boulevard', 'Blvd'), ', ', city, unit)",
    7: "concat(CASE WHEN hn >= 10 THEN cast(floor(hn / 10) AS bigint) ELSE hn END, ' ', road, ' ', street, ', ', city, unit)", 8: "cast(NULL AS varchar(99))", 9: "''",
    10: "concat(hn, ' ', road, ' ', street, ', ', city)", 11: "concat('No. ', hn, ' ', road, ' ', street, ', ', city, unit)",
    12: "concat(hn, ' ', road, ' ', replace(replace(street, 'Street', 'Stret'), 'Avenue', 'Avenu'), ', ', city, unit)",
    13: "upper(concat(hn, ' ', road, ' ', street, ', ', city, unit))", 14: "concat('00', hn, ' ', road, ' ', street, ', ', city, unit)", 15: "concat(hn, ' ', road, ' ', street, unit)",
}
#: (id, src, country, canon, is_ref, name, address) of all records; canon: the true reference, null for a business without one.
RAW_SQL = f"""
SELECT id, src, country, canon, is_ref, {_case('nway', NAME_WAYS, "concat(w1, ' ', w2, generic, legal)")} AS name, {_case('away', ADDRESS_WAYS, "concat(hn, ' ', road, ' ', street, ', ', city, unit)")} AS address FROM (
  SELECT id, src, country, canon, is_ref, nway, away, o, {_title(_word('fam', 1))} AS w1, {_title('CASE WHEN decoy THEN ' + _word('g', 10) + ' ELSE ' + _word('fam', 6) + ' END')} AS w2, {_title(_word('g', 5))} AS other,
    {GENERIC} AS generic, {LEGAL} AS legal, {_digit('h', 14)} * 256 + {_digit('h', 15)} * 16 + {_digit('h', 16)} + CASE WHEN decoy THEN 5001 ELSE 1 END AS hn,
    {_title(_word('road_h', 1))} AS road, {STREET} AS street, {_title(_word('city_h', 1))} AS city, {UNIT} AS unit FROM (
    SELECT *, CASE WHEN {_digit('h', 13)} < 3 THEN md5(concat('family', c % 97)) ELSE h END AS fam, md5(concat('road', c % 211)) AS road_h, md5(concat('city', c % 31)) AS city_h FROM (
      SELECT c_custkey AS c, c_custkey * 2 AS id, 1 AS src, coalesce(r_name, '') AS country, c_custkey * 2 AS canon, true AS is_ref, false AS decoy, 0 AS nway, 0 AS away, c_custkey AS o, md5(concat('entity', c_custkey)) AS h, md5(concat('entity', c_custkey)) AS g
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
      UNION ALL
      SELECT c, id, src, country, CASE WHEN decoy THEN NULL ELSE c * 2 END AS canon, false AS is_ref, decoy, nway, away, o, h, g FROM (
        SELECT *, {_digit('g', 2)} = 0 AND {_digit('g', 3)} < 8 AS decoy, {_digit('g', 1)} AS nway, {_digit('g', 4)} AS away FROM (
          SELECT o_custkey AS c, o_orderkey * 2 + 1 AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS src, coalesce(r_name, '') AS country, o_orderkey AS o, md5(concat('entity', o_custkey)) AS h, md5(concat('order', o_orderkey)) AS g
          FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey) a) b) d) e) f
"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task A's raw records."""
    return spark.sql(RAW_SQL.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN nation", "JOIN {nation}").replace("JOIN region", "JOIN {region}"), **{t: table(spark, sf_dir, t) for t in ("customer", "orders", "nation", "region")})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task A's normalised records, dealt over all cores first: their tables are narrow, so that few splits hold many rows."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return with_address(with_name(raw_records(spark, sf_dir).repartition(parts, "id"), "name"), "address")


class Task:
    """Task A, each part written when it is first asked for, so that no query works it out twice."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def records(self) -> DataFrame:
        return written(records(self.spark, self.sf_dir), "records")

    @property
    def refs(self) -> DataFrame:
        return self.records.filter("is_ref")

    @property
    def queries(self) -> DataFrame:
        return self.records.filter("NOT is_ref")

    @property
    def truth(self) -> DataFrame:
        """(qid, s1) of records that have a reference."""
        return self.queries.filter("canon IS NOT NULL").select(F.col("id").alias("qid"), F.col("canon").alias("s1"))

    @property
    def entities(self) -> DataFrame:
        """(s1, country) of all references."""
        return self.refs.select(F.col("id").alias("s1"), "country")

    @property
    def countries(self) -> DataFrame:
        """(qid, country) of all queries."""
        return self.queries.select(F.col("id").alias("qid"), "country")

    @cached_property
    def candidates(self) -> DataFrame:
        return written(block.candidates(self.refs, self.queries), "candidates")

    @cached_property
    def pruned(self) -> DataFrame:
        return written(block.prune(self.candidates), "pruned")

    @cached_property
    def pairs(self) -> DataFrame:
        """(qid, s1, country, p): pruned candidates with a probability that only their score makes."""
        score = F.round("score", 6)
        p = self.pruned.withColumn("p", F.round(score / (score + 20.0), 6))
        return p.join(self.queries.select(F.col("id").alias("qid"), "country"), "qid").select("qid", "s1", "country", "p")


def passages(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """(doc_id, item_id, nk, share): task B's matches by five-word shingles, all of which count; an item of fewer words is one phrase. A pair counts with half of an item's shingles. Items of equal words are compared once.

    Documents' shingles are hashes until the benchmark's are joined, which are few; equal hashes are compared as words there.
    """
    tokens = lambda df, key: df.select(F.col(key), words(fold(F.col("text"))).alias("w"))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    grams = lambda df, key, n: df.filter(F.size("w") >= n).select(key, F.explode(F.array_distinct(gram(n))).alias("k"))
    items = tokens(table(spark, sf_dir, "benchmark"), "item_id").filter(F.size("w") > 0).withColumn("passage", F.md5(F.array_join("w", " ")))
    items = written(items, "items")
    members = items.select("item_id", "passage").distinct()
    distinct = items.select("passage", "w").distinct()
    short = distinct.filter(F.size("w") < size)
    keys = written(grams(distinct, "passage", size).unionByName(short.select("passage", F.array_join("w", " ").alias("k"))), "keys")
    n = keys.groupBy("passage").agg(F.count("*").alias("n"))
    docs = tokens(table(spark, sf_dir, "documents"), "doc_id")
    lengths = sorted(r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect())  # fewer than size
    every = F.flatten(F.array(*[F.when(F.size("w") >= k, gram(k)).otherwise(F.array().cast("array<string>")) for k in (*lengths, size)]))
    found = docs.select("doc_id", F.explode(F.array_distinct(every)).alias("k"))
    hits = found.join(keys, "k").groupBy("doc_id", "passage").agg(F.count("*").alias("nk"))
    pairs = hits.join(n, "passage").withColumn("share", F.round(F.col("nk") / F.col("n"), 6)).filter("share >= 0.5")
    return pairs.join(members, "passage").select("doc_id", "item_id", "nk", "share")
