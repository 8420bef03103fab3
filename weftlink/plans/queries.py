"""A query for each operator, on the tasks of plans.tasks, and the same results as DuckDB SQL where SQL can tell them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftlink.functions import fuzzy
from weftlink.functions.sampling import bucket, bucket_sql
from weftlink.functions.text import ACCENTED, ADDRESS_FIELDS, NAME_FIELDS, PLAIN, consonants, unleet, with_address, with_name, words
from weftlink.operators import block, chain, context, decide, features, keys, maps, model, stage2, text_features, tune, world
from weftlink.plans import tasks
from weftlink.plans.base_sql import BASE, WORLD
from weftlink.sources import tables
from weftlink.sources.artefacts import feature_names
from weftlink.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {BASE.strip()}{sql if sql.startswith(',') else chr(10) + sql}"
        return f

    return add


@query("SELECT id, country, src, canon, is_ref, name, address FROM raw")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task A's raw text."""
    return tasks.raw_records(spark, sf_dir)


@query("SELECT id, country, src, canon, is_ref, nm, nm_cmp, ad, ad_hn FROM tok")
def link_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.records(spark, sf_dir).select("id", "country", "src", "canon", "is_ref", "nm", "nm_cmp", "ad", "ad_hn")


@query("SELECT id, nm, nm_s, nm_cmp, nm_alt, nm_leg, flags FROM rec")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_name(tasks.raw_records(spark, sf_dir), "name").select("id", *NAME_FIELDS)


@query("SELECT id, ad, ad_nums, ad_hn, ad_unit FROM rec")
def normalised_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_address(tasks.raw_records(spark, sf_dir), "address").select("id", *ADDRESS_FIELDS)


@query("SELECT s.src, count(*) AS n, count(DISTINCT id) AS n_ids, count(*) FILTER (rec.src <> s.src) AS n_foreign FROM (SELECT unnest([1, 2, 3]) AS src) s JOIN rec ON rec.is_ref = (s.src = 1) GROUP BY s.src")
def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source. Sources 2 and 3 share a file here, so that each finds the other's ids foreign."""
    t = tasks.Task(spark, sf_dir)
    x = t.records.withColumn("entity_id", F.concat(F.lit("S"), "src", F.lit("-"), "id"))
    rows = [tables.audit(x.filter(F.col("is_ref") == (n == 1)), n).select(F.lit(n).alias("src"), "n", "n_ids", "n_foreign") for n in (1, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT country, count(*) AS n FROM rec GROUP BY ALL")
def country_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return t.records.groupBy("country").agg(F.count("*").alias("n"))


@query("SELECT 'S1-' || s1 AS s1, 'S' || src || '-' || qid AS qid, src FROM truth JOIN (SELECT id AS qid, src FROM rec) USING (qid)")
def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth as one row a reference with joined ids, taken apart again."""
    t = tasks.Task(spark, sf_dir)
    named = t.queries.filter("canon IS NOT NULL").select(F.concat(F.lit("S1-"), "canon").alias("source1_entity_id"), F.concat(F.lit("S"), "src", F.lit("-"), "id").alias("qid"))
    joined = named.groupBy("source1_entity_id").agg(F.array_join(F.collect_list("qid"), ",").alias("matched_entity_ids"))
    return tables.true_pairs(joined).select("s1", "qid", "src")


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id FROM rec")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return tables.numbered(t.records.select("id"), "id").select("idx", "id")


@query("SELECT id, country, is_ref, ty, key FROM allkeys")
def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries = t.refs, t.queries
    keep = ("id", "country", "is_ref")
    return keys.with_keys(refs, True, keep).unionByName(keys.with_keys(queries, False, keep))


@query("SELECT country, ty, key, df, round(w, 6) AS w FROM weights")
def key_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs = t.refs
    return block.key_weights(keys.with_keys(refs, True), refs).withColumn("w", F.round("w", 6))


@query("SELECT qid, s1, round(score, 6) AS score, nk, rank FROM cand")
def block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return t.candidates.withColumn("score", F.round("score", 6)).select("qid", "s1", "score", "nk", "rank")


@query("""SELECT * FROM (SELECT count(*) AS n_true, count(rank) AS n_found, """ + ", ".join(f"round(count(*) FILTER (rank <= {k})::DOUBLE / count(*), 6) AS recall_at_{k}" for k in (1, 2, 3, 5, 8, 12)) + """ FROM truth LEFT JOIN cand USING (qid, s1)),
(SELECT round(avg(CASE WHEN g = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25::DOUBLE * tp / (tp + 0.25::DOUBLE * g) END), 6) AS oracle_f05, count(*) FILTER (g > 0 AND tp = 0) AS lost FROM (
  SELECT id, count(qid) AS g, count(rank) AS tp FROM (SELECT id FROM rec WHERE is_ref) LEFT JOIN (SELECT truth.s1 AS id, qid, rank FROM truth LEFT JOIN cand USING (qid, s1)) USING (id) GROUP BY id))""")
def blocking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, truth = t.refs, t.truth
    return block.oracle_report(t.candidates, truth, refs)


ROUNDED = ("score", "rel", "gap_best", "gap_second")


@query("SELECT qid, s1, nk, rank, q_ncand_raw, s_ncand, s_rank, round(score, 5) AS score, round(rel, 5) AS rel, round(gap_best, 5) AS gap_best, round(gap_second, 5) AS gap_second FROM pruned")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return t.pruned.withColumns({c: F.round(c, 5) for c in ROUNDED})


@query("SELECT country, nm, count(*) AS n FROM rec WHERE is_ref AND nm <> '' GROUP BY ALL")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs = t.refs
    return text_features.shared_counts(refs, "nm", "n")


@query("""SELECT id, array_to_string(list_filter(u, lambda x: NOT list_contains(coalesce(common, []), x)), ' ') AS adk FROM tok LEFT JOIN (
  SELECT country, list(t) AS common FROM (SELECT country, t, count(*) AS df FROM (SELECT country, unnest(list_distinct(u)) AS t FROM tok) GROUP BY ALL) JOIN (SELECT country, count(*) AS n FROM rec GROUP BY ALL) USING (country)
  WHERE df > 0.02::DOUBLE * n AND NOT regexp_full_match(t, '[0-9]+') GROUP BY country) USING (country)""")
def core_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return text_features.core_address(t.records)


TFIDF = """, tf AS (SELECT id, t, count(*) AS n FROM (SELECT id, {tokens} AS t FROM tok) WHERE t <> '' GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY ALL),
weighed AS (SELECT id, t, (1 + ln(n)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM rec)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (t)),
unit AS (SELECT id, t, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM weighed)
SELECT qid, s1, round(coalesce(c, 0), 6) AS {name} FROM pruned LEFT JOIN (SELECT qid, s1, sum(a.w * b.w) AS c FROM pruned JOIN unit a ON a.id = qid JOIN unit b ON b.id = s1 AND b.t = a.t GROUP BY ALL) USING (qid, s1)"""


def _cosine(spark: SparkSession, sf_dir: str, field: str, grams: int, name: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    rows = text_features.tfidf(t.records, field, grams)
    return text_features.cosine(t.pruned, rows, name).withColumn(name, F.round(name, 6)).select("qid", "s1", name)


def name_word_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir, "nm", 0, "nm_word_cos")


def address_word_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir, "ad", 0, "ad_word_cos")


def name_char_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir, "nm", 3, "nm_char_cos")


for f, tokens in ((name_word_cosine, "unnest(string_split(nm, ' '))"), (address_word_cosine, "unnest(u)"), (name_char_cosine, "unnest(flatten(list_transform(list_filter(string_split(nm, ' '), lambda x: x <> ''), lambda x: list_transform(range(1, greatest(length(x), 1) + 1), lambda i: substr(' ' || x || ' ', i, 3)))))")):
    QUERIES[f.__name__] = f
    ORACLES[f.__name__] = f"WITH {BASE.strip()}" + TFIDF.format(tokens=tokens, name={"name_word_cosine": "nm_word_cos", "address_word_cosine": "ad_word_cos", "name_char_cosine": "nm_char_cos"}[f.__name__])


@query("""SELECT qid, s1, (q.nm = s.nm)::INT AS nm_exact, (q.nm_cmp = s.nm_cmp)::INT AS cmp_exact, (length(q.nm) - length(replace(q.nm, ' ', '')) + 1)::INT AS nm_ntok_q, (length(s.ad) - length(replace(s.ad, ' ', '')) + 1)::INT AS ad_ntok_s,
(q.ad = '')::INT AS ad_q_empty, (q.ad_hn <> '' AND q.ad_hn = s.ad_hn)::INT AS hn_eq, (q.ad_hn <> '' AND s.ad_hn <> '' AND q.ad_hn <> s.ad_hn AND (starts_with(q.ad_hn, s.ad_hn) OR starts_with(s.ad_hn, q.ad_hn) OR ends_with(q.ad_hn, s.ad_hn) OR ends_with(s.ad_hn, q.ad_hn)))::INT AS hn_trunc,
(q.ad_hn = '')::INT AS hn_q_missing, len(list_distinct(list_intersect(q.d, s.d)))::INT AS nums_common, (q.src = 3)::INT AS src3,
coalesce(abs(try_cast(q.ad_hn AS DOUBLE) - try_cast(s.ad_hn AS DOUBLE)) / greatest(try_cast(q.ad_hn AS DOUBLE), try_cast(s.ad_hn AS DOUBLE), 1), -1) AS hn_reldiff,
(list_reduce(list_prepend('', list_transform(list_filter(string_split(s.nm, ' '), lambda x: x <> ''), lambda x: substr(x, 1, 1))), lambda a, b: a || b) = q.nm_cmp)::INT AS acr_eq,
CASE WHEN q.ad_hn <> '' AND s.ad_hn <> '' THEN levenshtein(q.ad_hn, s.ad_hn) ELSE -1 END::INT AS hn_lev, levenshtein(q.nm, s.nm)::INT AS nm_lev, levenshtein(q.nm_cmp, s.nm_cmp)::INT AS cmp_lev
FROM pruned JOIN tok q ON q.id = qid JOIN tok s ON s.id = s1""")
def exact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries = t.refs, t.queries
    x = features.both_sides(t.pruned, queries, refs)
    names = ("nm_exact", "cmp_exact", "nm_ntok_q", "ad_ntok_s", "ad_q_empty", "hn_eq", "hn_trunc", "hn_q_missing", "nums_common", "src3", "hn_reldiff", "acr_eq", "hn_lev", "nm_lev", "cmp_lev")
    of = features.exact_features()
    return x.select("qid", "s1", *[of[n].alias(n) for n in names])


@query()
def fuzzy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries = t.refs, t.queries
    cores = text_features.core_address(t.records)
    x = features.both_sides(t.pruned, queries.join(cores, "id"), refs.join(cores, "id"))
    return x.select("qid", "s1", *[c.alias(n) for n, c in features.fuzzy_features().items()])


@query("SELECT qid, s1, round(CASE WHEN q.nm = '' OR s.nm = '' THEN (q.nm = s.nm)::INT ELSE jaro_winkler_similarity(q.nm, s.nm) END, 6) AS jw FROM pruned JOIN rec q ON q.id = qid JOIN rec s ON s.id = s1")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries = t.refs, t.queries
    x = features.both_sides(t.pruned, queries, refs, ("nm",))
    return x.select("qid", "s1", F.round(fuzzy.score("jw", F.col("q_nm"), F.col("s_nm")), 6).alias("jw"))


@query()
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries = t.refs, t.queries
    return features.build(t.pruned, queries, refs)


@query(f"""SELECT qid, s1, y, cluster, {bucket_sql('cluster', 11, 4)} AS fold, {bucket_sql('cluster', 23, 1000)} / 1000.0::DOUBLE AS u FROM (
SELECT pruned.qid, pruned.s1, coalesce(pruned.s1 = truth.s1, false)::INT AS y, coalesce('s' || truth.s1, 'q' || qid) AS cluster FROM pruned LEFT JOIN truth USING (qid))""")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    truth = t.truth
    return world.with_folds(t.pruned.select("qid", "s1"), truth).select("qid", "s1", "y", "cluster", "fold", "u")


@query("SELECT id, country, 1 AS kept FROM kept UNION ALL SELECT id, country, 0 FROM rec WHERE is_ref AND id NOT IN (SELECT id FROM kept)")
def kept_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs = t.refs
    side = lambda df, k: df.select("id", "country", F.lit(k).alias("kept"))
    return side(world.kept(refs, WORLD), 1).unionByName(side(world.dropped(refs, WORLD), 0))


@query(f"""SELECT id, country FROM (SELECT id, country, CASE WHEN canon IN (SELECT id FROM kept) THEN 'true' WHEN canon IS NOT NULL THEN 'orphan' ELSE 'natural' END AS kind FROM rec WHERE NOT is_ref) x JOIN (
  SELECT *, least(o, want - want_n) AS want_o FROM (SELECT *, least(n, round(n / "all"::DOUBLE * (t + want))) AS want_n FROM (SELECT *, least(n + o, round(t * target / (1 - target))) AS want FROM (
  SELECT country, count(*) AS "all", count(*) FILTER (canon IN (SELECT id FROM kept)) AS t, count(*) FILTER (canon IS NOT NULL AND canon NOT IN (SELECT id FROM kept)) AS o, count(*) FILTER (canon IS NULL) AS n,
  CASE WHEN country = 'ASIA' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS target FROM rec WHERE NOT is_ref GROUP BY country)))) USING (country)
WHERE kind = 'true' OR {bucket_sql('id', WORLD.seed + 1, world.BUCKETS)} < CASE WHEN kind = 'natural' THEN CASE WHEN n > 0 THEN ceil({world.BUCKETS} * want_n / n) ELSE 0 END ELSE CASE WHEN o > 0 THEN ceil({world.BUCKETS} * want_o / o) ELSE 0 END END""")
def world_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries, truth = t.refs, t.queries, t.truth
    return world.select_queries(queries, truth, world.kept(refs, WORLD), WORLD).select("id", "country")


@query("SELECT id, country FROM rec WHERE NOT is_ref AND (canon IN (SELECT id FROM kept) OR canon IS NULL AND id IN (SELECT qid FROM cand WHERE rank = 1 AND s1 IN (SELECT id FROM kept)))")
def anchored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries, truth = t.refs, t.queries, t.truth
    return world.select_anchored(queries, truth, world.kept(refs, WORLD), t.candidates.filter("rank = 1")).select("id", "country")


@query("""SELECT qid, s1, q_n, q_isbest, s_nconf, s_nbest, s_prank, round(q_pmax, 6) AS q_pmax, round(q_p2, 6) AS q_p2, round(q_psum, 6) AS q_psum, round(p / (q_psum + 0.000001::DOUBLE), 6) AS q_share, round(p - CASE WHEN q_isbest = 1 THEN q_p2 ELSE q_pmax END, 6) AS q_margin,
round(s_psum, 6) AS s_psum, round(s_psum_best, 6) AS s_psum_best, round(s_pmax, 6) AS s_pmax, round(CASE WHEN p >= s_pmax THEN s_p2 ELSE s_pmax END, 6) AS s_pmax_other FROM (
SELECT *, sum(p) OVER s AS s_psum, count(*) FILTER (p > 0.5) OVER s AS s_nconf, (sum(q_isbest) OVER s)::BIGINT AS s_nbest, sum(p * q_isbest) OVER s AS s_psum_best, max(p) OVER s AS s_pmax, coalesce(list_sort(list(p) OVER s, 'DESC')[2], 0) AS s_p2, least(row_number() OVER (PARTITION BY s1 ORDER BY p DESC, qid), 8)::INT AS s_prank FROM (
SELECT *, (p >= q_pmax)::INT AS q_isbest FROM (SELECT *, max(p) OVER q AS q_pmax, coalesce(list_sort(list(p) OVER q, 'DESC')[2], 0) AS q_p2, sum(p) OVER q AS q_psum, count(*) OVER q AS q_n FROM pairs WINDOW q AS (PARTITION BY qid))) WINDOW s AS (PARTITION BY s1))""")
def context_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    x = context.competition(t.pairs)
    rounded = ("q_pmax", "q_p2", "q_psum", "q_share", "q_margin", "s_psum", "s_psum_best", "s_pmax", "s_pmax_other")
    return x.select("qid", "s1", "q_n", "q_isbest", "s_nconf", "s_nbest", "s_prank", *[F.round(c, 6).alias(c) for c in rounded])


def _sib(name: str, keys_: str, own: str) -> str:
    by = f"OVER (PARTITION BY s1, {keys_})"
    return f"CASE WHEN {own} <> '' THEN (sum(conf) {by} - conf)::BIGINT ELSE -1 END AS sib_{name}_same, round(CASE WHEN {own} <> '' THEN sum(p) {by} - p ELSE -1 END, 6) AS sib_{name}_same_p"


@query(f"""SELECT qid, s1, {_sib('hn', 'hq', 'hq')}, {_sib('nm', 'nq', 'nq')}, {_sib('both', 'hq, nq', 'hq')}, {_sib('ad', 'aq', 'aq')},
(sum(he * conf) OVER s - he * conf)::BIGINT AS sib_hn_eq_s, round(sum(he * p) OVER s - he * p, 6) AS sib_hn_eq_s_p, (sum(ne * conf) OVER s - ne * conf)::BIGINT AS sib_nm_eq_s, round(sum(ne * p) OVER s - ne * p, 6) AS sib_nm_eq_s_p FROM (
SELECT qid, s1, p, (p > 0.5)::INT AS conf, q.ad_hn AS hq, q.nm_cmp AS nq, q.ad AS aq, (q.ad_hn = s.ad_hn)::INT AS he, (q.nm_cmp = s.nm_cmp)::INT AS ne FROM pairs JOIN tok q ON q.id = qid JOIN tok s ON s.id = s1) WINDOW s AS (PARTITION BY s1)""")
def sibling_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, queries = t.refs, t.queries
    x = context.siblings(t.pairs, queries, refs)
    return x.select(*[F.round(c, 6).alias(c) if c.endswith("_p") else c for c in x.columns])


@query("SELECT qid, s1, p FROM assigned")
def assign_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return decide.argmax(t.pairs).select("qid", "s1", "p")


@query("SELECT s1, qid FROM assigned WHERE p >= 0.8::DOUBLE")
def threshold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(tasks.Task(spark, sf_dir))


def _matches(t: tasks.Task) -> DataFrame:
    return decide.by_threshold(decide.argmax(t.pairs), 0.8)


@query("SELECT qid, s1, round(p * r / (p * r + 1 - p), 6) AS p FROM (SELECT *, CASE country WHEN 'AFRICA' THEN 0.5::DOUBLE WHEN 'ASIA' THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS r FROM assigned)")
def odds_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    x = decide.argmax(t.pairs)
    return x.select("qid", "s1", F.round(decide.shrink_odds(F.col("p"), decide.parse_odds("AFRICA:0.5,ASIA:0.3,*:0.8"), F.col("country")), 6).alias("p"))


EXPECTED = """SELECT s1, qs[unnest(range(1, k + 1))] AS qid, k, round(e, 6) AS expected FROM (
SELECT s1, qs, k, e FROM (
SELECT s1, qs, k, CASE WHEN k = 0 THEN list_product(list_transform(ps, lambda x: 1 - x)) * ws[1] ELSE (
  SELECT sum(taken[t + 1] * lft[o + 1] * ws[j + 1] * 1.25::DOUBLE * t / (k + 0.25::DOUBLE * (t + o + j))) FROM (SELECT unnest(range(0, len(taken))) AS t), (SELECT unnest(range(0, len(lft))) AS o), (SELECT unnest([0, 1, 2]) AS j)) END AS e FROM (
SELECT *, list_reduce(list_prepend([1.0::DOUBLE], list_transform(ps[1:k], lambda x: [x])), lambda a, x: list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0) * (1 - x[1]) + CASE WHEN i > 1 THEN a[i - 1] * x[1] ELSE 0 END)) AS taken,
  list_reduce(list_prepend([1.0::DOUBLE], list_transform(ps[k + 1:], lambda x: [x])), lambda a, x: list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0) * (1 - x[1]) + CASE WHEN i > 1 THEN a[i - 1] * x[1] ELSE 0 END)) AS lft FROM (
SELECT s1, ps, qs, [exp(-lam), exp(-lam) * lam, 1 - exp(-lam) - exp(-lam) * lam] AS ws, unnest(range(0, len(ps) + 1)) AS k FROM (
SELECT s1, list(p ORDER BY p DESC, qid) AS ps, list(qid ORDER BY p DESC, qid) AS qs, any_value(lam) AS lam FROM (
SELECT *, __MISS__::DOUBLE * sum(p) OVER (PARTITION BY s1) AS lam, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, qid) AS n FROM assigned) WHERE n <= 16 GROUP BY s1))))
QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(e, 12) DESC, k) = 1)""".replace("list_product(list_transform(ps, lambda x: 1 - x))", "list_reduce(list_prepend(1.0::DOUBLE, list_transform(ps, lambda x: 1 - x)), lambda a, b: a * b)")


def expected_sql(miss: float, source: str = "assigned") -> str:
    return EXPECTED.replace("__MISS__", str(miss)).replace("FROM assigned", f"FROM {source}")


@query(expected_sql(0.02))
def expected_f_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    x = decide.by_expected_f(decide.argmax(t.pairs), miss_odds=0.02)
    return x.withColumn("expected", F.round("expected", 6)).withColumn("k", F.col("k").cast("long"))


@query("""SELECT count(*) AS n, round(avg(CASE WHEN g = 0 AND k = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25::DOUBLE * tp / (k + 0.25::DOUBLE * g) END), 6) AS f05 FROM (SELECT id AS s1 FROM rec WHERE is_ref)
LEFT JOIN (SELECT s1, count(*) AS k_ FROM assigned WHERE p >= 0.8::DOUBLE GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS g_ FROM truth GROUP BY s1) USING (s1)
LEFT JOIN (SELECT s1, count(*) AS tp_ FROM assigned JOIN truth USING (s1, qid) WHERE p >= 0.8::DOUBLE GROUP BY s1) USING (s1), LATERAL (SELECT coalesce(k_, 0) AS k, coalesce(g_, 0) AS g, coalesce(tp_, 0) AS tp)""")
def macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs, truth = t.refs, t.truth
    return decide.macro_f05(_matches(t), truth, refs.select(F.col("id").alias("s1")))


@query("SELECT id AS s1, coalesce(ids, '') AS matched FROM (SELECT id FROM rec WHERE is_ref) LEFT JOIN (SELECT s1 AS id, string_agg(q, ',' ORDER BY q) AS ids FROM (SELECT DISTINCT s1, qid::VARCHAR AS q FROM assigned WHERE p >= 0.8::DOUBLE) GROUP BY s1) USING (id)")
def match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs = t.refs
    return tables.id_lists(refs, _matches(t), "matched")


@query("SELECT (SELECT count(*) FROM rec WHERE is_ref) AS n_refs, (SELECT count(DISTINCT id) FROM rec WHERE is_ref) AS n_ref_ids, (SELECT count(*) FROM assigned WHERE p >= 0.8::DOUBLE) AS n_matches, 0::BIGINT AS n_foreign")
def output_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    refs = t.refs
    return tables.contract(refs, _matches(t), t.candidates)


@query("SELECT qid, s1, round(avg(p), 6) AS p FROM (SELECT qid, s1, p FROM pairs UNION ALL SELECT qid, s1, p * p FROM pairs WHERE p > 0.7::DOUBLE) GROUP BY ALL")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    x = t.pairs
    return model.ensemble([x, x.filter("p > 0.7D").withColumn("p", F.col("p") * F.col("p"))]).withColumn("p", F.round("p", 6))


@query("SELECT qid, s1, round((p + p * p) / 2, 6) AS p FROM pairs WHERE p > 0.7::DOUBLE")
def stack_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    x = t.pairs
    return model.stacked([x, x.filter("p > 0.7D").withColumn("p", F.col("p") * F.col("p"))]).withColumn("p", F.round("p", 6))


@query("SELECT qid, s1, round(1 / (1 + exp(-(0.9::DOUBLE * ln(greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE))) + 0.4::DOUBLE * (p - 0.5::DOUBLE) - 0.1::DOUBLE))), 6) AS p FROM pairs")
def blend_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return t.pairs.select("qid", "s1", F.round(model.blended(F.col("p"), F.col("p") - 0.5, 0.9, 0.4, -0.1), 6).alias("p"))


LEARNED = """(SELECT country, x, y FROM (SELECT *, sum(n) OVER (PARTITION BY country, x) AS total, row_number() OVER (PARTITION BY country, x ORDER BY n DESC, y) AS k FROM (
SELECT country, x, y, count(*) AS n FROM (SELECT q.country, list_filter(q.items, lambda a: NOT list_contains(s.items, a)) AS add, list_filter(s.items, lambda a: NOT list_contains(q.items, a)) AS gone, list_distinct(add)[1] AS x, list_distinct(gone)[1] AS y FROM truth JOIN {side} q ON q.id = qid JOIN {side} s ON s.id = s1)
WHERE len(list_distinct(add)) = 1 AND len(list_distinct(gone)) = 1 GROUP BY country, x, y)) b LEFT JOIN (SELECT country, item AS x, count(*) AS held FROM (SELECT country, unnest(list_distinct(items)) AS item FROM {side} WHERE is_ref) GROUP BY ALL) h USING (country, x)
WHERE k = 1 AND n >= {least} AND n / total::DOUBLE >= 0.5 AND NOT regexp_matches(x || y, '[0-9]') AND x NOT IN ('""" + "','".join(sorted(set(maps.ADDRESS_ABBREVIATIONS.values()))) + """') AND coalesce(held, 0) <= 0.2::DOUBLE * n)"""


@query("SELECT * FROM " + LEARNED.format(side="(SELECT *, u AS items FROM tok)", least=2))
def learned_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of addresses that true pairs exchange one for one."""
    t = tasks.Task(spark, sf_dir)
    return maps.learned_tokens(t.truth, t.queries, t.refs, least=2)


SINGLE = "translate(w, 'aeiouyhw', '')"
for letter in "bcdfgjklmnpqrstvxz0123456789":  # RE2 has no references to groups
    SINGLE = f"regexp_replace({SINGLE}, '{letter}{letter}+', '{letter}', 'g')"


@query(f"""SELECT id, {SINGLE} AS c, CASE WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '^[0-9]+(st|nd|rd|th|er|e|eme)$') THEN translate(w, '01568', 'olsgb') ELSE w END AS plain
FROM (SELECT id, coalesce(list_filter(string_split(lower(coalesce(name, '')), ' '), lambda x: x <> '' AND regexp_full_match(x, '[a-z0-9]+'))[1], '') AS w FROM raw)""")
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consonants and undone digits of each raw name's first word of letters and digits."""
    first = F.get(F.filter(words(F.lower(F.coalesce("name", F.lit("")))), lambda w: w.rlike("^[a-z0-9]+$")), F.lit(0))
    x = tasks.raw_records(spark, sf_dir).select("id", F.coalesce(first, F.lit("")).alias("w"))
    return x.select("id", consonants(F.col("w")).alias("c"), unleet(F.col("w")).alias("plain"))


F05 = "CASE WHEN g = 0 AND k = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25::DOUBLE * tp / (k + 0.25::DOUBLE * g) END"
GRID_SQL = "(SELECT unnest([" + ", ".join(map(str, tune.GRID)) + "]::DOUBLE[]) AS tau)"


def sets_sql(pred: str, keys_: str, rules: str) -> str:
    """(keys, s1, country, g, f) for predictions (keys, s1, qid) under each of the rules (keys)."""
    return f"""(SELECT {keys_}, s1, country, g, {F05} AS f FROM (SELECT {keys_}, id AS s1, country, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(tp, 0) AS tp FROM (SELECT id, country FROM rec WHERE is_ref) e CROSS JOIN {rules} r
LEFT JOIN (SELECT s1 AS id, count(*) AS g FROM truth GROUP BY ALL) USING (id)
LEFT JOIN (SELECT {keys_}, p.s1 AS id, count(*) AS k, count(truth.qid) AS tp FROM {pred} p LEFT JOIN truth ON truth.s1 = p.s1 AND truth.qid = p.qid GROUP BY ALL) USING (id, {keys_})))"""


AT_TAUS = f"(SELECT tau, s1, qid FROM assigned, {GRID_SQL} WHERE p >= tau)"


@query(f""", rules AS (SELECT 'tau_' || tau AS rule FROM {GRID_SQL} UNION ALL SELECT 'ef_raw' UNION ALL SELECT 'ef_raw_miss'),
preds AS (SELECT 'tau_' || tau AS rule, s1, qid FROM {AT_TAUS} UNION ALL SELECT 'ef_raw', s1, qid FROM ({expected_sql(0.0)}) UNION ALL SELECT 'ef_raw_miss', s1, qid FROM ({expected_sql(0.02)})),
scores AS (SELECT rule, round(avg(f), 6) AS f05 FROM {sets_sql('preds', 'rule', 'rules')} GROUP BY ALL)
SELECT rule, f05, row_number() OVER (ORDER BY f05 DESC, rule) = 1 AS chosen FROM scores""")
def tuned_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and expected-F rules on raw scores; isotonic rules are in tune.tuned too, which SQL can't follow."""
    t = tasks.Task(spark, sf_dir)
    return tune.tuned(decide.argmax(t.pairs), t.truth, t.entities, 0.02, isotonic=False)


@query(f"SELECT country, count(*) AS n, round(avg(f), 6) AS f05, count(*) FILTER (g = 0) AS n_single, round(avg(f) FILTER (g = 0), 6) AS f05_single FROM {sets_sql('(SELECT 1 AS one, s1, qid FROM assigned WHERE p >= 0.8::DOUBLE)', 'one', '(SELECT 1 AS one)')} GROUP BY ALL")
def f05_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return tune.by_country(_matches(t), t.truth, t.entities)


def held_out_sql(part: str, name: str) -> str:
    return f""", f AS (SELECT tau, {part} AS part, f FROM {sets_sql(AT_TAUS, 'tau', GRID_SQL)}), sums AS (SELECT part, tau, sum(f) AS f, count(*) AS n FROM f GROUP BY ALL),
others AS (SELECT *, round((sum(f) OVER t - f) / nullif(sum(n) OVER t - n, 0), 9) AS o FROM sums WINDOW t AS (PARTITION BY tau))
SELECT part AS {name}, tau, round(f / n, 6) AS f05 FROM others QUALIFY row_number() OVER (PARTITION BY part ORDER BY coalesce(o, 0) DESC, tau) = 1"""


@query(held_out_sql(bucket_sql("s1", 31, 2), "half"))
def held_out_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return tune.held_out_halves(decide.argmax(t.pairs), t.truth, t.entities)


@query(held_out_sql("country", "country"))
def leave_one_country_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    return tune.leave_one_country_out(decide.argmax(t.pairs), t.truth, t.entities)


@query("""SELECT country, n_assigned, round(share, 6) AS decoy_share, n_true, found, round((n_true - found)::DOUBLE / nullif(found, 0), 6) AS odds FROM (
SELECT country, count(*) AS n_assigned, 1 - count(truth.qid) / count(*)::DOUBLE AS share FROM assigned LEFT JOIN truth USING (qid, s1) GROUP BY country) JOIN (
SELECT country, count(*) AS n_true, count(cand.qid) AS found FROM truth JOIN (SELECT id AS qid, country FROM rec) USING (qid) LEFT JOIN cand USING (qid, s1) GROUP BY country) USING (country)""")
def measured_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    shares = tune.decoy_shares(decide.argmax(t.pairs), t.truth).select("country", F.col("n").alias("n_assigned"), F.round("share", 6).alias("decoy_share"))
    miss = tune.miss_odds(t.candidates, t.truth, t.queries).select("country", F.col("n").alias("n_true"), "found", F.round("odds", 6).alias("odds"))
    return shares.join(miss, "country")


BLENDED = """, members AS (SELECT qid, s1, country, avg(p) AS p FROM (SELECT qid, s1, country, p FROM pairs UNION ALL SELECT qid, s1, country, p * p FROM pairs WHERE p > 0.7::DOUBLE) GROUP BY ALL),
rescored AS (SELECT qid, s1, country, CASE WHEN ce IS NULL THEN p ELSE 1 / (1 + exp(-(0.9::DOUBLE * ln(greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE))) + 0.4::DOUBLE * ce - 0.1::DOUBLE))) END AS p
  FROM members LEFT JOIN (SELECT qid, s1, p - 0.5::DOUBLE AS ce FROM pairs WHERE p < 0.8::DOUBLE) USING (qid, s1)),
top AS (SELECT * FROM rescored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, s1) = 1),
shrunk AS (SELECT qid, s1, country, p * r / (p * r + 1 - p) AS p FROM (SELECT *, CASE country WHEN 'AFRICA' THEN 0.5::DOUBLE WHEN 'ASIA' THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS r FROM top WHERE country <> 'EUROPE'))"""


def _final_pairs(t: tasks.Task) -> DataFrame:
    second = t.pairs.filter("p > 0.7D").withColumn("p", F.col("p") * F.col("p"))
    ce = t.pairs.filter("p < 0.8D").select("qid", "s1", (F.col("p") - 0.5).alias("ce"))
    return chain.blended_members([t.pairs, second], [ce, ce], (0.9, 0.4, -0.1))


@query(BLENDED + """, matched AS (SELECT s1, qid FROM shrunk WHERE p >= 0.6::DOUBLE UNION ALL SELECT s1, qid FROM top WHERE country = 'EUROPE' AND p >= 0.85::DOUBLE)
SELECT id AS s1, coalesce(ids, '') AS matched FROM (SELECT id FROM rec WHERE is_ref) LEFT JOIN (SELECT s1 AS id, string_agg(q, ',' ORDER BY q) AS ids FROM (SELECT DISTINCT s1, qid::VARCHAR AS q FROM matched) GROUP BY s1) USING (id)""")
def ensemble_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain by a threshold; one country has no calibrator and a threshold of its own."""
    t = tasks.Task(spark, sf_dir)
    found = chain.matches(_final_pairs(t), t.countries, decide.parse_odds("AFRICA:0.5,ASIA:0.3,*:0.8"), tau=0.6, unseen={"EUROPE": 0.85})
    return tables.id_lists(t.refs, found, "matched")


@query(BLENDED + f""" SELECT s1, qid FROM ({expected_sql(0.02, "shrunk")}) UNION ALL SELECT s1, qid FROM top WHERE country = 'EUROPE' AND p >= 0.85::DOUBLE""")
def ensemble_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with sets of the best expected F0.5."""
    t = tasks.Task(spark, sf_dir)
    return chain.matches(_final_pairs(t), t.countries, decide.parse_odds("AFRICA:0.5,ASIA:0.3,*:0.8"), miss=0.02, unseen={"EUROPE": 0.85})


@query("""SELECT qid, s1, round(p1, 6) AS p1, round(p2, 6) AS p2, coalesce(q.name, '') || ' | ' || coalesce(q.address, '') AS q_text, coalesce(s.name, '') || ' | ' || coalesce(s.address, '') AS s_text
FROM (SELECT qid, s1, p AS p1, p * p AS p2 FROM pairs WHERE p > 0.05::DOUBLE AND p < 0.6::DOUBLE OR p * p > 0.05::DOUBLE AND p * p < 0.6::DOUBLE) JOIN raw q ON q.id = qid JOIN raw s ON s.id = s1""")
def rescoring_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain pairs with both sides' raw text, as a re-scorer takes them."""
    t = tasks.Task(spark, sf_dir)
    band = chain.uncertain(t.pairs, t.pairs.withColumn("p", F.col("p") * F.col("p")), 0.05, 0.6)
    return band.join(chain.texts(band, t.queries, t.refs), ["qid", "s1"]).select("qid", "s1", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"), "q_text", "s_text")


@query("SELECT s1, qid, q.src, s.name AS n1, s.address AS a1, s.country, q.name AS n2, q.address AS a2 FROM truth JOIN raw q ON q.id = qid JOIN raw s ON s.id = s1")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs of the united sources 2 and 3 with raw text of both sides."""
    t = tasks.Task(spark, sf_dir)
    named = lambda df: df.select(F.col("id").alias("entity_id"), F.col("name").alias("business_name"), F.col("address").alias("business_address"), "country")
    united = tables.union_sources(*((n, named(t.queries.filter(F.col("src") == n))) for n in (2, 3)))
    pairs = t.truth.join(united.select(F.col("entity_id").alias("qid"), "src"), "qid")
    return tables.labelled(pairs, named(t.refs), united.drop("src")).select("s1", "qid", "src", "n1", "a1", "country", "n2", "a2")


@query(", learned AS " + LEARNED.format(side="(SELECT *, u AS items FROM tok)", least=2) + ", typos AS (SELECT x, min(y) AS y FROM learned WHERE y IN ('" + "','".join(sorted(set(maps.ADDRESS_ABBREVIATIONS.values()))) + """') GROUP BY x)
SELECT rec.id, coalesce(m.ad, '') AS ad FROM rec LEFT JOIN (SELECT id, string_agg(coalesce(learned.y, typos.y, x), ' ' ORDER BY i) AS ad FROM (SELECT id, country, unnest(u) AS x, unnest(range(len(u))) AS i FROM tok) LEFT JOIN learned USING (country, x) LEFT JOIN typos USING (x) GROUP BY id) m USING (id)""")
def mapped_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses normalised with the substitutions learned from true pairs."""
    t = tasks.Task(spark, sf_dir)
    learned = maps.learned_tokens(t.truth, t.queries, t.refs, least=2)
    return with_address(tasks.raw_records(spark, sf_dir), "address", "country", tokens=written(learned, "learned")).select("id", "ad")


@query()
def stage2_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 context columns of scored pairs."""
    t = tasks.Task(spark, sf_dir)
    return stage2.frame(t.pairs, t.queries, t.refs)


@query()
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Honest scores of boosted trees over all features, calibrated by isotonic maps of each country and the pooled one; few and shallow trees, to keep the check short."""
    t = tasks.Task(spark, sf_dir)
    rows = world.with_folds(features.build(t.pruned, t.queries, t.refs), t.truth)
    names = feature_names(rows, features.ARTEFACTS)
    rows = model.prepared(rows.select("qid", "s1", "y", "fold", "u", *names), names)
    scored = model.out_of_fold(model.fit_folds(rows, names, trees=5, depth=3), rows, names)
    x = written(scored.join(t.countries, "qid"), "scored")
    return model.calibrate(x, model.isotonic(x)).select("qid", "s1", "country", "y", "p")


@query()
def blend_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.Task(spark, sf_dir)
    truth = t.truth
    x = world.with_folds(t.pairs, truth).withColumn("other", F.col("p") - 0.5)
    a, b, c = model.fit_blend(x)
    return x.select("qid", "s1", model.blended(F.col("p"), F.col("other"), a, b, c).alias("p"))


FOLDED = f"list_filter(string_split(trim(regexp_replace(translate(lower(coalesce(text, '')), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
GRAMS = "unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))"


@query(f""", items AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, {FOLDED} AS w FROM benchmark) WHERE len(w) > 0),
keys AS (SELECT item_id, {GRAMS} AS k FROM items), sizes AS (SELECT item_id, count(*) AS n FROM keys GROUP BY ALL),
grams AS (SELECT doc_id, {GRAMS} AS k FROM (SELECT doc_id, {FOLDED} AS w FROM documents) d JOIN (SELECT DISTINCT n FROM items) i ON len(w) >= i.n)
SELECT doc_id, item_id, nk, round(nk / n::DOUBLE, 6) AS share FROM (SELECT doc_id, item_id, count(*) AS nk FROM grams JOIN keys USING (k) GROUP BY ALL) JOIN sizes USING (item_id) WHERE round(nk / n::DOUBLE, 6) >= 0.5""")
def passage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.passages(spark, sf_dir)


@query(f"SELECT doc_id, {bucket_sql('doc_id', 31, 2)} AS half FROM documents")
def entity_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.table(spark, sf_dir, "documents").select("doc_id", bucket(F.col("doc_id"), 31, 2).alias("half"))
