"""Task A's normalised records, keys, candidates and pairs as DuckDB SQL: the common part of the queries' oracles.

Written from the rules of the normalisers for what task A's records hold: Latin letters, trade names marked by dba,
domains, handles, tags, legal forms, generic words, units.
"""

from __future__ import annotations

from weftlink.functions import vocabulary as v
from weftlink.functions.sampling import bucket_sql
from weftlink.operators import world
from weftlink.plans.tasks import RAW_SQL

WORLD = world.World(kept={"ASIA": 0.7, "EUROPE": 0.5}, decoys={"ASIA": 0.3})


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in values.items()) + "}"


def _tokens(text: str) -> str:
    """A lower-case name's words."""
    plain = f"list_filter(string_split(regexp_replace(replace({text}, '&', ' and '), '[-+/()\\[\\]{{}}<>\"*|_~^=:;!?,.]', ' ', 'g'), ' '), lambda x: x <> '')"
    whole = f"list_transform({plain}, lambda x: CASE WHEN regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '{v.ORDINAL}') THEN translate(x, '{v.LEET_DIGITS}', '{v.LEET_LETTERS}') ELSE x END)"
    return f"list_transform({whole}, lambda x: coalesce({_map(v.NAME_ABBREVIATIONS)}[x], x))"


def _core(tokens: str) -> str:
    """First occurrences of the words that stay."""
    kept = f"list_filter({tokens}, lambda x: NOT list_contains({_list((*v.LEGAL, *v.HONORIFIC, *v.STOP_NAME))}, x))"
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"


def _part(text: str) -> str:
    """A lower-case address part's words."""
    plain = f"list_filter(string_split(regexp_replace({text}, '[#()\\[\\]\"*.]', ' ', 'g'), ' '), lambda x: x <> '')"
    standard = f"list_filter(list_transform({plain}, lambda x: coalesce({_map(v.ADDRESS_ABBREVIATIONS)}[x], x)), lambda x: NOT list_contains({_list(v.ADDRESS_DROP)}, x))"
    return f"list_transform({standard}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE x END)"


BASE = f"""
raw AS ({RAW_SQL}),
n0 AS (SELECT *, strip_accents(trim(coalesce(name, ''))) AS t0 FROM raw),
n1 AS (SELECT *, regexp_matches(t0, '(?i)\\(\\s*id\\s*:\\s*\\d+\\s*\\)|#\\d+\\b') AS tagged, lower(trim(regexp_replace(t0, '(?i)\\(\\s*id\\s*:\\s*\\d+\\s*\\)|#\\d+\\b', ' ', 'g'))) AS t1 FROM n0),
n2 AS (SELECT *, regexp_extract(t1, '^(.*?)\\bdba:?\\s(.*)$', 1) AS before, regexp_extract(t1, '^(.*?)\\bdba:?\\s(.*)$', 2) AS behind FROM n1),
n3 AS (SELECT *, trim(behind) <> '' AND len({_core(_tokens('before'))}) > 0 AS trade FROM n2),
n4 AS (SELECT *, CASE WHEN trade THEN array_to_string({_core(_tokens("before || ' ' || behind"))}, ' ') ELSE '' END AS nm_alt, CASE WHEN trade THEN trim(behind) ELSE t1 END AS t2 FROM n3),
n5 AS (SELECT *, CASE WHEN regexp_matches(t2, '^(www\\.)?[a-z0-9][a-z0-9-]*\\.com$') THEN replace(regexp_extract(t2, '^(www\\.)?([a-z0-9][a-z0-9-]*)\\.com$', 2), '-', '') END AS domain, CASE WHEN regexp_full_match(t2, '[@#]\\S+') THEN regexp_replace(t2, '[^a-z0-9]', '', 'g') END AS handle FROM n4),
n6 AS (SELECT *, coalesce(domain, handle) AS stem, {_tokens('t2')} AS nt FROM n5),
n7 AS (SELECT *, {_core('nt')} AS core, list_sort(list_distinct(list_filter(list_transform(nt, lambda x: {_map(v.LEGAL)}[x]), lambda x: x IS NOT NULL))) AS legal FROM n6),
n8 AS (SELECT *, list_filter(core, lambda x: NOT list_contains({_list(v.GENERIC)}, x)) AS strict FROM n7),
p0 AS (SELECT id, list_filter(list_transform(string_split(lower(strip_accents(coalesce(address, ''))), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM raw),
p1 AS (SELECT id, list_filter(list_transform(parts, lambda p: {_part('p')}), lambda p: len(p) > 0) AS parts FROM p0),
p2 AS (SELECT id, array_to_string(flatten(list_filter(parts, lambda p: p[1] NOT IN ('unit', 'pmb', 'box'))), ' ') AS ad, array_to_string(flatten(list_filter(parts, lambda p: p[1] IN ('unit', 'pmb', 'box'))), ' ') AS ad_unit FROM p1),
p3 AS (SELECT *, list_transform(regexp_extract_all(ad, '[0-9]+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) AS runs FROM p2),
rec AS (SELECT id, country, src, canon, is_ref, coalesce(stem, array_to_string(core, ' ')) AS nm, coalesce(stem, array_to_string(CASE WHEN len(strict) > 0 THEN strict ELSE core END, ' ')) AS nm_s, coalesce(stem, array_to_string(core, '')) AS nm_cmp,
  nm_alt, CASE WHEN stem IS NULL THEN array_to_string(legal, ' ') ELSE '' END AS nm_leg, (domain IS NOT NULL)::INT + 2 * (handle IS NOT NULL AND domain IS NULL)::INT + 8 * trade::INT + 16 * tagged::INT AS flags,
  ad, array_to_string(runs, ' ') AS ad_nums, coalesce(runs[1], '') AS ad_hn, ad_unit, runs FROM n8 JOIN p3 USING (id)),
tok0 AS (SELECT *, list_filter(string_split(nm, ' '), lambda x: length(x) > 1) AS t, list_filter(string_split(ad, ' '), lambda x: x <> '') AS u FROM rec),
tok AS (SELECT *, list_filter(u, lambda x: NOT regexp_full_match(x, '[0-9]+') AND length(x) > 2) AS w, list_distinct(runs) AS d FROM tok0),
allkeys AS (
  SELECT DISTINCT id, country, is_ref, ty, key FROM (
  SELECT id, country, is_ref, 0 AS ty, unnest(t) AS key FROM tok
  UNION ALL SELECT id, country, is_ref, 1, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) FROM tok
  UNION ALL SELECT id, country, is_ref, 2, array_to_string(list_sort(list_transform(t, lambda x: substr(x, 1, 4))), '_') FROM tok WHERE len(t) >= 2
  UNION ALL SELECT id, country, is_ref, 3, unnest(w) FROM tok
  UNION ALL SELECT id, country, is_ref, 4, unnest(list_transform(range(1, len(u)), lambda i: u[i] || '_' || u[i + 1])) FROM tok
  UNION ALL SELECT id, country, is_ref, 5, unnest(d) FROM tok
  UNION ALL SELECT id, country, is_ref, 5, coalesce(nullif(ltrim(substr(x, 2), '0'), ''), '0') FROM (SELECT *, unnest(d) AS x FROM tok WHERE is_ref) WHERE length(x) >= 3
  UNION ALL SELECT id, country, is_ref, 5, substr(x, 1, length(x) - 1) FROM (SELECT *, unnest(d) AS x FROM tok WHERE is_ref) WHERE length(x) >= 3
  UNION ALL SELECT id, country, is_ref, 6, nm_cmp || '|' || unnest(d) FROM tok WHERE nm_cmp <> ''
  UNION ALL SELECT id, country, is_ref, 7, a || '|' || unnest(d) FROM (SELECT *, unnest(t) AS a FROM tok)
  UNION ALL SELECT id, country, is_ref, 8, a || '|' || unnest(w) FROM (SELECT *, unnest(d) AS a FROM tok)
  UNION ALL SELECT id, country, is_ref, 9, a || '|' || unnest(w) FROM (SELECT *, unnest(t) AS a FROM tok)
  UNION ALL SELECT id, country, is_ref, 10, nm_cmp FROM tok WHERE length(nm_cmp) > 2)),
refs AS (SELECT country, count(*) AS n_ref FROM rec WHERE is_ref GROUP BY ALL),
weights AS (SELECT country, ty, key, count(*) AS df, ln(any_value(n_ref)) - ln(count(*)) AS w FROM allkeys JOIN refs USING (country) WHERE is_ref GROUP BY ALL
  HAVING count(*) <= CASE WHEN ty IN (0, 3, 4, 5) THEN greatest(10, round(60 * any_value(n_ref) / 1000000.0)) WHEN ty IN (7, 8, 9) THEN greatest(10, round(80 * any_value(n_ref) / 1000000.0)) ELSE greatest(20, round(200 * any_value(n_ref) / 1000000.0)) END),
scored AS (SELECT q.id AS qid, s.id AS s1, sum(w) AS score, count(*) AS nk FROM allkeys q JOIN weights USING (country, ty, key) JOIN allkeys s USING (country, ty, key) WHERE NOT q.is_ref AND s.is_ref GROUP BY ALL),
cand AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, s1) AS rank FROM scored QUALIFY rank <= 12),
best AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best, coalesce(max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY qid), 0) AS second, count(*) OVER (PARTITION BY qid) AS q_ncand_raw FROM cand),
cut AS (SELECT * FROM best WHERE rank <= 5 AND score >= 0.3::DOUBLE * best),
pruned AS (SELECT qid, s1, score, nk, rank, CASE WHEN best <> 0 THEN score / best END AS rel, best - score AS gap_best, score - second AS gap_second, q_ncand_raw, count(*) OVER (PARTITION BY s1) AS s_ncand, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, qid) AS s_rank FROM cut),
truth AS (SELECT id AS qid, canon AS s1 FROM rec WHERE NOT is_ref AND canon IS NOT NULL),
pairs AS (SELECT qid, s1, country, round(round(score, 6) / (round(score, 6) + 20.0::DOUBLE), 6) AS p FROM pruned JOIN (SELECT id AS qid, country FROM rec) USING (qid)),
assigned AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, s1) = 1),
kept AS (SELECT * FROM rec WHERE is_ref AND {bucket_sql('id', WORLD.seed, world.BUCKETS)} < CASE country WHEN 'ASIA' THEN 7000 WHEN 'EUROPE' THEN 5000 ELSE 10000 END)
"""
