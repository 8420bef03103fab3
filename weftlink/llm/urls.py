"""URL filters with a path-template tree per host, in DataFrame operations only.

Rules judge what they fit. For the rest, each host's paths form a tree: a segment becomes a wildcard where it is a
number or a long hexadecimal string, or where the children of its node are too many and too rarely repeated to be
names; that is decided node by node from the root down, on counted distinct paths. Siblings merge at every level
where their shares of blocked URLs don't differ significantly from their parent's. A template is rejected when the
smoothed share of blocked URLs among those that the rules label is high; a node's share leans on its parent's, the
host's on all hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weftlink.llm.common import hot_join, need, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Verdict, host, start of the path.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Segments of a path that the tree has; deeper ones share a last node. A node's children are variable from so many distinct values, repeated fewer times than so on average.
DEPTH, DISTINCT, REPEATED = 12, 20, 5
#: Weight of the level above in a smoothed share; standard errors within which siblings merge; share from which a template is rejected.
LEAN, ERRORS, REJECT = 4.0, 2.0, 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER, HEXADECIMAL = r"^[0-9]+(\.[A-Za-z0-9]+)?$", r"^[0-9a-fA-F-]{16,}$"


def split_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """id, host and path of each URL; both are empty for null and where there is no ``://``."""
    one = need(pages, id_col, url_col).toDF("id", "url")
    rest = one.withColumn("rest", F.coalesce(F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit("")))
    raw = rest.withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
    after = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0)
    return raw.select("id", F.translate("raw", UPPER, LOWER).alias("host"), after.alias("path"))


def fits(rule: Rule) -> Column:
    return ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def first_rule(rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(fits(rule), F.lit(value(rule))).otherwise(out)
    return out


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, raw, names, deeper, n, ...) with ``template``: level by level, the children of variable nodes become wildcards. Paths come counted, and nodes are counted before they are joined, so that a hot host meets in no task."""
    levels = paths.agg(F.coalesce(F.max(F.size("names")), F.lit(0)).alias("n")).first()["n"]
    state = paths.withColumn("prefix", F.lit(""))
    for level in range(levels):
        at = state.withColumn("child", F.get("names", F.lit(level)))
        kinds = at.filter("child IS NOT NULL").groupBy("host", "prefix", "child").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        named = F.col("child") != "*"
        nodes = kinds.groupBy("host", "prefix").agg(F.count_if(named).alias("kinds"), F.sum(F.when(named, F.col("n"))).alias("urls"), F.sum("rows").alias("rows"))
        nodes = written(nodes.select("host", "prefix", "rows", ((F.col("kinds") >= DISTINCT) & (F.col("urls") < REPEATED * F.col("kinds"))).alias("variable")), "nodes")
        step = F.concat("prefix", F.lit("/"), F.when(F.col("variable"), F.lit("*")).otherwise(F.col("child")))
        state = hot_join(at, nodes, ["host", "prefix"], "rows", "left").withColumn("prefix", F.when(F.col("child").isNull(), F.col("prefix")).otherwise(step))
        state = written(state.select(*paths.columns, "prefix"), "state")
    return state.withColumn("template", F.concat(F.when(F.col("prefix") == "", F.when(F.col("deeper"), "").otherwise("/")).otherwise(F.col("prefix")), F.when(F.col("deeper"), "/**").otherwise(""))).drop("prefix")


def shares(leaves: DataFrame, overall: float) -> DataFrame:
    """(host, template, share) from counted templates (host, template, n, b): n labelled, b blocked.

    A node's counts are those of all templates below it. Where they don't differ from its parent's by more than
    ERRORS standard errors, it has the counts of all such siblings.
    """
    steps = F.split(F.substring("template", 2, 1 << 30), "/")
    above = leaves.select("host", "template", "n", "b", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")))).alias("level", "node"))
    above = above.withColumn("parent", F.regexp_replace("node", "/[^/]*$", ""))
    nodes = written(above.groupBy("host", "parent", "node").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("below")), "tree")
    pools = written(nodes.groupBy("host", "parent").agg(F.sum("n").alias("fn"), F.sum("b").alias("fb"), F.count("*").alias("children")), "pools")
    rate = F.try_divide("fb", "fn")
    alike = (F.col("n") == 0) | (F.abs(F.try_divide("b", "n") - rate) <= ERRORS * F.sqrt(F.try_divide(rate * (1 - rate), F.col("n"))))
    marked = written(hot_join(nodes, pools, ["host", "parent"], "children").withColumn("alike", F.coalesce(alike, F.lit(True))), "marked")
    merged = written(marked.filter("alike").groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.count("*").alias("members")), "merged")
    both = hot_join(marked.filter("alike"), merged, ["host", "parent"], "members").select("host", "node", "below", F.col("pn").alias("n"), F.col("pb").alias("b"))
    counted = written(both.unionByName(marked.filter("NOT alike").select("host", "node", "below", "n", "b")), "counted")
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"), F.count("*").alias("leaves"))
    along = hot_join(above.select("host", "template", "level", "node"), counted, ["host", "node"], "below")
    chains = along.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "n", "b"))).alias("chain"))  # at most DEPTH + 1 nodes
    leant = lambda p, n, b: (b + LEAN * p) / (n + LEAN)
    full = hot_join(chains, written(hosts, "hosts"), ["host"], "leaves")
    return full.select("host", "template", F.aggregate("chain", leant(F.lit(overall), F.col("hn"), F.col("hb")), lambda p, c: leant(p, c["n"], c["b"])).alias("share"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, template, share) of every row.

    rule: the longest that fits, else null; verdict: its own, else the method's, ``block`` where the smoothed share
    reaches REJECT. A null URL and one without ``://`` have empty host and path and are judged as the host ''.
    Repeated rows give a row each and count as often; other columns are ignored, whatever their names; an empty
    table gives an empty table. Rules of equal length can't both fit unless they are equal. Segments beyond DEPTH
    share one node.
    """
    cut = split_urls(pages, id_col, url_col)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    general = F.transform(F.slice(segments, 1, DEPTH), lambda s: F.when(s.rlike(NUMBER) | s.rlike(HEXADECIMAL), F.lit("*")).otherwise(s))
    base = cut.withColumn("names", general).withColumn("deeper", F.size(segments) > DEPTH).withColumn("rule", first_rule(rules, lambda r: r.name)).withColumn("said", first_rule(rules, lambda r: r.verdict))
    rows = base.withColumn("raw", F.concat(F.lit("/"), F.array_join("names", "/"), F.when(F.col("deeper"), "/**").otherwise("")))
    paths = rows.groupBy("host", "raw").agg(F.first("names").alias("names"), F.first("deeper").alias("deeper"), F.count("*").alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    known = written(templates(written(paths, "paths")), "templates")
    every = known.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    leaves = written(known.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.count("*").alias("raws")), "leaves")
    judged = written(shares(leaves, (every["b"] + 1.0) / (every["n"] + 2.0)).join(leaves.select("host", "template", "raws"), ["host", "template"]), "shares")
    of_raw = written(hot_join(known.select("host", "raw", "template", "n"), judged, ["host", "template"], "raws").select("host", "raw", "template", "n", "share"), "judged")
    out = hot_join(rows.select("id", "host", "path", "rule", "said", "raw"), of_raw, ["host", "raw"], "n")
    verdict = F.coalesce("said", F.when(F.col("share") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", F.round("share", 6).alias("share"))


def oracle() -> str:
    """The same in DuckDB SQL over ``pages``."""
    fit = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    longest = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda value: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{value(r)}'" for r in longest) + " END"
    levels = ""
    for d in range(DEPTH):
        levels += f"""
v{d} AS MATERIALIZED (SELECT host, prefix, count(*) >= {DISTINCT} AND sum(n) < {REPEATED} * count(*) AS variable FROM (SELECT host, prefix, names[{d + 1}] AS child, sum(n) AS n FROM s{d} WHERE names[{d + 1}] <> '*' GROUP BY ALL) GROUP BY ALL),
s{d + 1} AS MATERIALIZED (SELECT s{d}.host, raw, names, deeper, n, labelled, blocked, CASE WHEN names[{d + 1}] IS NULL THEN s{d}.prefix ELSE s{d}.prefix || '/' || CASE WHEN variable THEN '*' ELSE names[{d + 1}] END END AS prefix FROM s{d} LEFT JOIN v{d} USING (host, prefix)),"""
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS said FROM c),
e AS (SELECT *, list_transform(segments[1:{DEPTH}], lambda s: CASE WHEN regexp_matches(s, '{NUMBER}') OR regexp_matches(s, '{HEXADECIMAL}') THEN '*' ELSE s END) AS names FROM d),
f AS (SELECT *, '/' || array_to_string(names, '/') || CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END AS raw FROM e),
s0 AS MATERIALIZED (SELECT host, raw, any_value(names) AS names, any_value(len(segments) > {DEPTH}) AS deeper, count(*) AS n, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked, '' AS prefix FROM f GROUP BY host, raw),{levels}
known AS MATERIALIZED (SELECT host, raw, labelled, blocked, CASE WHEN prefix = '' AND NOT deeper THEN '/' ELSE prefix END || CASE WHEN deeper THEN '/**' ELSE '' END AS template FROM s{DEPTH}),
leaves AS (SELECT host, template, sum(labelled)::BIGINT AS n, sum(blocked)::BIGINT AS b, string_split(substr(template, 2), '/') AS steps FROM known GROUP BY host, template),
above AS MATERIALIZED (SELECT host, template, n, b, level, '/' || array_to_string(steps[1:level], '/') AS node, CASE WHEN level > 1 THEN '/' || array_to_string(steps[1:level - 1], '/') ELSE '' END AS parent FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS level FROM leaves)),
nodes AS (SELECT host, parent, node, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM above GROUP BY ALL),
pools AS (SELECT host, parent, sum(n)::BIGINT AS fn, sum(b)::BIGINT AS fb FROM nodes GROUP BY ALL),
marked AS MATERIALIZED (SELECT nodes.*, coalesce(n = 0 OR abs(b::DOUBLE / nullif(n, 0) - fb::DOUBLE / nullif(fn, 0)) <= {ERRORS}::DOUBLE * sqrt(fb::DOUBLE / nullif(fn, 0) * (1 - fb::DOUBLE / nullif(fn, 0)) / nullif(n, 0)), true) AS alike
  FROM nodes JOIN pools USING (host, parent)),
merged AS (SELECT host, parent, sum(n)::BIGINT AS pn, sum(b)::BIGINT AS pb FROM marked WHERE alike GROUP BY ALL),
counted AS (SELECT host, node, CASE WHEN alike THEN pn ELSE n END AS n, CASE WHEN alike THEN pb ELSE b END AS b FROM marked LEFT JOIN merged USING (host, parent)),
hosts AS (SELECT host, sum(labelled)::BIGINT AS hn, sum(blocked)::BIGINT AS hb FROM known GROUP BY ALL),
overall AS (SELECT (coalesce(sum(hb), 0)::DOUBLE + 1) / (coalesce(sum(hn), 0)::DOUBLE + 2) AS p FROM hosts),
chains AS (SELECT host, template, list([counted.n::DOUBLE, counted.b::DOUBLE] ORDER BY level) AS chain FROM above JOIN counted USING (host, node) GROUP BY ALL),
judged AS (SELECT host, template, list_reduce(list_prepend([(hb + {LEAN}::DOUBLE * p) / (hn + {LEAN}::DOUBLE)], chain), lambda x, c: [(c[2] + {LEAN}::DOUBLE * x[1]) / (c[1] + {LEAN}::DOUBLE)])[1] AS share FROM chains JOIN hosts USING (host), overall)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN share >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template, round(share, 6) AS share
FROM f JOIN known USING (host, raw) JOIN judged USING (host, template)
"""
