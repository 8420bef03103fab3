"""DuckDB SQL for the queries of this package that SQL can tell, by brute force over whole tables."""

from __future__ import annotations

from weftlink.llm import urls
from weftlink.llm.hnsw import COSINE
from weftlink.llm.licenses import BASE, TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def licenses() -> str:
    templates = BASE + TEMPLATES
    words = ", ".join(f"({k}, {j}, '{w.decode()}', {j in t.must})" for k, t in enumerate(templates) for j, w in enumerate(t.words))
    kinds = ", ".join(f"({k}, '{t.label}', {len(t.words)}, {len(t.words) - t.misses}, {len(t.must)}, {t.base})" for k, t in enumerate(templates))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{WORD}') AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
tw(k, j, word, must) AS (VALUES {words}), tl(k, label, n, least, n_must, base) AS (VALUES {kinds}),
hits AS (SELECT doc_id, k, p - j AS start, count(*) AS m, count(*) FILTER (must) AS mm FROM pos JOIN tw USING (word) GROUP BY ALL),
found AS (SELECT doc_id, label, base, start, m / n::DOUBLE AS share FROM hits JOIN tl USING (k) WHERE m >= least AND mm = n_must),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN per USING (doc_id)
"""


def groups() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
classes AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS class_id FROM d WHERE len(w) > 0),
shingles AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM classes WHERE doc_id = class_id) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * o >= 4 * (x.n + y.n - o)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT doc_id, doc_id FROM classes WHERE doc_id = class_id UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id),
roots AS (SELECT id AS class_id, min(root) AS root FROM reach GROUP BY id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(root, doc_id) AS group_id, doc_id = coalesce(root, doc_id) AS kept
FROM d LEFT JOIN (SELECT doc_id, class_id FROM classes) USING (doc_id) LEFT JOIN roots USING (class_id)
"""


def vectors() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
ways AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}::DOUBLE),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a) USING (vec_id) JOIN (SELECT id AS vec_id, min(root) AS root FROM reach GROUP BY id) USING (vec_id)
"""
