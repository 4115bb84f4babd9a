"""SQL statements (DuckDB) of queries whose results plain SQL can state."""

from __future__ import annotations

#: Words of every document, numbered from 1.
_WORDS = r"""
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM docs))"""


def substring_sql(width: int = 35) -> str:
    """Every window's words as one string; a word goes if a window over it
    starts elsewhere as well."""
    return f"""
WITH {_WORDS.format(text="text")},
lists AS (SELECT doc_id, list(word ORDER BY i) AS w FROM words GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS body
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM lists)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY body) > 1 AS again FROM windows),
marked AS (SELECT w.doc_id, w.i, w.word, coalesce(bool_or(o.again) OVER (
             PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW), false) AS gone
           FROM words w LEFT JOIN often o ON o.doc_id = w.doc_id AND o.i = w.i),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS n_removed,
                string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS body FROM marked GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""


def near_sql(shingle: int = 5, percent: int = 75) -> str:
    """Sets of shingles, links from shared ones, and what each document
    reaches."""
    return f"""
WITH RECURSIVE {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
lists AS (SELECT doc_id, list(word ORDER BY i) AS w FROM words GROUP BY doc_id),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {shingle - 1}], ' ')) AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM lists)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS body FROM shingles GROUP BY doc_id),
classes AS (SELECT body, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY body),
few AS (SELECT s.rep, h.s, s.n FROM classes s JOIN shingles h ON h.doc_id = s.rep),
links AS (SELECT a.rep AS u, b.rep AS v FROM few a JOIN few b ON a.s = b.s AND a.rep < b.rep
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, v) AS (SELECT rep, rep FROM classes UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v),
named AS (SELECT c.body, min(r.v) AS component FROM classes c JOIN reach r ON r.u = c.rep GROUP BY c.body)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(n.component, d.doc_id) AS component_id,
       coalesce(n.component, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN named n ON n.body = s.body
"""


def secret_sql(rules, base) -> str:
    """Matches of every rule and the pieces between them; a match starts after
    the pieces and matches before it."""
    parts = []
    for number, rule in enumerate(rules):
        pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule.kind}' AS kind, {number} AS number, regexp_extract_all(text, '{pattern}') AS m, "
                     f"regexp_extract_all(text, '{pattern}', {rule.group}) AS g, string_split_regex(text, '{pattern}') AS p, "
                     f"{rule.at_least} AS least FROM docs")
    union = " UNION ALL ".join(parts)
    listed = ", ".join(f"'{r.kind}'" for r in base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in base)
    text = "string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, number)"
    shown = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({union}),
each AS (SELECT doc_id, kind, number, least, unnest(range(1, len(m) + 1)) AS k, m, g, p FROM found),
sized AS (SELECT doc_id, kind, number, least, k, length(m[k]) AS size, length(g[k]) AS own, length(p[k]) AS before FROM each),
placed AS (SELECT *, sum(size + before) OVER (PARTITION BY doc_id, number ORDER BY k) AS stop FROM sized),
spans AS (SELECT doc_id, kind, number, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE own >= least),
told AS (SELECT doc_id, {counts}, {text} AS spans, {text} FILTER (WHERE kind IN ({listed})) AS base FROM spans GROUP BY doc_id)
SELECT docs.doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told ON told.doc_id = docs.doc_id
"""
