"""Plain-SQL statements of the operators, for cross-checking on DuckDB.

Each builder returns one SQL string over the driver's views (``documents``,
``conversations``, ``embeddings``, ``events`` ...).  Shared stages are CTE
fragments so the statements stay readable.  Arrays are emitted as strings
(ids joined by a space, doubles with ``%.6f``) so results compare as scalars.
"""

from __future__ import annotations

from ibex.functions.text import TOKEN_FILTERS


def _sql_str(s: str) -> str:
    """SQL expression for an arbitrary Python string (control characters
    through ``chr``)."""
    parts, buf = [], ""
    for ch in s:
        if ch in "\t\n\r":
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        parts.append("'" + buf.replace("'", "''") + "'")
    return " || ".join(parts) if parts else "''"


NON_WORD = r"[^\p{L}\p{N}_]"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{NON_WORD}', ' ', 'g'), ' +', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    spaces = "' " + " " * (len(TOKEN_FILTERS) - 1) + "'"
    return (f"list_filter(string_split(translate(lower({x}), {_sql_str(TOKEN_FILTERS)}, {spaces}), ' '), "
            f"lambda t: t <> '')")


def uniform_sql(seed, *parts: str, seed_sql: str | None = None) -> str:
    head = seed_sql if seed_sql is not None else f"'{seed}'"
    key = ", ".join([head] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5(concat_ws(':', {key})), 1, 8))::BIGINT / 4294967296.0)"


def hash32_sql(seed, *parts: str) -> str:
    key = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5(concat_ws(':', {key})), 1, 8))::BIGINT"


def docs_cte() -> str:
    return ("docs AS (SELECT doc_id, source, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text "
            "FROM documents)")


def pieces_cte(delimiter: str = "\n\n") -> str:
    d = _sql_str(delimiter)
    return (f"pieces AS (SELECT doc_id, source, unnest(string_split(text, {d})) AS piece, "
            f"CAST(generate_subscripts(string_split(text, {d}), 1) - 1 AS INTEGER) AS pos FROM docs)")


def paragraphs_cte(delimiter: str = "\n\n", min_chars: int = 300) -> str:
    return (f"{docs_cte()}, {pieces_cte(delimiter)}, "
            f"paras AS (SELECT doc_id, pos, source, {clean_sql('piece')} AS text FROM pieces "
            f"WHERE length(piece) > {min_chars})")


def labelled_cte(cutoff: int = 1800, delimiter: str = "\n", min_chars: int = 300) -> str:
    return (f"{paragraphs_cte(delimiter, min_chars)}, "
            "manifest AS (SELECT DISTINCT source, "
            "CAST(1700 + 10 * CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS INTEGER) AS year "
            "FROM documents WHERE regexp_extract(source, '(\\d+)$', 1) <> ''), "
            "labelled AS (SELECT p.doc_id, p.pos, p.source, p.text, "
            f"CASE WHEN m.year < {cutoff} THEN 0 ELSE 1 END AS label "
            "FROM paras p JOIN manifest m ON p.source = m.source)")


def split_cte(test_fraction: float = 0.2, seed: int = 0, exact: bool = False) -> str:
    if not exact:
        return (f"{labelled_cte()}, split AS (SELECT *, "
                f"{uniform_sql(seed, 'doc_id', 'pos')} >= {test_fraction} AS is_train FROM labelled)")
    return (f"{labelled_cte()}, ranked AS (SELECT *, row_number() OVER "
            f"(ORDER BY {hash32_sql(seed, 'doc_id', 'pos')}, doc_id, pos) AS rn, count(*) OVER () AS n "
            "FROM labelled), "
            f"split AS (SELECT doc_id, pos, source, text, label, rn > ceil({test_fraction} * n) AS is_train "
            "FROM ranked)")


def tokens_cte(**kw) -> str:
    return f"{split_cte(**kw)}, tok AS (SELECT *, {tokens_sql('text')} AS tokens FROM split)"


def vocab_cte(num_words: int = 1000, **kw) -> str:
    return (f"{tokens_cte(**kw)}, counts AS (SELECT token, count(*) AS n FROM "
            "(SELECT unnest(tokens) AS token FROM tok WHERE is_train) GROUP BY token), "
            f"vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id "
            f"FROM counts ORDER BY n DESC, token LIMIT {num_words - 2})")


def encoded_cte(num_words: int = 1000, maxlen: int | None = None, **kw) -> str:
    """``enc(doc_id, pos, label, is_train, ids)`` - unpadded ids (of the first
    ``maxlen`` tokens, if given)."""
    lim = f"WHERE i <= {maxlen}" if maxlen is not None else ""
    return (f"{vocab_cte(num_words, **kw)}, "
            "ex AS (SELECT doc_id, pos, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM tok), "
            f"exid AS (SELECT ex.doc_id, ex.pos, ex.i, coalesce(v.id, 1) AS id FROM ex "
            f"LEFT JOIN vocab v ON ex.token = v.token {lim}), "
            "agg AS (SELECT doc_id, pos, list(id ORDER BY i) AS ids FROM exid GROUP BY doc_id, pos), "
            "enc AS (SELECT t.doc_id, t.pos, t.label, t.is_train, coalesce(a.ids, []::INTEGER[]) AS ids "
            "FROM tok t LEFT JOIN agg a ON t.doc_id = a.doc_id AND t.pos = a.pos)")


def padded_sql(ids: str, maxlen: int) -> str:
    return (f"list_concat({ids}[1:{maxlen}], "
            f"list_transform(range(greatest({maxlen} - len({ids}[1:{maxlen}]), 0)), lambda _x: 0))")


def join_ints(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ' ')"


def join_doubles(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: printf('%.6f', v)), ' ')"


def subword_cte(n_words: int = 2000, max_length: int = 512) -> str:
    """``sub(doc_id, pos, label, is_train, ids, width)``: begin and end marks
    (2, 3) around the greedy longest pieces (unknown: 1), and the width of the
    row's part.  The pieces: 5 marks, the characters by count, their
    continuations, the most frequent words."""
    return f"""{tokens_cte()},
wc AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tok WHERE is_train) GROUP BY token),
ch AS (SELECT c, sum(n) AS n, row_number() OVER (ORDER BY sum(n) DESC, c) - 1 AS r
       FROM (SELECT unnest(string_split(token, '')) AS c, n FROM wc) WHERE c <> '' GROUP BY c),
nch AS (SELECT count(*) AS k FROM ch),
top AS (SELECT token, n FROM wc ORDER BY n DESC, token LIMIT {n_words}),
units AS (SELECT c AS body, false AS more, 5 + r AS id FROM ch
           UNION ALL SELECT c, true, 5 + k + r FROM ch, nch
           UNION ALL SELECT token, false, 4 + 2 * k + row_number() OVER (ORDER BY n DESC, token)
                     FROM top, nch WHERE token NOT IN (SELECT c FROM ch)),
words AS (SELECT doc_id, pos, unnest(w) AS word, generate_subscripts(w, 1) AS i
          FROM (SELECT doc_id, pos, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM tok)),
basic AS (SELECT word, unnest(b) AS token, generate_subscripts(b, 1) AS j
          FROM (SELECT word, regexp_extract_all(strip_accents(lower(word)), '_|[^_]+') AS b FROM (SELECT DISTINCT word FROM words))),
toks AS (SELECT DISTINCT token FROM basic WHERE length(token) <= 100),
longest AS (
  SELECT t.token, t.s, max(p.len) AS len, arg_max(p.id, p.len) AS id
  FROM (SELECT token, s, unnest(range(1, length(token) - s + 2)) AS len
        FROM (SELECT token, unnest(range(1, length(token) + 1)) AS s FROM toks)) t
  JOIN (SELECT *, length(body) AS len FROM units) p
    ON p.body = substr(t.token, t.s, t.len) AND p.len = t.len AND p.more = (t.s > 1)
  GROUP BY t.token, t.s),
walk AS (
  SELECT token, 1 AS s, []::BIGINT[] AS ids FROM toks
  UNION ALL
  SELECT w.token, w.s + l.len, list_append(w.ids, l.id) FROM walk w JOIN longest l ON l.token = w.token AND l.s = w.s),
found AS (SELECT token, ids FROM walk WHERE s = length(token) + 1),
wids AS (SELECT b.word, flatten(list(coalesce(f.ids, [1]::BIGINT[]) ORDER BY b.j)) AS ids FROM basic b LEFT JOIN found f USING (token) GROUP BY b.word),
body AS (SELECT doc_id, pos, flatten(list(ids ORDER BY i)) AS ids FROM words JOIN wids USING (word) GROUP BY doc_id, pos),
marked AS (SELECT t.doc_id, t.pos, t.label, t.is_train,
           list_concat(list_concat([2]::BIGINT[], coalesce(b.ids, []::BIGINT[])[1:{max_length - 2}]), [3]::BIGINT[]) AS ids
           FROM tok t LEFT JOIN body b USING (doc_id, pos)),
sub AS (SELECT *, least({max_length}, max(len(ids)) OVER (PARTITION BY is_train)) AS width FROM marked)"""


def subword_padded() -> str:
    return "list_concat(ids, list_transform(range(width - len(ids)), lambda _x: 0::BIGINT))"
