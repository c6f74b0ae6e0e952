"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force, the libraries, or held-out rows."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _spaced(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


#: Kind, pattern for an engine that folds cases beyond ASCII (so the letters are listed), group, least characters.
_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def _secrets() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(_RULES):
        pattern = pattern.replace("'", "''")
        value = f"regexp_extract(m[j], '{pattern}', {group})" if group else "m[j]"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, length({value}) >= {least} AS passes, m[j] AS found,
          list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0) AS s
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS gaps FROM docs))""")
    base = "'assign', 'access', 'hex'"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS (SELECT doc_id, rank, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(found) AS BIGINT) AS x FROM ({' UNION ALL '.join(parts)}) WHERE passes)
    SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(x, ',' ORDER BY s, rank) FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, rank), '') AS spans
    FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


_CONTAMINATION = f"""WITH docs AS (SELECT doc_id, {_PLAIN} AS ws FROM documents), items AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
  wins AS (SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS k FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(13, len(ws)) AS n FROM items WHERE len(ws) > 0))),
  runs AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS k FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins))),
  met AS (SELECT doc_id, runs.n, i, item_id FROM runs JOIN wins USING (k)),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
  FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE docs AS (SELECT doc_id, {_spaced(_LOWER)} AS ws FROM documents),
  sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(4, len(ws)) AS n FROM docs WHERE len(ws) > 0))),
  sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
  reach AS (SELECT a AS d, a AS c FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.d),
  least_ AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ ON d = doc_id"""

_REPEATS = f"""WITH docs AS (SELECT doc_id, {_spaced("coalesce(text, '')")} AS ws FROM documents),
  runs AS (SELECT doc_id, i, ws[i:i + 12] AS k FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM docs)),
  firsts AS (SELECT k, min(doc_id) AS m FROM runs GROUP BY k),
  hit AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM runs JOIN firsts USING (k) WHERE m < doc_id) GROUP BY doc_id)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(CASE WHEN g IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda x, i: NOT list_contains(g, i)), ' ') END) AS kept_sha256
  FROM docs LEFT JOIN hit USING (doc_id)"""

ORACLE_SQL = {"op1_secret_scan": _secrets(), "op3_decontamination": _CONTAMINATION, "op6_minhash_near_dedup": _NEAR, "op9_substring_dedup": _REPEATS}
