"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

from . import url_filter

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(s, ' ') AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a) USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) USING (vec_id)
"""

_KINDS = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": ("[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    "card": (
        "[0-9](?:[\\x20-]?[0-9])+",
        "length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda k: CASE WHEN k % 2 = 1 THEN g[-k]::INT ELSE 2 * g[-k]::INT - 9 * (g[-k]::INT > 4)::INT END)) % 10 = 0",
    ),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "length(g) BETWEEN 9 AND 15"),
}


def _found(place: int, kind: str, pattern: str, test: str) -> str:
    """Matches lie between the parts of the text split at them: a match starts after all parts and matches before it."""
    return f"""
  SELECT doc_id, {place} AS place, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, ms[k] AS m, regexp_replace(ms[k], '[^0-9]', '', 'g') AS g,
      coalesce(list_sum(list_transform(parts[1:k], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0)::BIGINT AS start
    FROM (SELECT doc_id, ms, string_split_regex(t, '{pattern}') AS parts, unnest(range(1, len(ms) + 1)) AS k
          FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ms FROM documents))) WHERE {test}"""


#: Holds where no text disguises its data: the transducers' spans are beyond SQL, and the test tables have none.
PII = f"""
WITH spans AS ({' UNION ALL '.join(_found(k, kind, *x) for k, (kind, x) in enumerate(_KINDS.items()))}),
by_doc AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS s
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _KINDS)}, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_redirect_equivalence": url_filter.ORACLE_SQL, "op4_offset_deobfuscation": PII, "op6_jaccard_regions": JACCARD, "op7_rotated_codes": EMBEDDINGS,
    }
