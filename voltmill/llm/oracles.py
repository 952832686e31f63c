"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

_WORDS = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, i, hash(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
),
again AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM again),
lists AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
word AS (SELECT d.r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS t FROM word LEFT JOIN gone ON gone.r = word.r AND gone.i = word.i WHERE gone.r IS NULL GROUP BY word.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""

#: Kinds without lookarounds, which this engine lacks; base matches are the same. The added kinds are found between word bounds and cut.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CHECK = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))",
    "card": "len(g) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN g[len(g) + 1 - i]::INT WHEN g[len(g) + 1 - i]::INT > 4 THEN 2 * g[len(g) + 1 - i]::INT - 9 ELSE 2 * g[len(g) + 1 - i]::INT END)) % 10 = 0",
    "phone": "len(g) BETWEEN 8 AND 15",
}


def _spans(kind: str, order: int) -> str:
    p = _BASE[kind]
    return f"""
SELECT r, '{kind}' AS kind, {order} AS o, s, s + len(m) AS e FROM (
  SELECT r, m, regexp_replace(m, '[^0-9]', '', 'g') AS g, (coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(sizes[1:i - 1]), 0))::BIGINT AS s FROM (
    SELECT r, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i, list_transform(string_split_regex(t, '{p}'), lambda x: len(x)) AS gaps, list_transform(ms, lambda x: len(x)) AS sizes
    FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS ms FROM d) WHERE len(ms) > 0
  )
) WHERE {_CHECK[kind]}"""


OP10_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_spans(k, i) for i, k in enumerate(_BASE))}),
found AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS base, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)} FROM spans GROUP BY r
)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(base, '') AS base FROM d LEFT JOIN found USING (r)
"""

ORACLES = {"op2_difference_cover": OP2}
