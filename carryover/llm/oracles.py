"""SQL twins of the queries on vectors and conversations, for DuckDB."""

#: CRC-32 of an ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i::int, 1))::bigint),
  lambda h, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(h, b)), 4294967295::bigint), 4294967295)"""

_KEY = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"


def _with(end: str, cost: str, edit: str, out: str = "''") -> str:
    """The cheapest way to ``end`` with one more edit."""
    return f"CASE WHEN {end} IS NOT NULL THEN {{'c': {end}.c + {cost}, 'a': {end}.a || '{edit}', 'r': {end}.r || {out}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_USER, _ASSISTANT, _OWN = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
_DROP = {e: f"CASE WHEN {e} IS NOT NULL THEN {{'c': {e}.c + 4, 'a': {e}.a || 'D', 'r': {e}.r}} END" for e in ("n", "s", "u", "a", "nu", "na")}


def _stay(end: str, initial: str, given: str) -> list[str]:
    """Ways that keep a row of this initial, or give it this role, behind ``end``."""
    return [f"CASE WHEN NOT doomed AND role[1] = '{initial}' THEN {_with(end, '3 * cut', 'K', _OWN)} END",
            *([f"CASE WHEN NOT doomed THEN {_with(end, '3 + 3 * cut', 'R', given + ' || text')} END"] if given else [])]


CONVERSATIONS = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("key")} % 20 AS kind
  FROM (SELECT *, {_KEY} AS key FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two
  FROM placed),
faults AS (
  SELECT *, (body = '' OR again) AS doomed, (body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?'))::int AS cut FROM judged),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((body = '')::int) AS blank,
         sum((body <> '' AND again)::int) AS duplicate, sum(cut) AS truncated, sum(coalesce(two NOT IN ('su', 'ua', 'au'), false)::int) AS illegal
  FROM faults GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::bigint AS i, {{'c': 0::bigint, 'a': '', 'r': ''}} AS n, NULL::struct(c bigint, a varchar, r varchar) AS s,
         NULL::struct(c bigint, a varchar, r varchar) AS u, NULL::struct(c bigint, a varchar, r varchar) AS a FROM counts
  UNION ALL
  SELECT conv_id, i, {_DROP['n']}, {_least(_DROP['s'], *_stay('n', 's', ''))},
         {_least(_DROP['u'], *_stay('n', 'u', _USER), *_stay('s', 'u', _USER), *_stay('a', 'u', _USER), *_stay('na', 'u', _USER))},
         {_least(_DROP['a'], *_stay('u', 'a', _ASSISTANT), *_stay('nu', 'a', _ASSISTANT))}
  FROM (SELECT f.conv_id, f.i, role, text, doomed, cut, n, s, u, a,
               {_least(_with('n', '3', 'I', _USER), _with('s', '3', 'I', _USER), _with('a', '3', 'I', _USER))} AS nu, {_with('u', '3', 'I', _ASSISTANT)} AS na
        FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
best AS (
  SELECT w.conv_id, {_least('w.n', 'w.a', _with('w.u', '3', 'I', _ASSISTANT))} AS b FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
       coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(b.c, 0)::bigint AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::bigint AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::int AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM pos p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
