"""The DuckDB form of conversation chunks: two recursive folds, one row a conversation and step."""

from __future__ import annotations

from lexarium.operators.chunk import HIGH_VALUE, MAX_CHARS, MIN_CHARS, MIN_KEEP, TARGET_CHARS
from lexarium.plans.preparation import q_normalize, q_strip
from lexarium.plans.surface import CLEAN_MESSAGES, q_pages


def q_split(x: str) -> str:
    """A text as pieces of at most ``MAX_CHARS`` characters."""
    whole = q_normalize(x)
    parts = f"list_filter(list_transform(string_split({whole}, chr(10) || chr(10)), lambda x: {q_strip('x')}), lambda x: x <> '')"
    return f"CASE WHEN length({whole}) <= {MAX_CHARS} THEN list_filter([{whole}], lambda x: x <> '') ELSE {q_pages(parts, None, MAX_CHARS)} END"


def q_length(x: str) -> str:
    """Characters of open pieces with the line feeds between them."""
    return f"coalesce(list_sum(list_transform({x}, lambda w: length(w) + 1)) - 1, 0)"


def q_joined(x: str) -> str:
    return q_normalize(f"array_to_string({x}, chr(10))")


FULL = f"{q_length('na')} BETWEEN {max(MIN_CHARS, TARGET_CHARS)} AND {MAX_CHARS}"
CONVERSATION_CHUNKS = f"""WITH RECURSIVE cm AS ({CLEAN_MESSAGES}),
said AS (SELECT conv_id, turn, CASE WHEN {q_strip("lower(coalesce(nullif(role, ''), 'user'))")} = 'user' THEN 'User: ' ELSE 'Assistant: ' END AS label, {q_strip("coalesce(content_retrieval, '')")} AS txt_a, {q_strip("coalesce(content_raw, '')")} AS txt_b FROM cm),
labelled AS (SELECT conv_id, turn, label || coalesce(nullif(txt_a, ''), txt_b) AS txt_a, label || coalesce(nullif(txt_b, ''), txt_a) AS txt_b FROM said WHERE txt_a <> '' OR txt_b <> ''),
turns AS (SELECT * FROM (SELECT *, lag(txt_a) OVER w AS pa, lag(txt_b) OVER w AS pb FROM labelled WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE pa IS NULL OR pa <> txt_a OR pb <> txt_b),
split AS (SELECT conv_id, turn, {q_split('txt_a')} AS x, {q_split('txt_b')} AS y FROM turns),
fitted AS (SELECT conv_id, turn, x, CASE WHEN len(y) > len(x) THEN list_append(y[1:len(x) - 1], {q_joined('y[len(x):]')}) ELSE y END AS y FROM split),
each_ AS (SELECT conv_id, turn, generate_subscripts(x, 1) AS pos, unnest(x) AS a, y FROM fitted),
pieces AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS i, count(*) OVER (PARTITION BY conv_id) AS all_, a, coalesce(nullif(y[pos], ''), a) AS b FROM each_),
folded(conv_id, i, all_, oa, ob, over_a, over_b, full_a, full_b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, all_, []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR[], NULL::VARCHAR[], NULL::VARCHAR[], NULL::VARCHAR[] FROM pieces
  UNION ALL SELECT conv_id, i, all_, CASE WHEN {FULL} THEN [] ELSE na END, CASE WHEN {FULL} THEN [] ELSE nb END, over_a, over_b, CASE WHEN {FULL} THEN na END, CASE WHEN {FULL} THEN nb END
  FROM (SELECT conv_id, i, all_, CASE WHEN spills THEN oa END AS over_a, CASE WHEN spills THEN ob END AS over_b,
      list_append(CASE WHEN NOT spills THEN oa WHEN {q_length('oa[-1:]')} + length(a) + 1 > {MAX_CHARS} THEN [] ELSE oa[-1:] END, a) AS na,
      list_append(CASE WHEN NOT spills THEN ob WHEN {q_length('oa[-1:]')} + length(a) + 1 > {MAX_CHARS} THEN [] ELSE ob[-1:] END, b) AS nb
    FROM (SELECT f.conv_id, p.i, f.all_, oa, ob, p.a, p.b, len(oa) > 0 AND {q_length('oa')} + 1 + length(p.a) > {MAX_CHARS} AS spills FROM folded f JOIN pieces p ON p.conv_id = f.conv_id AND p.i = f.i + 1))),
closed AS (SELECT conv_id, i, 1 AS kind, over_a AS x, over_b AS y FROM folded WHERE over_a IS NOT NULL UNION ALL SELECT conv_id, i, 2, full_a, full_b FROM folded WHERE full_a IS NOT NULL
  UNION ALL SELECT conv_id, i, 3, oa, ob FROM folded WHERE i = all_ AND len(oa) > 0),
chunks AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i, kind) - 1 AS n, {q_joined('x')} AS a, {q_joined('y')} AS b, len(x) AS turns FROM closed),
merged(conv_id, pos, n, a, b, turns) AS (SELECT conv_id, n, n, a, b, turns FROM chunks WHERE n = 0 UNION ALL
  SELECT conv_id, pos, CASE WHEN short THEN n ELSE pos END, CASE WHEN short THEN {q_normalize("a || chr(10) || ca")} ELSE ca END, CASE WHEN short THEN {q_normalize("b || chr(10) || cb")} ELSE cb END, CASE WHEN short THEN turns + ct ELSE ct END
  FROM (SELECT m.conv_id, c.n AS pos, m.n, m.a, m.b, m.turns, c.a AS ca, c.b AS cb, c.turns AS ct, length(c.a) < {MIN_CHARS} AND length(m.a) + 1 + length(c.a) <= {MAX_CHARS} AS short FROM merged m JOIN chunks c ON c.conv_id = m.conv_id AND c.n = m.pos + 1)),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY pos DESC) AS last FROM merged) WHERE last = 1),
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY n) AS nth FROM ends) WHERE nth = 1),
good AS (SELECT *, length(a) >= {MIN_KEEP} OR regexp_matches(a, '{HIGH_VALUE.pattern}') AS good FROM single),
chosen AS (SELECT *, bool_or(good) OVER (PARTITION BY conv_id) AS any_good, max(n) OVER (PARTITION BY conv_id) AS newest FROM good)
SELECT conv_id, format('conv_{{}}_chunk_{{:03d}}', conv_id, n) AS chunk_id, a AS text, b AS text_raw, length(a) AS char_len, turns AS n_turns, false AS retrieval_fallback_used FROM chosen WHERE good OR (NOT any_good AND n = newest)"""
