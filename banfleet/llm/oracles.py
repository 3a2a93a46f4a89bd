"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_LINKED = """reach AS (
    SELECT id, id AS to_id FROM nodes
    UNION SELECT r.id, p.b AS to_id FROM reach r JOIN pairs p ON p.a = r.to_id),
  classes AS (SELECT id, min(to_id) AS least FROM reach GROUP BY id),
  degrees AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)"""

EMBEDDING_DEDUP = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
  good AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  pairs AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y
    ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e)
    AND list_cosine_similarity(x.e, y.e) >= 0.93),
  {_LINKED}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, least AS component_id, id = least AS kept
FROM classes LEFT JOIN degrees USING (id)"""

NGRAM_JOIN = f"""WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
  texts AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(coalesce(text, ''),
      '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
  grams AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
  sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
  common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM grams x JOIN grams y
    ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id),
  pairs AS (SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b
    WHERE 10 * c >= 8 * (p.n + q.n - c)),
  {_LINKED}
SELECT id AS doc_id, least AS class_id, coalesce(n, 0) AS n_links
FROM classes LEFT JOIN degrees USING (id)"""


def _escaped(column: str, signs: str) -> str:
    more = " + ".join(f"len(replace({column}, '{x}', '{x}{x}'))" for x in signs)
    return f"({more} - {len(signs) - 1} * len({column}))"


CHAT = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped('role', chr(92) + '#<:')} + {_escaped('text', chr(92) + '#<')} + 14) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

# white space at the ends of a line that its key is without, and the letters it has in lower case
_ENDS = "' ' || " + " || ".join(f"chr({i})" for i in range(9, 14))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LINE_DEDUP = f"""WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
  lines AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM texts),
  keyed AS (SELECT *, translate(trim(line, {_ENDS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM lines),
  many AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(many.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE many.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN many USING (key) GROUP BY doc_id"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text: eight steps a byte."""
    step = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    byte = f"list_reduce(list_prepend(xor(u, b), repeat([0::BIGINT], 8)), lambda v, _: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda u, b: {byte}), 4294967295::BIGINT)"


PREFIX_TRIE = f"""WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number()
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
  given AS (SELECT i.conv_id, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h),
  counts AS (SELECT conv_id, max(pos) AS k FROM given GROUP BY conv_id),
  rebuilt AS (SELECT * FROM given UNION ALL
    SELECT o.conv_id, o.pos - i.h + coalesce(k, 0) AS pos, o.role, o.text
    FROM own o JOIN ids i USING (conv_id) LEFT JOIN counts USING (conv_id) WHERE o.pos > i.h),
  prefixes AS (SELECT conv_id, pos AS depth, text, list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos
      ROWS UNBOUNDED PRECEDING) AS path, max(pos) OVER (PARTITION BY conv_id) AS last FROM rebuilt
    UNION ALL SELECT i.conv_id, 0 AS depth, '' AS text, CAST([] AS VARCHAR[][]) AS path, coalesce(r.last, 0) AS last FROM ids i
      LEFT JOIN (SELECT conv_id, max(pos) AS last FROM rebuilt GROUP BY conv_id) r USING (conv_id)),
  named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM prefixes),
  nodes AS (SELECT node, depth, count(*) AS n_convs, any_value(len(text)) AS chars,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last = depth), '')) AS ends
    FROM named GROUP BY node, depth),
  linked AS (SELECT n.*, p.node AS parent FROM nodes n
    LEFT JOIN named p ON p.conv_id = n.node AND p.depth = n.depth - 1),
  fans AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY 1, 2),
  sized AS (SELECT l.*, coalesce(f.n, 0) AS n_children FROM linked l LEFT JOIN fans f USING (node, depth)),
  sums AS (SELECT a.node, a.depth, sum(CASE WHEN s.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
      sum((s.n_convs - 1) * s.chars) AS saved
    FROM sized s JOIN named a ON a.conv_id = s.node AND a.depth <= s.depth GROUP BY a.node, a.depth)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM sized JOIN sums USING (node, depth)"""


def _edit(state: str, cost: str, letter: str, line: str, holds: str = "true") -> str:
    """A state (c cost, a letters, t lines) after an edit; null where there is none."""
    return f"CASE WHEN {state} IS NOT NULL AND {holds} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _repair_step() -> str:
    """The four states after a row: without inserts, then with them."""
    nl = "chr(10) || "
    kept = lambda x, initial: _edit(x, "kind", "K", f"{nl}role || ':' || text", f"kind < 2 AND initial = '{initial}'")
    named = lambda x, role: _edit(x, "(2 + kind)", "R", f"{nl}'{role}:' || text", "kind < 2")
    gone = lambda x: _edit(x, "3", "D", "''")
    new = lambda x, role: _edit(x, "2", "I", f"{nl}'{role}:'")
    user = ", ".join(f"{named(x, 'user')}, {kept(x, 'u')}" for x in ("e", "s", "a"))
    one = f"""SELECT conv_id, i + 1 AS i, {gone('e')} AS e1, list_min([{gone('s')}, {kept('e', 's')}]) AS s1,
        list_min([{gone('u')}, {user}]) AS u1, list_min([{gone('a')}, {named('u', 'assistant')}, {kept('u', 'a')}]) AS a1
      FROM best JOIN faulted USING (conv_id) WHERE pos = i + 1"""
    two = f"""SELECT conv_id, i, e1, s1, a1, list_min([u1, {new('e1', 'user')}, {new('s1', 'user')}, {new('a1', 'user')}]) AS u2 FROM ({one})"""
    return f"SELECT conv_id, i, e1 AS e, s1 AS s, u2 AS u, list_min([a1, {new('u2', 'assistant')}]) AS a FROM ({two})"


_BODY = f"rtrim(text, {_ENDS})"
_STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
_CONTENT = "coalesce(role, ' ') AS role, coalesce(text, ' ') AS text"
_TOLD = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
CONVERSATION_REPAIR = f"""WITH RECURSIVE hashed AS (SELECT conv_id, turn, {_CONTENT}, {_crc32(_TOLD)} % 20 AS how FROM conversations),
  rows AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
      CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE how <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM rows),
  judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN {_BODY} = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right({_BODY}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS pair FROM placed),
  faulted AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 2 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS kind FROM judged),
  best(conv_id, i, e, s, u, a) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}::{_STATE}, NULL::{_STATE},
      {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}}::{_STATE}, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}::{_STATE} FROM faulted
    UNION ALL {_repair_step()}),
  ended AS (SELECT conv_id, max(i) AS i FROM best GROUP BY conv_id),
  cheapest AS (SELECT conv_id, list_min([e, a]) AS x FROM best JOIN ended USING (conv_id, i)),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
      count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
      count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulted GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(x.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN cheapest USING (conv_id)"""

ORACLES = {
    "op1_embedding_dedup": EMBEDDING_DEDUP,
    "op7_ngram_join": NGRAM_JOIN,
    "op9_chat": CHAT,
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_line_dedup": LINE_DEDUP,
}
