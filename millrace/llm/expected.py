"""DuckDB SQL for the queries of this subpackage that SQL can state.

The others have no SQL: language, quality (models), packing, token counts and
byte-pair encoding (tokenizers), SimHash (its hash function), neighbours
(approximate), whitening (eigenvectors) and sharding (a greedy deal) are tested against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

from millrace.llm.chat import CONTROLS


def _escaped_pattern() -> str:
    """A control string, or one that has been escaped, for a regular expression in SQL."""
    quoted = lambda text: "".join(f"\\{c}" if c in "[]|" else c for c in text)
    return "|".join(rf"{quoted(c[0])}\\*{quoted(c[1:])}" for c in CONTROLS)


_CHAT = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS name FROM said
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(
    length('<|im_start|>' || '<|im_end|>') + 2 + length(name) + length(text)
    + len(regexp_extract_all(name, '{_escaped_pattern()}'))
    + len(regexp_extract_all(text, '{_escaped_pattern()}'))
  )::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM documents
), items AS (
  SELECT item_id, {_WORDS} AS words, least(10, len(words)) AS n FROM benchmark
), windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(words[k : k + n - 1], ' ') AS part
  FROM items, unnest(range(1, len(words) - n + 2)) AS t(k) WHERE n > 0
), parts AS (
  SELECT row_id, k, n, array_to_string(words[k : k + n - 1], ' ') AS part
  FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(words) >= n,
    unnest(range(1, len(words) - n + 2)) AS t(k)
), hits AS (
  SELECT row_id, k, n, item FROM parts JOIN windows USING (n, part)
), covered AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS u(p) GROUP BY row_id
), found AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT row_id, item FROM hits WHERE item IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN found USING (row_id)
"""

_SUBSTRINGS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT row_id, doc_id, k, array_to_string(words[k : k + 49], ' ') AS part
  FROM docs, unnest(range(1, len(words) - 48)) AS t(k)
), firsts AS (
  SELECT part, min(doc_id) AS least FROM windows GROUP BY part HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT row_id, p FROM windows JOIN firsts USING (part), unnest(range(k, k + 50)) AS u(p)
  WHERE least < doc_id
), kept AS (
  SELECT row_id, string_agg(words[p], ' ' ORDER BY p) AS text
  FROM docs, unnest(range(1, len(words) + 1)) AS t(p)
  WHERE (row_id, p) NOT IN (SELECT (row_id, p) FROM gone) GROUP BY row_id
), counts AS (SELECT row_id, count(*) AS n FROM gone GROUP BY row_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN counts USING (row_id) LEFT JOIN kept USING (row_id)
"""

_COLLOCATIONS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM docs, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS t(piece)
), starts AS (
  SELECT lang, words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3
  FROM pieces, unnest(range(1, len(words) + 1)) AS t(i)
), ones AS (
  SELECT lang, w1, count(*) AS f FROM starts GROUP BY ALL
), twos AS (
  SELECT lang, w1, w2, count(*) AS f FROM starts WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), threes AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM starts WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY lang
), longer AS (
  SELECT lang, w1, w2, max(f) AS most FROM (
    SELECT lang, w1, w2, f FROM threes UNION ALL SELECT lang, w2, w3, f FROM threes
  ) GROUP BY lang, w1, w2
), cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS cut, p.f AS a, x.f AS l, y.f AS r
  FROM twos p LEFT JOIN longer t ON t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2
    JOIN ones x ON x.lang = p.lang AND x.w1 = p.w1
    JOIN ones y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE coalesce(100 * t.most < 50 * p.f, true)
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, 1, p.f, x.f, y.f FROM threes p
    JOIN ones x ON x.lang = p.lang AND x.w1 = p.w1
    JOIN twos y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, 2, p.f, x.f, y.f FROM threes p
    JOIN twos x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2
    JOIN ones y ON y.lang = p.lang AND y.w1 = p.w3
), scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang)
QUALIFY rank <= 2000
"""

EXPECTED: dict[str, str] = {
    "op2_chat": _CHAT,
    "op5_decontamination": _DECONTAMINATION,
    "op8_substrings": _SUBSTRINGS,
    "op13_collocations": _COLLOCATIONS,
}
