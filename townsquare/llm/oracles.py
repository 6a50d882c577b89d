"""SQL for the operators that SQL can express, written on its own from what they promise."""

from __future__ import annotations

from townsquare.llm import lexical, mixing, rules
from townsquare.llm.common import WORD


def _text(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


_N_WORDS = f"len(regexp_extract_all(line, {_text(WORD)}))"

RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, {_text(WORD)}) AS words FROM d),
places AS (
  SELECT r, words, unnest(generate_series(1, len(words) - {rules.WINDOW - 1})) AS i FROM w),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + {rules.WINDOW - 1}], ' ')) AS times FROM places),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(generate_series(i, i + {rules.WINDOW - 1})) AS p FROM windows WHERE times > 1) GROUP BY r),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (
  SELECT r, line, regexp_matches(line, {_text(WORD)}) AS is_full, (
      NOT regexp_matches(line, {_text(rules.END)}) AND ({_N_WORDS} < {rules.LONG_LINE} OR NOT regexp_matches(line, {_text(rules.MARKS)}))
      OR len(regexp_extract_all(line, {_text(rules.ODD_WORD)})) > {_N_WORDS} * {rules.MAX_ODD_WORDS}
      OR len(regexp_extract_all(line, {_text(rules.SEPARATORS)})) >= 2
      OR regexp_matches(line, {_text(rules.NAVIGATION)}) OR regexp_matches(line, {_text(rules.BOILERPLATE)})) AS bad
  FROM lines),
per_text AS (
  SELECT r, count(*) FILTER (is_full) - count(DISTINCT line) FILTER (is_full) AS n_dup_lines,
    greatest(sum(CASE WHEN is_full AND bad THEN 0 ELSE length(line) + 1 END) - 1, 0) AS left_chars
  FROM judged GROUP BY r),
measured AS (
  SELECT doc_id, text, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    len(regexp_extract_all(text, {_text(rules.SYMBOLS)})) AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    left_chars
  FROM w JOIN per_text USING (r) LEFT JOIN covered USING (r)),
verdicts AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (length(text) = 0 OR 1 - left_chars / length(text) <= {rules.MAX_LOST}) AS kept
FROM verdicts"""


def mixture(
    columns: str = "doc_id, source",
    entropy_share: float = 0.98,
    max_repeats: float = 2.0,
    block_tokens: int = 1 << 20,
    seed: int = 7,
) -> str:
    """What ``mixing.mix`` returns with these parameters and the least budget that reads all documents."""

    def uniform(*parts: str) -> str:
        text = " || ':' || ".join(parts)
        return f"('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0"

    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, {columns}, coalesce(doc_id::VARCHAR, '') AS id, md5(coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), {_text(WORD)})) + 1 AS n FROM documents),
s AS (
  SELECT source AS key, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE / (SELECT sum(n) FROM t) AS p FROM t GROUP BY source),
grid AS (
  SELECT step, step / {mixing.STEPS}.0::DOUBLE AS a FROM range({mixing.STEPS + 1}) g(step)),
sums AS (
  SELECT a, sum(pow(p, a)) AS z, sum(pow(p, a) * ln(p)) AS l, max(p) AS most, min(p) AS least FROM grid, s GROUP BY a),
measured AS (
  SELECT a, ln(z) - a * l / z AS entropy, z * pow(most, 1 - a) AS held, z * pow(most, 1 - a) * pow(least, a - 1) / z AS repeats
  FROM sums),
flat AS (
  SELECT coalesce(max(a) FILTER (entropy >= {entropy_share} * ln((SELECT count(*) FROM s)) - 1e-12), 0) AS a FROM measured),
chosen AS (
  SELECT coalesce(min(m.a) FILTER (repeats <= {max_repeats} + 1e-9), 1) AS a FROM measured m, flat WHERE m.a >= flat.a),
budget AS (
  SELECT m.a, held * (SELECT sum(tokens) FROM s) AS tokens FROM measured m JOIN chosen USING (a)),
shares AS (
  SELECT key, s.tokens, greatest(s.tokens, floor(
    pow(s.tokens::DOUBLE, b.a) / (SELECT sum(pow(tokens::DOUBLE, a)) FROM s, chosen) * b.tokens)::BIGINT) AS share
  FROM s, budget b),
passes AS (
  SELECT t.*, tokens AS all_tokens, share, epoch, {uniform(f"'{seed}'", "epoch", "id", "digest")} AS u
  FROM t JOIN shares ON source IS NOT DISTINCT FROM key, range(1000) e(epoch) WHERE epoch < ceil(share / tokens)),
placed AS (
  SELECT *, epoch * all_tokens + coalesce(sum(n) OVER (
    PARTITION BY source, epoch ORDER BY u, id, digest, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM passes),
blocks AS (
  SELECT *, floor(begins / share * (SELECT greatest(1, ceil(tokens / {block_tokens})) FROM budget))::INT AS block
  FROM placed WHERE begins < share)
SELECT {columns}, n::BIGINT AS tokens, epoch::INT AS epoch, block, (row_number() OVER (
  PARTITION BY block ORDER BY {uniform(f"'{seed}'", "'block'", "epoch", "id", "digest")}, id, digest, epoch) - 1)::INT AS position
FROM blocks"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_text(WORD)}) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM (
    SELECT doc_id, w, unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END)) AS i FROM d)),
sizes AS (
  SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN shingles USING (doc_id) GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y)
SELECT sizes.doc_id, n::BIGINT AS n_shingles, min(y) AS component_id, sizes.doc_id = min(y) AS kept
FROM sizes JOIN reached ON reached.x = sizes.doc_id GROUP BY sizes.doc_id, n"""

# On the sample tables, an article is what the element of that name holds.
MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
s AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(?:p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS body FROM a),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(
  replace(replace(replace(body, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM s)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

SEARCH = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), {_text(lexical.TERM)}) AS w FROM documents),
whole AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), {_text(lexical.TERM)})) AS t FROM benchmark),
tfs AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY t),
figures AS (
  SELECT r, doc_id, 100 - 90 + (90 * len(d.w) * docs) // terms AS m FROM d, whole WHERE len(d.w) > 0),
scores AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tfs USING (t) JOIN weights USING (t) JOIN figures USING (r) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores JOIN figures USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLES = {
    "op2_mixture": mixture(), "op8_near_duplicates": NEAR_DUPLICATES, "op10_rules": RULES,
    "op11_main_text": MAIN_TEXT, "op13_search": SEARCH,
}
