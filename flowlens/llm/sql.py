"""SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

from . import quality, url_filter

_WORD = r"[^ \t\n\x0B\f\r]+"

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

_RULED = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'"
    for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])))
URLS = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE
{_RULED} END AS fit FROM parts)
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule,
  coalesce(split_part(fit, ' ', 2), CASE WHEN regexp_matches(host, '{url_filter.LISTED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""

_MARKS = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS r(n)),
marked AS (SELECT *, {_MARKS.format("text")} AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len("<|im_start|>")} + length(role) + 1 + length(body) + {len("<|im_end|>")} + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

_SYMBOLS = quality.SYMBOLS
QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
windows AS (
  SELECT row, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS said
  FROM (SELECT row, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM base WHERE len(words) >= {quality.WINDOW})),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, said) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row, CAST(sum(least({quality.WINDOW}, i - before)) AS BIGINT) AS n_repeat_words
  FROM (SELECT row, i, coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), i - {quality.WINDOW}) AS before FROM again) GROUP BY row),
counted AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[{_SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lines
  FROM base LEFT JOIN covered USING (row)),
judged AS (
  SELECT row, length(regexp_replace(line, '[ \t\n\x0B\f\r]+', '', 'g')) AS chars,
    (n < {quality.SHORT_LINE} AND NOT regexp_matches(rtrim(line), '{quality.ENDINGS.replace("'", "''")}'))
    OR len(regexp_extract_all(line, '{quality.DOUBLED}')) * 10 > n * 3
    OR (separators >= 3 AND separators * 5 >= n)
    OR notice AS fails, notice
  FROM (SELECT row, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
      len(regexp_extract_all(line, '{_WORD}')) <= {quality.BOILERPLATE_WORDS} AND regexp_matches(line, '{quality.BOILERPLATE}') AS notice,
      len(list_filter(regexp_extract_all(line, '{_WORD}'), lambda w: regexp_full_match(w, '{quality.SEPARATOR}'))) AS separators
    FROM (SELECT row, unnest(lines) AS line FROM base))),
stays AS (SELECT row, sum(chars) FILTER (NOT fails) AS stay, coalesce(sum(chars) FILTER (notice), 0) AS notices FROM judged GROUP BY row),
verdict AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
  FROM counted LEFT JOIN stays USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(stay, 0) > 0 AND coalesce(stay, 0) >= {quality.LEAST_LEFT} * (word_chars - notices) AS kept
FROM verdict"""

SEARCH = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counted AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)) AS impact
  FROM counted JOIN sizes USING (doc_id), corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10"""
