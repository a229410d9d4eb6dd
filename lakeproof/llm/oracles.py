"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import quality, urls

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FAILS = " OR ".join(
    [f"NOT regexp_matches(l, {_q(quality.ENDING)})"]
    + [f"regexp_matches(l, {_q(p)})" for p in (quality.NAVIGATION, quality.BOILERPLATE, quality.SHOUTING, quality.SYMBOL_RUNS)]
)

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows
), repeats AS (
  SELECT doc_id, sum(least(8, coalesce(nxt, i + 8) - i)) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw FROM d)
), per_line AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(l, '{BLANK}', '', 'g'))) FILTER (WHERE NOT ({_FAILS})), 0) AS clean_chars
  FROM lines WHERE l <> '' GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(clean_chars, 0) AS clean_chars
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN per_line USING (doc_id)
), v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * (word_chars - clean_chars) > 50 * word_chars) AS kept
FROM v
"""


def _rounds(n: int, damping: float) -> str:
    """One common table expression for each propagation step."""
    step = """, r{k} AS (
  SELECT kind, host, sum(score) AS score FROM (
    SELECT kind, host, mass * (1 - {d}::DOUBLE) AS score FROM seeds
    UNION ALL SELECT e.kind, e.dst, r.score * e.share * {d}::DOUBLE FROM edges e JOIN r{j} r ON e.kind = r.kind AND e.src = r.host
  ) GROUP BY kind, host
)"""
    return "".join(step.format(k=k, j=k - 1, d=damping) for k in range(1, n + 1))


def _rule_rows() -> str:
    rows = []
    for verdict, rule in urls.RULES:
        host, path = rule.split("/", 1)
        rows.append(f"('{verdict}', '{rule}', '{host}', '/{path}')")
    return ", ".join(rows)


_P = urls.Propagation()
_LINKS = _q(urls.LINK)
URLS = rf"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {_rule_rows()}
), parts AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), judged AS (SELECT split.*, rule, ruled FROM split LEFT JOIN fits USING (page_id)
), links AS (
  SELECT src, dst, count(*) AS links FROM (
    SELECT host AS src, unnest(list_distinct([translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      for x in regexp_extract_all(coalesce(html, ''), {_LINKS}, 2)])) AS dst FROM judged)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), counted AS (
  SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS n FROM judged WHERE ruled IS NOT NULL GROUP BY ALL
), seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS mass FROM counted
), directed AS (SELECT 'trust' AS kind, src, dst, links FROM links UNION ALL SELECT 'distrust', dst, src, links FROM links
), edges AS (SELECT kind, src, dst, links / sum(links) OVER (PARTITION BY kind, src) AS share FROM directed
), r0 AS (SELECT kind, host, mass * (1 - {_P.damping}::DOUBLE) AS score FROM seeds){_rounds(_P.rounds, _P.damping)}
, hosts AS (
  SELECT host, round(coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0), 12) AS trust, round(coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0), 12) AS distrust
  FROM r{_P.rounds} GROUP BY host
)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(distrust, 0) > {_P.threshold} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM judged LEFT JOIN hosts USING (host)
"""
