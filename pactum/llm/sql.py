"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import FAMILIES, MEASURES, PARTS, PRIOR, SPREAD, TWO_SIDED

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = f"""
lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM {{docs}})
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <= f.first_doc, true) AS stays
  FROM lines l LEFT JOIN firsts f ON l.key = f.key
)"""

OP7 = f"""
WITH {_LINES.format(docs="documents")}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def _bin(v: str) -> str:
    return f"(({v} >> greatest(length(bin({v})) - 5, 0)) << greatest(length(bin({v})) - 5, 0))"


_FAMILIES: dict[str, list[str]] = {}
for _m, _family in FAMILIES.items():
    _low = f" OR coalesce({_bin(f'm.{_m}')} < w.{_m}_least, false)" if _m in TWO_SIDED else ""
    _FAMILIES.setdefault(_family, []).append(f"coalesce({_bin(f'm.{_m}')} > w.{_m}, false){_low}")
_OUTLIERS = " + ".join(f"CAST({' OR '.join(x)} AS INT)" for x in _FAMILIES.values())

_QUALITY = f"""
tokens AS (
  SELECT doc_id, w, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {{docs}})
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM tokens WHERE i + 2 <= len(w)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times >= 2 GROUP BY doc_id
), base AS (
  SELECT d.doc_id, d.lang, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(full_lines) AS n_lines,
         len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up
  FROM (SELECT *, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WS}) <> '') AS full_lines FROM {{docs}}) d
  LEFT JOIN covered c ON c.doc_id = d.doc_id
), measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CAST(1000 * n_symbols // greatest(word_chars, 1) AS BIGINT) AS q_symbols, CAST(1000 * n_dup_lines // greatest(n_lines, 1) AS BIGINT) AS q_dup_lines,
         CAST(1000 * n_repeat_words // greatest(n_words, 1) AS BIGINT) AS q_repeats, CAST(100 * word_chars // greatest(n_words, 1) AS BIGINT) AS q_word_chars,
         CAST(1000 * up // greatest(word_chars, 1) AS BIGINT) AS q_upper
  FROM base
), long AS (
  SELECT lang, source, measure, {_bin("v")} AS b
  FROM (UNPIVOT (SELECT doc_id, lang, source, {", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in MEASURES)} FROM measured WHERE NOT base_failed)
        ON {", ".join(MEASURES)} INTO NAME measure VALUE v)
), own AS (
  SELECT lang, source, measure, b, count(*) AS n FROM long GROUP BY ALL
), langs AS (
  SELECT lang, measure, b, sum(n) AS n FROM own GROUP BY ALL
), overall AS (
  SELECT *, sum(n) OVER (PARTITION BY measure) AS total FROM (SELECT measure, b, sum(n) AS n FROM own GROUP BY ALL)
), lang_bins AS (
  SELECT g.lang, a.measure, a.b, {PARTS} * coalesce(l.n, 0) + a.n * {PRIOR * PARTS} // a.total AS n
  FROM (SELECT DISTINCT lang FROM own) g CROSS JOIN overall a
  LEFT JOIN langs l ON l.lang IS NOT DISTINCT FROM g.lang AND l.measure = a.measure AND l.b = a.b
), group_bins AS (
  SELECT g.lang, g.source, l.measure, l.b, {PARTS} * coalesce(o.n, 0) + l.n * {PRIOR * PARTS} // sum(l.n) OVER (PARTITION BY g.lang, g.source, l.measure) AS n
  FROM (SELECT DISTINCT lang, source FROM own) g JOIN lang_bins l ON l.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.measure = l.measure AND o.b = l.b
), lang_mids AS (
  SELECT lang, measure, min(b) AS mid FROM (
    SELECT *, 2 * sum(n) OVER (PARTITION BY lang, measure ORDER BY b) >= sum(n) OVER (PARTITION BY lang, measure) AS half FROM lang_bins)
  WHERE half GROUP BY ALL
), group_mids AS (
  SELECT lang, source, measure, min(b) AS mid FROM (
    SELECT *, 2 * sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) >= sum(n) OVER (PARTITION BY lang, source, measure) AS half FROM group_bins)
  WHERE half GROUP BY ALL
), lang_reach AS (
  SELECT x.lang, x.measure, floor(100 * CAST(sum(n * greatest(b - mid, 0)) AS DOUBLE) / sum(n)) AS above, floor(100 * CAST(sum(n * greatest(mid - b, 0)) AS DOUBLE) / sum(n)) AS below
  FROM lang_bins x JOIN lang_mids m ON x.lang IS NOT DISTINCT FROM m.lang AND x.measure = m.measure GROUP BY ALL
), group_reach AS (
  SELECT x.lang, x.source, x.measure, mid, floor(100 * CAST(sum(n * greatest(b - mid, 0)) AS DOUBLE) / sum(n)) AS above, floor(100 * CAST(sum(n * greatest(mid - b, 0)) AS DOUBLE) / sum(n)) AS below
  FROM group_bins x JOIN group_mids m ON x.lang IS NOT DISTINCT FROM m.lang AND x.source IS NOT DISTINCT FROM m.source AND x.measure = m.measure GROUP BY ALL
), limits AS (
  SELECT g.lang, g.source, g.measure, mid + floor({SPREAD} * least(g.above, 2 * l.above) / 100) AS most, mid - floor({SPREAD} * least(g.below, 2 * l.below) / 100) AS least
  FROM group_reach g JOIN lang_reach l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure
), wide AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN measure = '{m}' THEN most END) AS {m}, max(CASE WHEN measure = '{m}' THEN least END) AS {m}_least" for m in MEASURES)} FROM limits GROUP BY ALL
), judged AS (
  SELECT m.*, NOT m.base_failed AND {_OUTLIERS} < 2 AS kept
  FROM measured m LEFT JOIN wide w ON m.lang IS NOT DISTINCT FROM w.lang AND m.source IS NOT DISTINCT FROM w.source
)"""

OP4 = f"""
WITH {_QUALITY.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""

ORACLES = {"op4_quality_rules": OP4, "op7_line_dedup": OP7}
