"""The registered queries of this package in SQL, where SQL can say them."""

from __future__ import annotations

from condensa.llm.preference import DEFUSED
from condensa.llm.quality_rules import RULES, STOP_WORDS

_ORACLES: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


_ORACLES["op3_preference"] = f"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i
  FROM conversations
), places AS (
  SELECT conv_id, count(*) AS n, min(i) FILTER (role = 'assistant') AS first,
         max(i) FILTER (role = 'assistant') AS last
  FROM ordered GROUP BY conv_id
), sides AS (
  SELECT o.conv_id, o.i, o.role, o.text AS c,
         CASE WHEN o.i = p.last THEN coalesce(s.text, '') ELSE o.text END AS r
  FROM ordered o JOIN places p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
  LEFT JOIN ordered s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
    AND s.i = CASE WHEN p.first = p.last THEN p.last - 1 ELSE p.first END
), common AS (
  SELECT conv_id, coalesce(min(i) FILTER (c <> r) - 1, count(*)) AS k FROM sides GROUP BY conv_id
), drawn AS (
  SELECT s.conv_id, s.i, s.role, k, '<|' || s.role || '|>' || chr(10) AS head,
         replace(c, '<|', '{DEFUSED}') || '<|end|>' || chr(10) AS c,
         replace(r, '<|', '{DEFUSED}') || '<|end|>' || chr(10) AS r
  FROM sides s JOIN common c2 ON s.conv_id IS NOT DISTINCT FROM c2.conv_id
), spans AS (
  SELECT *, coalesce(sum(length(head) + length(c)) OVER before, 0) + length(head) AS c_at,
         coalesce(sum(length(head) + length(r)) OVER before, 0) + length(head) AS r_at
  FROM drawn
  WINDOW before AS (PARTITION BY conv_id, i > k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, CAST(any_value(k) AS INTEGER) AS n_common,
  coalesce(string_agg(head || c, '' ORDER BY i) FILTER (i <= k), '') AS prompt,
  coalesce(string_agg(head || c, '' ORDER BY i) FILTER (i > k), '') AS chosen_text,
  coalesce(string_agg(c_at || '-' || (c_at + length(c)), ' ' ORDER BY i)
    FILTER (i > k AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(head || r, '' ORDER BY i) FILTER (i > k), '') AS rejected_text,
  coalesce(string_agg(r_at || '-' || (r_at + length(r)), ' ' ORDER BY i)
    FILTER (i > k AND role = 'assistant'), '') AS rejected_spans, CAST(NULL AS BIGINT) AS place
FROM spans GROUP BY conv_id
"""


def _rule_checks() -> str:
    """The threshold table as SQL conditions over the measures."""
    checks = []
    for rule in RULES:
        bounds = [f"{rule.measure} < {rule.least}"] * (rule.least is not None)
        bounds += [f"{rule.measure} > {rule.most}"] * (rule.most is not None)
        check = "(" + " OR ".join(bounds) + ")"
        checks.append(f"({check} AND n_words >= {rule.min_words})" if rule.min_words else check)
    return " OR ".join(checks)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

_SPACE = r"[\x20\x09-\x0D]+"

RULE_MEASURES = f"""
base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM base
), placed AS (
  SELECT doc_id, g, i FROM (
    SELECT doc_id, unnest(range(len(w) - 2)) AS i,
      unnest(list_transform(range(len(w) - 2), lambda k: w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3])) AS g
    FROM cut WHERE len(w) >= 4)
), repeated AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM placed) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(3, coalesce(after - i, 3))) AS n FROM repeated GROUP BY doc_id
), counted AS (
  SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(text) AS n_chars,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
    len(list_filter(w, lambda x: regexp_matches(x, '[!?|]$'))) AS n_mark,
    length(regexp_replace(array_to_string(w, ''), '\\P{{Lu}}+', '', 'g')) AS n_upper
  FROM cut c LEFT JOIN covered v USING (doc_id)
), measured AS (
  SELECT *,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_chars > 0 THEN n_symbols / n_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share,
    CASE WHEN n_words > 0 THEN n_mark / n_words ELSE 0 END AS mark_share
  FROM counted
)"""

_ORACLES["op10_quality_rules"] = f"""
WITH {RULE_MEASURES}, judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_rule_checks()}) AS kept
FROM judged
"""
