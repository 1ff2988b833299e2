"""SQL equivalents of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from kerbline.llm.license_scan import NOT_WORD, SIMILARITY
from kerbline.llm.license_templates import TEMPLATES
from kerbline.llm.url_filter import Rule


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_filter_sql(rules: tuple[Rule, ...]) -> str:
    addresses = ", ".join(f"({_text(r.rule)}, {_text(r.rule.partition('/')[0])}, {_text('/' + r.rule.partition('/')[2])}, {_text(r.verdict)})"
                          for r in rules if r.kind == "address")
    found = {v: " OR ".join(f"regexp_matches(url, {_text(r.expression)})" for r in rules if (r.kind, r.verdict) == ("pattern", v)) or "false"
             for v in ("allow", "block")}
    return f"""
        WITH addresses(rule, host, path, verdict) AS (VALUES {addresses}),
        parts AS (
            SELECT page_id, url, row_number() OVER () AS n,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        best AS (
            SELECT p.n, arg_max(a.rule, length(a.rule)) AS rule, arg_max(a.verdict, length(a.rule)) AS verdict
            FROM parts p JOIN addresses a
              ON (p.host = a.host OR ends_with(p.host, '.' || a.host)) AND starts_with(p.path, a.path)
            GROUP BY p.n)
        SELECT page_id, host, path, rule,
               coalesce(verdict, CASE WHEN ({found["block"]}) AND NOT ({found["allow"]}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN best USING (n)"""


def license_scan_sql() -> str:
    wordings = ", ".join(f"({_text(a)}, {_text(b)}, {_text(w)})" for a, b, w in TEMPLATES)

    def bigrams(text: str, source: str, columns: str) -> str:
        return f"""
            SELECT {columns}, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams
            FROM (SELECT {columns}, list_filter(string_split(regexp_replace(lower({text}), '{NOT_WORD}', ' ', 'g'), ' '), lambda w: w <> '') AS words
                  FROM {source})"""

    return f"""
        WITH wordings(license, template, wording) AS (VALUES {wordings}),
        templates AS ({bigrams("wording", "wordings", "license, template")}),
        cut AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS lines, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS paragraphs
            FROM documents),
        passages AS (
            SELECT *, row_number() OVER () AS n FROM (
                SELECT doc_id, 'line' AS kind, unnest(range(len(lines))) AS number, unnest(lines) AS passage FROM cut
                UNION ALL SELECT * FROM (
                    SELECT doc_id, 'paragraph' AS kind, unnest(range(len(paragraphs))) AS number, unnest(paragraphs) AS passage FROM cut)
                WHERE contains(passage, chr(10))
                UNION ALL SELECT doc_id, 'text', 0, text FROM cut WHERE len(paragraphs) > 1)),
        own AS ({bigrams("passage", "passages", "n, doc_id, kind, number")}),
        scored AS (
            SELECT n, doc_id, kind, number, license, template, len(o.bigrams) AS n_bigrams,
                   round(2 * len(list_intersect(o.bigrams, t.bigrams)) / (len(o.bigrams) + len(t.bigrams)), 6) AS dice
            FROM own o JOIN templates t ON len(o.bigrams) > 0)
        SELECT doc_id, kind, number, license, template, dice, n_bigrams FROM scored WHERE dice >= {SIMILARITY}
        QUALIFY row_number() OVER (PARTITION BY n ORDER BY dice DESC, license, template) = 1"""
