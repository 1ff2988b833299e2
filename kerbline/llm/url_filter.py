"""URL filters: rules indexed by their rarest literal token, so that a URL runs the expressions of few rules only.

Two kinds of rule. An *address* rule names a host and the beginning of a path (``example.org/en/1``) and fits the host
with all its subdomains; the longest that fits decides. A *pattern* is literal text in which ``*`` stands for anything and
``^`` for one character that is no letter or digit, or for the end; it is searched in the URL, letters A-Z and a-z alike.
Where no address rule fits, a URL is blocked if a blocking pattern is found and no allowing one, else allowed.

A token is a run of a-z and 0-9, lower case. Of the tokens that every URL fitting a rule must hold whole, the rarest
in the given URLs is the rule's key; a rule without such a token has the empty key, which all URLs fetch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    rule: str
    verdict: str
    kind: str
    expression: str
    tokens: tuple[str, ...]


def address_rule(rule: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    if not slash or not host or verdict not in ("allow", "block"):
        raise ValueError(f"not a host and path with a verdict: {rule!r}, {verdict!r}")
    host = host.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    expression = rf"^(?:[^/]*\.)?{_literal(host)}/{_literal(path)}"
    tokens = [m[0] for m in TOKEN.finditer(f"{host}/{path.lower()}") if m.end() <= len(host) + len(path)]
    return Rule(rule, verdict, "address", expression, tuple(tokens) if path.isascii() else tuple(TOKEN.findall(host)))


def pattern_rule(pattern: str, verdict: str) -> Rule:
    if not pattern.strip("*^") or verdict not in ("allow", "block"):
        raise ValueError(f"not a pattern with a verdict: {pattern!r}, {verdict!r}")
    parts = {"*": ".*", "^": "(?:[^A-Za-z0-9]|$)"}
    expression = "(?is)" + "".join(parts.get(c) or _literal(c) for c in pattern)
    lowered = pattern.lower() if pattern.isascii() else ""
    # Whole tokens only: neither the pattern's ends nor a star bound one.
    tokens = [m[0] for m in TOKEN.finditer(lowered)
              if 0 < m.start() and m.end() < len(lowered) and "*" not in lowered[m.start() - 1] + lowered[m.end()]]
    return Rule(pattern, verdict, "pattern", expression, tuple(tokens))


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


#: Patterns of the method itself: advertisement and tracking hosts, session pages, downloads.
DEFAULT_PATTERNS = tuple(pattern_rule(p, "block") for p in (
    "^adserver^", "^doubleclick^", "^ads.", "^tracker.", "/login^", "/signin^", "/logout^", "/cart^", "/checkout^",
    "/wp-admin^", ".exe^", ".apk^", ".zip^"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase),
                      F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The tokens of a URL, each once, and the empty one."""
    return F.array_distinct(F.concat(
        F.split(F.translate(url, ascii_uppercase, ascii_lowercase), r"[^a-z0-9]+"), F.array(F.lit(""))))


def _rule_rows(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = F.array(*(F.struct(
        F.lit(n).alias("number"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.kind).alias("kind"),
        F.lit(r.expression).alias("expression"),
        (F.array(*map(F.lit, dict.fromkeys(r.tokens))) if r.tokens else F.array(F.lit(""))).alias("tokens"),
    ) for n, r in enumerate(rules)))
    return spark.range(1).select(F.inline(rows))


def rule_index(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per rule with its key: the literal token that the fewest of ``urls`` (column url) hold."""
    by_token = _rule_rows(urls.sparkSession, rules).select("*", F.explode("tokens").alias("key")).drop("tokens")
    wanted = by_token.select("key").distinct()
    counts = (urls.select(F.explode(tokens_of(F.col("url"))).alias("key")).join(F.broadcast(wanted), "key", "left_semi")
              .groupBy("key").count())
    return (by_token.join(counts, "key", "left")
            .groupBy("number", "rule", "verdict", "kind", "expression")
            .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("key"))).alias("least"))
            .select("rule", "verdict", "kind", "expression", F.col("least.key").alias("key")))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: key, url, host, path, the deciding address rule (else null) and the verdict.

    Each distinct URL is judged once and the result joined back, so repeated rows and null or equal keys give one row
    each. A null URL and one without ``://`` have an empty host and path and fit no address rule; a null URL is allowed.
    The rule list is written by hand and is broadcast; ``pages`` may be empty or have further columns.
    """
    if not rules:
        raise ValueError("there are no rules")
    given = pages.select(F.col(key).alias("row_key"), F.col(url).alias("url"))
    urls = given.select("url").where(F.col("url").isNotNull()).distinct()
    index = rule_index(urls, rules)
    subject = F.when(F.col("kind") == "address", F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.col("url"))
    fits = (urls.select("url", F.explode(tokens_of(F.col("url"))).alias("key"))
            .join(F.broadcast(index), "key").where(F.regexp_like(subject, F.col("expression"))))
    address, pattern = F.col("kind") == "address", F.col("kind") == "pattern"
    judged = fits.groupBy("url").agg(
        F.max(F.when(address, F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict")))).alias("best"),
        F.max(F.when(pattern, F.col("verdict") == "allow")).alias("let"),
        F.max(F.when(pattern, F.col("verdict") == "block")).alias("stop"))
    stopped = F.coalesce("stop", F.lit(False)) & ~F.coalesce("let", F.lit(False))
    return given.join(judged, "url", "left").select(
        F.col("row_key").alias(key), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(stopped, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
