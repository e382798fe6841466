"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over a whole URL and the literal tokens (runs of
ASCII letters and digits, lower-cased) that any URL it matches must contain as
whole tokens. Token frequencies are counted over all URLs, each rule is filed under its rarest
token, and a URL's tokens fetch the only rules whose expressions are tried on it.
Rules without a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import broadcast_if_small, durable

#: After the first ``://``: the host up to ``/``, ``?``, ``#`` or the end, and the path up to ``?``, ``#`` or the end.
PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against ``host/path`` text as ``host`` + ``path`` + rest, host in lower case.

    Of the rules that match, the one with the highest ``weight`` decides; on equal
    weights the smaller name does. ``listed`` rules show in the result.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool


def site_rule(verdict: str, name: str) -> Rule:
    """A rule on a host with all subdomains and a path prefix, like ``example.net/en/``; longer names win."""
    host, slash, path = name.partition("/")
    pattern = rf"^([^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # The last piece of the path may go on in the URL, so only what a separator ends is a whole token.
    whole = re.findall(r"[a-z0-9]+(?![a-z0-9]*$)", name)
    return Rule(name, verdict, pattern, tuple(whole), 1_000_000 + len(name), True)


SITE_RULES = tuple(
    site_rule(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
)
#: The method's own rules, for URLs that no listed rule fits. Each names tokens that stand between separators.
PATTERN_RULES = tuple(
    Rule(name, "block", pattern, tokens, 1, False)
    for name, pattern, tokens in (
        ("pills", r"(?i)(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)", ("cheap", "pills")),
        ("casino", r"(?i)^[^/?#]*(?<![a-z0-9])casino(?![a-z0-9])", ("casino",)),
        ("adult", r"(?i)^[^/?#]*(?<![a-z0-9])(xxx|porn)(?![a-z0-9])", ()),
        ("login", r"(?i)^[^/?#]*/([^?#]*/)?login([/?#.]|$)", ("login",)),
    )
)


def _lower(text: Column) -> Column:
    return F.translate(text, *ASCII)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.weight, r.listed) for r in rules]
    return spark.createDataFrame(rows, "name string, rule_verdict string, pattern string, tokens array<string>, weight long, listed boolean")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict, decided_by)`` for every row of ``pages(page_id, url)``.

    A null URL or one without ``://`` has an empty host and path and matches no rule.
    Rows are judged one by one, so repeated rows and null ids stay as they are; each
    distinct URL is matched once. ``rule`` is the deciding rule if it is a listed one,
    else null; ``decided_by`` also names the others. Further columns are ignored, an
    empty table gives an empty result, and without rules all get the default.
    """
    part = lambda n: F.coalesce(F.regexp_extract("url", PARTS, n), F.lit(""))
    rest = F.coalesce(F.regexp_replace("url", r"^(?s:.*?)://[^/?#]*", ""), F.lit(""))
    urls = pages.select("page_id", "url", _lower(part(1)).alias("host"), part(2).alias("path"), rest.alias("rest"), F.coalesce(F.col("url").contains("://"), F.lit(False)).alias("whole"))
    targets = urls.where("whole").select(F.concat("host", "rest").alias("target")).distinct()
    words = targets.select("target", F.explode(_tokens(F.col("target"))).alias("token"))

    # A rule is filed under the rarest of its tokens; a token no URL has is the rarest of all.
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    frequency = words.join(broadcast_if_small(durable(wanted.select("token").distinct())), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(frequency, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("of"))
    index = durable(rules.join(rarest, "name", "left").select("name", "rule_verdict", "pattern", "weight", "listed", F.col("of.token").alias("token")))

    found = words.join(broadcast_if_small(index.where("token is not null")), "token").drop("token")
    # Rules that no token can index are tried on every URL: they are filed under a token that all URLs have.
    everywhere = targets.withColumn("token", F.lit("")).join(broadcast_if_small(index.where("token is null").withColumn("token", F.lit(""))), "token").drop("token")
    tried = found.unionByName(everywhere).where(F.expr("target RLIKE pattern"))
    best = tried.groupBy("target").agg(F.min(F.struct((-F.col("weight")).alias("w"), "name", "rule_verdict", "listed")).alias("best"))

    out = urls.join(best, F.when(F.col("whole"), F.concat("host", "rest")) == best["target"], "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.col("best.name").alias("decided_by"),
    )
