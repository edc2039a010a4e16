"""URL filter: pattern rules indexed by their rarest literal token.

A URL's tokens fetch candidate rules, and only those run their regular expressions. Rules are written as

* host/path rules (``example.org/en/1``): the host and its subdomains, where the path starts with the rule's path;
* patterns over host and path: ``*`` any run, ``^`` a character other than a letter or digit or an end, ``||`` the
  start of a host label, the rest literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Rows of one URL (or without one) that a task of the last join takes; more are dealt over several.
ROWS_OF_URL = 100_000
#: Above this many rules the index is joined by a shuffle on the token; below, it is broadcast (about 200 bytes a rule).
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    length: int
    ranked: bool


def host_path_rule(verdict: str, spec: str) -> Rule:
    """Rule for a host with its subdomains and the paths that start as given; of those that fit, the longest wins."""
    host = spec.split("/", 1)[0]
    tokens = re.split(r"[^a-z0-9]+", spec.lower())
    tokens = tokens if spec[-1:] and not spec[-1].isalnum() else tokens[:-1]
    return Rule(spec, verdict, rf"^(?:[^/]*\.)?{_literal(host)}{_literal(spec[len(host):])}", tuple(t for t in tokens if t), len(spec), True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """Rule for a pattern; its literal tokens are the runs of letters and digits with a sure boundary on both sides."""
    body = pattern.removeprefix("||")
    regex = r"^(?:[^/]*\.)?" if body != pattern else ""
    regex += "".join({"*": r"[\s\S]*", "^": "(?:^|[^A-Za-z0-9]|$)"}.get(c) or _literal(c) for c in body)
    edge = "" if body != pattern else "*"
    padded = f"{edge or '^'}{body}*"
    tokens = [m[1].lower() for m in re.finditer(r"(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])", padded)]
    return Rule(pattern, verdict, regex, tuple(tokens), len(pattern), False)


def _literal(s: str) -> str:
    return re.sub(r"[^A-Za-z0-9/]", lambda m: "\\" + m[0] if ord(m[0]) < 128 else m[0], s)


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path columns: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1)), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@tidy
def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every row of ``pages``: page_id, host, path, rule (that of the longest fitting host/path rule, else null), verdict, pattern (the pattern rule that decided, else null).

    Without a fitting host/path rule, a fitting ``allow`` pattern wins over ``block`` patterns, and with neither the
    default holds; so it does for null URLs and those without ``://``. Among patterns of the winning kind the first in
    the order of text is named. Each distinct URL is judged once; repeated rows, null ids and other columns do no harm,
    and rows of one URL, or without any, are dealt over several tasks. An empty table gives no rows.
    """
    spark = pages.sparkSession
    urls = materialize(pages.groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("n")))
    host, path = url_parts(F.col("url"))
    # The leading dot gives every URL the empty token, which fetches rules that have no literal token.
    at = F.concat(host, path)
    seen = urls.where("url is not null").select("url", at.alias("_at"), F.explode(F.array_distinct(F.split(F.concat(F.lit("."), F.lower(at)), "[^a-z0-9]+"))).alias("token"))

    literal = sorted({t for r in rules for t in r.tokens})
    known = spark.createDataFrame([(t,) for t in literal], "token string")
    small = len(rules) <= BROADCAST_RULES
    known = F.broadcast(known) if small else known
    # Rows of the driver's own rules, never more than their tokens.
    counts = {r["token"]: r["n"] for r in seen.join(known, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    rows = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", r.name, r.verdict, r.regex, r.length, r.ranked) for r in rules]
    index = spark.createDataFrame(rows, "token string, name string, rule_verdict string, regex string, length int, ranked boolean")
    index = F.broadcast(index) if small else index

    fits = seen.join(index, "token").where(F.expr("_at rlike regex"))
    kind = lambda ranked, verdict: F.when((F.col("ranked") == ranked) & (F.col("rule_verdict") == verdict), F.col("name"))
    best = F.max(F.when(F.col("ranked"), F.struct("length", F.col("name").alias("rule"), F.col("rule_verdict").alias("verdict"))))
    judged = fits.groupBy("url").agg(best.alias("_best"), F.min(kind(False, "allow")).alias("_allow"), F.min(kind(False, "block")).alias("_block"))
    named = F.when(F.col("_best").isNull(), F.coalesce("_allow", "_block"))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("_allow").isNotNull(), F.lit("allow")).when(F.col("_block").isNotNull(), F.lit("block")), F.lit(default))
    parts = -(-(urls.agg(F.max("n")).first()[0] or 1) // ROWS_OF_URL)
    left = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.pmod(F.spark_partition_id(), F.lit(parts)).alias("_part"))
    judged = judged.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(judged, ["url", "_part"], "left").select("page_id", host.alias("host"), path.alias("path"), F.col("_best.rule").alias("rule"), verdict.alias("verdict"), named.alias("pattern"))
