"""Empirical-Bayes host reputation: labelled page outcomes shrunk from suffix to domain to host.

A host's good rate has a beta prior centred on its registered domain's rate,
that one's on its suffix's, and that one's on the overall rate.  The strength
of each level's prior is estimated from the data by moments.  A host passes
when the lower bound of its posterior good rate is high enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules (verdict, host, path) that take precedence; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Labels under which a two-letter top-level domain registers names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ReputationSettings:
    least_good: float = 0.5
    deviations: float = 1.645
    weakest: float = 1.0        # bounds of a prior's strength, in pages
    strongest: float = 1000.0


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def domain_of(host: Column) -> Column:
    """Registered domain: two labels, or three under a second-level suffix such as co.uk; port and user left out."""
    labels = F.split(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""), r"\.")
    deep = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.greatest(-F.size(labels), F.lit(-2))).isin(*SECOND_LEVEL)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - F.when(deep, 2).otherwise(1)), 3), ".")


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls; rules are configuration, a short list."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # later ones take precedence
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame, mean: Column, s: ReputationSettings) -> float:
    """Moment estimate of how many pages a level's prior is worth."""
    noise = mean * (1 - mean)
    row = units.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("spread"),
        F.sum(noise).alias("noise"), F.sum(noise * (F.col("n") - 1)).alias("room")).first()
    if not row["room"]:
        return s.strongest
    between = (row["spread"] - row["noise"]) / row["room"]
    return s.strongest if between <= 0 else min(max(1 / between - 1, s.weakest), s.strongest)


def _level(units: DataFrame, key: str, parent: str, parents: DataFrame | None, overall: float, s: ReputationSettings) -> DataFrame:
    """``units`` with their prior mean and the level's strength as ``mean`` and ``strength`` (good and n stay)."""
    joined = units.withColumn("mean", F.lit(overall)) if parents is None else units.join(
        parents.select(parent, F.col("rate").alias("mean")), parent)
    strength = _strength(joined, F.col("mean"), s)
    rate = (F.col("good") + F.lit(strength) * F.col("mean")) / (F.col("n") + F.lit(strength))
    return joined.withColumns({"strength": F.lit(strength), "rate": rate})


def host_reputation(outcomes: DataFrame, s: ReputationSettings = ReputationSettings()) -> DataFrame:
    """(host, good, n, lower_bound) from one row per page with ``host`` and ``good`` (1, 0, or null where unlabelled)."""
    hosts = outcomes.where("host <> ''").groupBy("host").agg(
        F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), F.count("good").alias("n"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host")))
    hosts = hosts.withColumn("suffix", F.regexp_replace("domain", r"^[^.]*\.", ""))
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix")
    row = suffixes.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    overall = (row["g"] + 1) / (row["n"] + 2) if row["n"] else 0.5
    by_suffix = _level(suffixes, "suffix", "", None, overall, s)
    by_domain = _level(domains, "domain", "suffix", by_suffix, overall, s)
    by_host = _level(hosts, "host", "domain", by_domain, overall, s)
    a = F.col("good") + F.col("strength") * F.col("mean")
    b = F.col("n") - F.col("good") + F.col("strength") * (1 - F.col("mean"))
    spread = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return by_host.select("host", "good", "n", F.round(a / (a + b) - s.deviations * spread, 6).alias("lower_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, s: ReputationSettings = ReputationSettings(), rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``; good, labelled and lower_bound of its host.

    ``outcomes`` holds (host, good) of labelled pages.  A url that is null or
    lacks ``://`` has an empty host and path; no host vouches for it, so it is
    blocked.  Repeated rows are judged one by one.
    """
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    seen = rows.select("host", F.lit(None).cast("int").alias("good"))
    known = host_reputation(outcomes.select("host", F.col("good").cast("int").alias("good")).unionByName(seen), s)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(known, "host", "left")
    own = F.when(F.col("lower_bound") >= s.least_good, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                         F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("n", F.lit(0)).alias("labelled"), "lower_bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of pages whose number, the digits that close the path, is that of a labelled document."""
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    numbered = pages.select(host_of("url").alias("host"), F.regexp_extract(path_of("url"), r"(\d{1,18})(\.html)?/?$", 1).alias("_n"))
    return numbered.where("_n <> ''").withColumn("doc_id", F.col("_n").cast("long")).join(told, "doc_id").select("host", "good")
