"""URL filter: explicit rules, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1: unwanted) are counted by host, registered domain
and suffix.  Each level's rate is shrunk through a beta-binomial prior towards
the level above: suffixes towards the whole, domains towards their suffix,
hosts towards their domain.  The weight of a prior is the level's method-of-
moments estimate.  A host is blocked if the lower posterior bound of its rate
(mean less ``z`` standard deviations) is above ``max_rate``.

DataFrame functions only.  Hosts without labels take the prior of their domain
or suffix.  Counts are aggregated before any shuffle; the reputation is one row
for each host and is joined by a sort-merge join, whose hot keys Spark splits,
or by a broadcast where Spark finds it below its size limit.

Defined results: null url or no ``://``: host and path are empty, rule null,
and the verdict is that of a host without any label below the whole's prior;
no labels at all: everything is allowed; a null or other label counts as none;
a page listed or labelled twice counts each time; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RATE = 0.3
Z = 1.645
MAX_WEIGHT = 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls; ``rules``: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _weight(groups: DataFrame) -> float:
    """The prior's weight by moments, from each group's n, own rate and its parent's rate (up)."""
    v = F.col("n") * F.col("up") * (1 - F.col("up"))
    t, t2, g, ss, v = groups.where("n > 0").agg(
        F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count("*"), F.sum(F.col("n") * (F.col("own") - F.col("up")) * (F.col("own") - F.col("up"))), F.sum(v)).first()
    if g < 2:
        return MAX_WEIGHT
    v = v / t
    spread = (ss - (g - 1) * v) / (t - t2 / t)
    return min(max(v / spread - 1, 1.0), MAX_WEIGHT) if spread > 0 and v > 0 else MAX_WEIGHT


def reputation(hosts: DataFrame) -> DataFrame:
    """host, rate, low of every host in ``hosts`` (host, n, bad: counts of labelled pages)."""
    level = lambda d, *by: d.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = stored(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"))))
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    whole = (bad + 0.5) / (n + 1.0) if n else 0.0

    def shrunk(groups: DataFrame) -> DataFrame:
        """Rates shrunk towards ``up``; one number for each level, the weight, goes by the driver."""
        groups = stored(groups.withColumn("own", F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(F.col("up"))))
        w = _weight(groups)
        return groups.withColumn("a", F.col("bad") + w * F.col("up")).withColumn("t", F.col("n") + w).withColumn("rate", F.col("a") / F.col("t"))

    suffix = shrunk(level(hosts, "suffix").withColumn("up", F.lit(whole)))
    domain = shrunk(level(hosts, "suffix", "domain").join(suffix.select("suffix", F.col("rate").alias("up")), "suffix"))
    host = shrunk(hosts.select("domain", "host", "n", "bad").join(domain.select("domain", F.col("rate").alias("up")), "domain"))
    a, t = F.col("a"), F.col("t")
    sd = F.sqrt(a * (t - a) / (t * t * (t + 1)))
    return host.select("host", "rate", (F.col("rate") - Z * sd).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, page_id: str = "page_id", url: str = "url",
          max_rate: float = MAX_RATE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``outcomes``: page_id, bad (1 or 0)."""
    parts = pages.select(pages[page_id].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    labels = outcomes.where("bad in (0, 1)").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    seen = parts.select("page_id", "host").join(labels, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = stored(reputation(hosts).where(F.col("low") > max_rate).select("host", F.lit("block").alias("judged")))
    rule, kind = longest_rule(F.col("host"), F.col("path"), rules)
    out = parts.join(blocked, "host", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(kind, "judged", F.lit("allow")).alias("verdict"))
