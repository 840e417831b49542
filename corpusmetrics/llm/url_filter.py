"""URL verdicts from fixed rules and an empirical-Bayes reputation of hosts; native expressions only.

Labelled outcomes of pages (bad or not) are counted by host, registered domain (the
suffix and one label more) and suffix (the last label, or the last two where these are one of
``suffixes``).  At each level the rate of
a unit is shrunk towards the posterior mean of the level above by a beta prior whose
strength comes from the beta-binomial moments of that level.  A url is blocked when
the lower posterior bound of its host's bad rate exceeds ``most_bad``.

Defined results: null urls and urls without ``://`` have empty host and path and no
rule, and are judged by the reputation of the empty host; null ids have no label; several labels of a
page all count, and so do repeated pages, each of which is a row of the result; null outcomes
count as none; of rules of equal length (ties) the first by name wins; very long urls are
ordinary ones; without any label the rate is 0.5 with the weakest prior, which blocks
nothing; empty tables give empty results; columns beyond page_id and url (page_id and
bad of the outcomes), whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: Correlation of the pages of a unit where the labels do not tell: units differ little, so a single label does not condemn its neighbours.
RHO = 0.1
#: Tasks that share the pages of one host.
SALTS = 128


def suffix_of(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring_index(url, '://', 1)"))
    tail = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(tail, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string, and its verdict; nulls where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def fits(r):
        return ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])

    def pick(value):
        return reduce(lambda c, r: c.when(fits(r), F.lit(value(r))), ordered[1:], F.when(fits(ordered[0]), F.lit(value(ordered[0]))))

    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def _strength(units: DataFrame, level: str) -> DataFrame:
    """One row: the prior strength 1/rho - 1 of a level, rho being the moment estimate of the intra-class correlation (RHO where there is none).

    The level of suffixes also gives the overall rate, under a uniform prior: labels of one kind do not make it certain.
    """
    s = units.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.sum(F.col("n") * F.col("n")).alias("Q"), F.count("*").alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("P"))
    m = F.expr("try_divide(B, N)")
    s = s.select(m.alias("m"), F.expr("(coalesce(B, 0) + 1) / (coalesce(N, 0) + 2)").alias("m_all"), F.expr("P - B * try_divide(B, N)").alias("S"), (F.col("k") - 1).cast("double").alias("d"), F.expr("N - try_divide(Q, N)").alias("w"))
    rho = F.expr("try_divide(try_divide(S, m * (1 - m)) - d, w - d)")
    rho = F.least(F.lit(0.5), F.greatest(F.lit(0.01), F.coalesce(F.when(F.isnan(rho), None).otherwise(rho), F.lit(RHO))))
    return s.select((1 / rho - 1).alias("k_" + level), *([F.col("m_all")] if level == "suffix" else []))


def reputation(labelled: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, n, bad, domain, suffix of each host with labelled pages.  ``labelled``: host, bad (0/1)."""
    counts = labelled.where("bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    domain, suffix = suffix_of(F.col("host"), suffixes)
    return counts.withColumn("domain", domain).withColumn("suffix", suffix)


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.5, z: float = 1.645, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict.  ``outcomes``: page_id, bad (0/1)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    labelled = pages.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    hosts = reputation(labelled, suffixes)
    domain, suffix = suffix_of(F.col("host"), suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # three one-row tables
    k = _strength(ends, "suffix").crossJoin(_strength(domains, "domain")).crossJoin(_strength(hosts, "host"))
    # a host that a third of all pages share meets its verdict in many tasks
    known = pages.groupBy("host", "salt").agg(F.count("*")).groupBy("host").agg(F.collect_list("salt").alias("salts"))
    known = known.withColumn("domain", domain).withColumn("suffix", suffix)
    r = (
        known.join(hosts.select("host", F.col("n").alias("n_h"), F.col("bad").alias("b_h")), "host", "left")
        .join(domains.select("domain", F.col("n").alias("n_d"), F.col("bad").alias("b_d")), "domain", "left")
        .join(ends.select("suffix", F.col("n").alias("n_s"), F.col("bad").alias("b_s")), "suffix", "left")
        .na.fill(0.0, ["n_h", "b_h", "n_d", "b_d", "n_s", "b_s"])
        .crossJoin(F.broadcast(k))
    )
    r = r.withColumn("m_s", F.expr("(b_s + k_suffix * m_all) / (n_s + k_suffix)"))
    r = r.withColumn("m_d", F.expr("(b_d + k_domain * m_s) / (n_d + k_domain)"))
    r = r.withColumn("a", F.expr("b_h + k_host * m_d")).withColumn("t", F.expr("n_h + k_host"))
    low = F.expr(f"a / t - {z} * sqrt(a * (t - a) / (t * t * (t + 1)))")
    r = r.select("host", F.explode("salts").alias("salt"), F.when(low > most_bad, F.lit("block")).otherwise(F.lit("allow")).alias("earned"))
    return pages.join(r, ["host", "salt"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, F.col("earned"), F.lit("allow")).alias("verdict"))
