"""URL filter: rules first, then the empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import LOWER, UPPER
from gristmill.session import stage

# (action, host with its subdomains, start of the path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn")
# One-sided 95 % bound, and the share of bad pages that is put up with.
Z = 1.645
MOST_BAD = 0.5
# Pseudo-pages of the flat prior of the overall rate.
FLAT = 1.0
# Bounds of the correlation of a parent's children: a prior counts for 4 to 999 pages.
RHO = (0.001, 0.2)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its action; nulls if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        action = F.when(fits, F.lit(does)).otherwise(action)
    return rule, action


def registered_domain(host: Column) -> tuple[Column, Column]:
    """Domain and suffix of a host, without user and port. A host of one label is both."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last_two = F.substring_index(bare, ".", -2)
    two = last_two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(two, last_two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two, F.substring_index(bare, ".", -3)).otherwise(last_two)
    return domain, suffix


def _strength(level: DataFrame, mean: str) -> DataFrame:
    """One row: how many pages a parent's rate is worth, from the spread of its children.

    Moments of the beta-binomial: the excess of the children's spread around their parents
    over the binomial one gives their correlation rho, and 1 / rho - 1 is the prior's size.
    """
    n, y, m = F.col("n"), F.col("bad"), F.col(mean)
    spread = F.sum(F.when(n > 0, y * y / n - 2.0 * m * y + n * m * m))
    binomial = F.sum(F.when(n > 0, m * (1.0 - m)))
    more = F.sum(F.when(n > 0, m * (1.0 - m) * (n - 1.0)))
    rho = F.when(more > 0, (spread - binomial) / more).otherwise(F.lit(0.0))
    bounded = F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), F.coalesce(rho, F.lit(0.0))))
    return level.agg(bounded.alias("rho")).select((1.0 / F.col("rho") - 1.0).alias("strength"))


def _shrunk(level: DataFrame, parent: str, name: str) -> tuple[DataFrame, float]:
    strength = _strength(level, parent).first()["strength"]
    mean = (F.col("bad") + F.lit(strength) * F.col(parent)) / (F.col("n") + F.lit(strength))
    return level.withColumn(name, mean), strength


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``(host, n, bad, mean, bad_bound)`` from page outcomes ``(host, bad)``.

    ``bad`` is 1, 0 or null for a page without a label; such pages still name their host. The
    overall rate is the prior of each suffix, a suffix's shrunk rate that of its domains, and a
    domain's that of its hosts; how much each prior counts is estimated from all children of
    the level. ``bad_bound`` is the lower bound of a host's bad rate, ``z`` standard deviations
    below its beta posterior's mean. A host without outcomes has its domain's rate.

    Pages are summed per host before any join; the levels above are sums of those sums, and the
    three strengths are one number each.
    """
    hosts = outcomes.groupBy("host").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"),
        F.count("bad").cast("double").alias("n"),
    )
    domain, suffix = registered_domain(F.col("host"))
    hosts = stage(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    overall = ((bad or 0.0) + FLAT / 2) / ((n or 0.0) + FLAT)
    domains = stage(summed(hosts, "domain", "suffix"), "domains")
    suffixes = stage(summed(domains, "suffix").withColumn("over", F.lit(overall)), "suffixes")
    suffixes, _ = _shrunk(suffixes, "over", "suffix_mean")
    domains = stage(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "domain-priors")
    domains, _ = _shrunk(domains, "suffix_mean", "domain_mean")
    hosts = stage(hosts.join(domains.select("domain", "suffix", "domain_mean"), ["domain", "suffix"]), "host-priors")
    hosts, strength = _shrunk(hosts, "domain_mean", "mean")
    size = F.col("n") + F.lit(strength)
    deviation = F.sqrt(F.col("mean") * (1.0 - F.col("mean")) / (size + 1.0))
    bound = F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * deviation)
    return hosts.select("host", "n", "bad", "mean", bound.alias("bad_bound"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, bad)``: a page is bad if the document it shows is labelled poor or toxic.

    The document is the number that ends the url's path. Pages without such a number or
    without a label have a null outcome. Several labels of a document count as the worst.
    """
    number = F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    shown = pages.select(
        url_host(F.col("url")).alias("host"),
        F.when(number != "", number).cast("long").alias("doc_id"),
    )
    worst = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    )
    return shown.join(worst, "doc_id", "left").select("host", "bad")


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = MOST_BAD, z: float = Z
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_bound)`` for every page.

    A rule decides where one fits. Elsewhere a page is blocked if even the lower bound of its
    host's bad rate exceeds ``most_bad``: a host is filtered on evidence, not for lack of it.
    Null urls have an empty host, which is a host like any other. Repeated rows stay.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(outcomes, z).select("host", "bad_bound")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")
    return cut.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "bad_bound"
    )
