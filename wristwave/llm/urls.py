"""URL filter: explicit host and path rules first, then an empirical-Bayes reputation of the host.

Page outcomes (bad or not) of labelled pages are counted per host. A beta prior is fitted to the suffixes by
the method of moments; suffix posteriors are the priors of registered domains, whose posteriors are the
priors of hosts, each with the strength fitted at its level. A host is blocked when the lower bound of its
posterior bad rate exceeds ``limit``: few outcomes pull it to its domain, many speak for themselves.

Counts are combined before every shuffle. A host may hold a third of all pages: pages meet their host's
verdict in a join whose large partitions Spark splits, and hosts with over a thousandth of the pages (at
most a thousand of them) meet it in a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path): a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels; a parameter, to be replaced by a full list.
DOUBLE_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
HOT = 1000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits (of equal ones the first listed); null without one."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def suffix_of(host: Column, double=DOUBLE_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*double), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, double=DOUBLE_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*double), F.substring_index(host, ".", -3)).otherwise(two)


def strength(groups: DataFrame, low: float = 2.0, high: float = 1000.0) -> tuple[float, float]:
    """Pooled bad rate and beta strength by moments over groups (n, bad); the strength is kept between low and high.

    Five sums reach the driver.
    """
    rate = F.col("bad") / F.col("n")
    n, bad, k, s2, nn = groups.filter("n > 0").agg(
        F.sum("n"), F.sum("bad"), F.count(F.lit(1)), F.sum(F.col("bad") * rate), F.sum(F.col("n") * F.col("n"))).first()
    if not n:
        return 0.5, low
    m = (bad + 0.5) / (n + 1.0)
    within = m * (1 - m)
    if k < 2:
        return m, high
    # weighted variance of rates = within * (k - 1) / n + between * (1 - sum n^2 / n^2)
    between = (s2 / n - (bad / n) ** 2 - within * (k - 1) / n) / (1 - nn / n**2)
    return m, max(low, min(high, within / between - 1)) if between > 0 else high


def reputation(hosts: DataFrame, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """(host, n, bad) to (host, rate, bound, verdict) through suffix and registered domain."""
    one = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    domains = materialise(one.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url_domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url_suffixes")

    def posterior(prior: Column, k: float) -> Column:
        return (prior * k + F.col("bad")) / (F.col("n") + k)

    m, k = strength(suffixes)
    s = suffixes.select("suffix", posterior(F.lit(m), k).alias("above"))
    k = strength(domains)[1]
    d = domains.join(s, "suffix").select("domain", posterior(F.col("above"), k).alias("above"))
    k = strength(one)[1]
    h = one.join(d, "domain").withColumn("rate", posterior(F.col("above"), k))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + k + 1))
    return h.select("host", "rate", bound.alias("bound"), F.when(bound > limit, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, limit: float = 0.5) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, rate, bound.

    ``outcomes`` has (page, bad): one row per labelled page, bad 0 or 1; null rows are ignored, of repeated
    rows of one page the worst counts. Null urls and those without ``://`` have an empty host, judged like
    any host; without outcomes at all every page without a rule is allowed. Repeated pages get a row each.
    """
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    split = materialise(split, "url_pages")
    told = outcomes.filter("page is not null and bad is not null").groupBy("page").agg(F.max("bad").cast("long").alias("bad"))
    counts = split.join(told, split["key"] == told["page"], "left").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = materialise(counts, "url_hosts")
    total = counts.agg(F.sum("pages")).first()[0] or 0
    verdicts = materialise(reputation(counts, limit).join(counts.select("host", "pages"), "host"), "url_verdicts")
    busy = F.col("pages") * HOT > total
    hot = verdicts.filter(busy).select("host", "rate", "bound", "verdict")
    rest = verdicts.filter(~busy).select("host", "rate", "bound", "verdict")
    marked = split.join(F.broadcast(hot.select("host", F.lit(True).alias("busy"))), "host", "left")
    both = marked.filter("busy").drop("busy").join(F.broadcast(hot), "host").unionByName(marked.filter("busy is null").drop("busy").join(rest, "host"))
    return both.select(F.col("key").alias(key), "host", "path", name.alias("rule"), F.coalesce(action, F.col("verdict")).alias("verdict"), "rate", "bound")
