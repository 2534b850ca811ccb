"""URL filters: stated rules first, then the reputation of the page's host.

Empirical-Bayes host reputation.  The outcomes of labelled pages (bad or not) are counted per host,
registered domain and suffix.  A rate is shrunk through beta-binomial priors: all pages give the
prior of a suffix, the suffix that of its domains, the domain that of its hosts.  How much a level
trusts its prior (the prior's weight in pages) is fitted to the spread of its groups by moments:
with n labelled pages, k bad ones and prior mean m, the excess of sum((k - nm)^2) over the binomial
sum(n m (1 - m)), as a share of sum(n (n - 1) m (1 - m)), is 1 / (weight + 1).  A host's posterior is
a beta distribution; the host is blocked where its bad rate is above ``LIMIT`` with a probability of
at least 1 - ``DOUBT``.  That bound is Cantelli's: mean - sd * sqrt((1 - doubt) / doubt), which holds
for every distribution, so a host is never blocked on fewer outcomes than the exact quantile asks for.

All of it is DataFrame functions.  Pages are counted per host before anything is joined.  A fact
that more than a thousandth of the rows need is broadcast (there are fewer than a thousand such
facts at any size), all others meet by a shuffle in which no key holds more than that share.

Rules: the host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; the path reaches from there to ``?``, ``#`` or the end.  A null url or one without
``://`` has an empty host and path; such pages share one reputation.  A user name, a port and
trailing dots do not count for the domain; an address of digits or a host of one label is its own
domain and suffix.  Each row of a repeated page counts.  A page with several outcomes is bad if one is; null
ids have none.  Without any outcome the prior is one half, with the whole doubt, and nothing is blocked.  Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: A host is blocked if its bad rate is above LIMIT with a probability of at least 1 - DOUBT.
LIMIT, DOUBT = 0.5, 0.05
#: Bounds of the weight of a prior, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: Facts needed by more than one in so many rows are broadcast.
SHARE = 1000
# fixed values: common suffixes of two labels
TWO_LABELS = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "gov.au", "gov.uk", "net.au", "or.jp", "org.au", "org.uk",
)


class Rule(NamedTuple):
    """A verdict on the pages of a host and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.translate(F.coalesce(host, empty), upper, upper.lower()), F.coalesce(path, empty)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null where none does; ties go to the longer host, then the smaller text.

    The rules are a caller's list, so they become one expression and no join.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host + r.path))

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    found = [F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix under which it is registered."""
    bare = F.regexp_extract(F.regexp_replace(host, "^[^@]*@", ""), r"^([^:]*?)\.*(?::|$)", 1)
    labels = F.split(bare, r"\.")
    single = (F.size(labels) == 1) | bare.rlike("^[0-9.]+$")
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    two = (F.size(labels) > 2) & last_two.isin(*TWO_LABELS)
    domain = F.when(two, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(last_two)
    suffix = F.when(two, last_two).otherwise(F.element_at(labels, -1))
    return F.when(single, bare).otherwise(domain), F.when(single, bare).otherwise(suffix)


def with_fact(rows: DataFrame, facts: DataFrame, key: str, needed: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one fact per key; ``needed`` is the number of rows that need it, ``total`` their sum.

    Fewer than ``SHARE`` facts are needed by more than ``total / SHARE`` rows: these are broadcast.
    """
    hot = F.col(needed) * SHARE > total
    common = F.broadcast(facts.where(hot).drop(needed))
    seldom = rows.join(common.select(key), key, "left_anti").join(facts.where(~hot).drop(needed), key)
    return rows.join(common, key).unionByName(seldom)


def _weight(groups: DataFrame) -> float:
    """Weight of the prior ``mean``, in pages, fitted to groups of n outcomes with k bad ones."""
    spread = F.col("mean") * (1 - F.col("mean"))
    excess, pairs = groups.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("mean"), F.lit(2.0)) - F.col("n") * spread),
        F.sum(F.col("n") * (F.col("n") - 1) * spread),
    ).first()
    if not pairs or excess <= 0:
        return MOST_WEIGHT
    return min(max(pairs / excess - 1, LEAST_WEIGHT), MOST_WEIGHT)


def _shrunk(weight: float) -> Column:
    return (F.col("k") + weight * F.col("mean")) / (F.col("n") + weight)


def page_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad) of labels (doc_id, quality, toxic): bad if of low quality or toxic; unlabelled rows are left out."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def host_reputations(pages: DataFrame, outcomes: DataFrame, doubt: float = DOUBT) -> DataFrame:
    """host, pages, n, k (labelled pages, bad ones), rate (posterior mean), bound (lower, of the bad rate).

    ``pages`` needs page_id and host, ``outcomes`` has one row per page_id with bad 0 or 1.
    """
    labelled = pages.select("page_id", "host").join(outcomes, "page_id")
    one, none = F.lit(1), F.lit(0)
    counted = pages.select("host", one.alias("pages"), none.alias("n"), none.alias("k")).union(
        labelled.select("host", none, one, "bad")
    )
    sums = [F.sum(c).alias(c) for c in ("pages", "n", "k")]
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = staged(counted.groupBy("host").agg(*sums).select("*", domain.alias("domain"), suffix.alias("suffix")))
    n_hosts, n, k = hosts.agg(F.count(one), F.sum("n"), F.sum("k")).first()
    root = ((k or 0) + 0.5) / ((n or 0) + 1.0)

    by_domain = staged(
        hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(one).alias("members"))
    )
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(one).alias("members"))
    by_suffix = by_suffix.withColumn("mean", F.lit(root))
    n_domains = by_domain.count()
    suffixes = by_suffix.select("suffix", "members", _shrunk(_weight(by_suffix)).alias("mean"))
    domains = staged(with_fact(by_domain.withColumnRenamed("members", "hosts"), suffixes, "suffix", "members", n_domains))
    means = domains.select("domain", F.col("hosts").alias("members"), _shrunk(_weight(domains)).alias("mean"))
    placed = staged(with_fact(hosts, means, "domain", "members", n_hosts))
    weight = _weight(placed)
    rate = _shrunk(weight)
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + weight + 1))
    bound = rate - deviation * F.sqrt(F.lit((1 - doubt) / doubt))
    return placed.select("host", "pages", "n", "k", rate.alias("rate"), bound.alias("bound"))


def url_verdicts(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = LIMIT, doubt: float = DOUBT
) -> DataFrame:
    """page_id, host, path, rule, verdict of each page (page_id, url): the rule's verdict, else its host's."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reduce(lambda seen, r: seen if r in seen else [*seen, r], rules, [])
    ruled = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), known))
    ruled = ruled.select("page_id", "host", "path", "found.rule", "found.verdict")
    reputations = staged(host_reputations(rows, outcomes, doubt))
    total = reputations.agg(F.sum("pages")).first()[0] or 0
    verdict = F.when(F.col("bound") > limit, "block").otherwise("allow")
    facts = reputations.select("host", "pages", verdict.alias("reputation"))
    judged = with_fact(ruled.where("rule is null"), facts, "host", "pages", total)
    judged = judged.select("page_id", "host", "path", "rule", F.col("reputation").alias("verdict"))
    return ruled.where("rule is not null").unionByName(judged)
