"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (how many, how many of them bad) are counted by host, registered domain and
suffix. The share of bad pages of each is a beta-binomial: its prior has the mean of the level above
(all pages -> suffix -> domain -> host) and a strength that is estimated from the data, level by level, by the
method of moments. A host seldom or never labelled so inherits what is known of its domain, and a domain
what is known of its suffix. A host is blocked when a lower bound of its posterior share of bad pages is over
``max_bad``; the bound is Cantelli's inequality, which holds for every distribution with that mean and
variance. Rules on host and path come first; the longest that fits wins.

All work is in built-in expressions. Outcomes are summed per key before they are joined, labels and host
verdicts are attached with salted joins (a hot host is many tasks), and counts of hosts, domains and suffixes
are partial aggregates. Only one row of sums per level reaches the driver.

Defined results: host and path are empty when the url is null or has no ``://``; such pages have the empty
host, its own domain and suffix, and no labelled outcome of theirs is left out. Rows that repeat an id are
rows of their own. A null outcome counts for nothing; without any labelled page nothing is blocked but by
rule. Very long urls are read whole. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from .common import written


@dataclass(frozen=True)
class Rule:
    verdict: str                 # allow or block
    host: str                    # fits this host and its subdomains
    path: str                    # fits paths that start so

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class ReputationOptions:
    max_bad: float = 0.5         # share of bad pages over which a host is blocked
    miss: float = 0.05           # probability at most that the share is under the bound
    weakest: float = 1.0         # limits of the estimated prior strengths, in pages
    strongest: float = 1000.0
    buckets: int = 16            # salt of the joins by host and by key
    # fixed values: second-level labels that belong to the suffix under a country code
    second_level: tuple[str, ...] = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")


# fixed values: the rules of the registered query
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, ASCII_UPPER, ASCII_LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none does (equal lengths: first of the text)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def with_site(hosts: DataFrame, opts: ReputationOptions) -> DataFrame:
    """Adds ``domain`` (registered domain) and ``suffix`` to ``host``.

    User and port do not count. An address, or a host without a dot, is its own domain and suffix.
    """
    second = "|".join(opts.second_level)
    site = F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r"\.?(:[0-9]*)?\z", "")
    alone = F.col("site").rlike(r"^[0-9.]*\z|^\[|^[^.]*\z")
    last = F.regexp_extract("site", rf"(?:^|\.)((?:{second})\.[a-z]{{2}}|[^.]*)\z", 1)
    name = F.substring_index(F.expr("left(site, length(site) - length(suffix) - 1)"), ".", -1)
    return (hosts.withColumn("site", site).withColumn("suffix", F.when(alone, F.col("site")).otherwise(last))
            .withColumn("domain", F.when(F.col("suffix") == F.col("site"), F.col("site"))
                        .otherwise(F.concat(name, F.lit("."), "suffix")))
            .drop("site"))


def _strength(level: DataFrame, opts: ReputationOptions) -> float:
    """Prior strength of a level (``n, bad, prior``) by the method of moments, within the limits.

    For one group the squared error (bad - n m)^2 is expected to be n m (1 - m) (1 + (n - 1) / (s + 1)). Without
    a group of two labelled pages the groups say nothing, and the level above counts as much as it may.
    """
    spread = F.col("prior") * (1 - F.col("prior"))
    r = level.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) - F.col("n") * spread).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("most")).first()
    rho = r.over / r.most if r.most else 0.0
    rho = min(max(rho, 1 / (1 + opts.strongest)), 1 / (1 + opts.weakest))
    return 1 / rho - 1


def _counted(level: DataFrame, *cols: str) -> DataFrame:
    return level.groupBy(*cols).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _mean(strength: float):
    return (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)


def host_scores(seen: DataFrame, opts: ReputationOptions = ReputationOptions()) -> DataFrame:
    """Reputation of each host of ``seen(host, n, bad)``: labelled pages and bad ones among them.

    Returns ``host, domain, suffix, n, bad, mean, bound, blocked``: posterior mean share of bad pages, its lower
    bound, and whether that is over ``max_bad``.
    """
    hosts = written(with_site(_counted(seen, "host"), opts), "hosts")
    domains = written(_counted(hosts, "domain", "suffix"), "domains")
    suffixes = written(_counted(domains, "suffix"), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    root = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1.0)

    suffixes = suffixes.withColumn("prior", F.lit(root))
    above = suffixes.select("suffix", _mean(_strength(suffixes, opts)).alias("prior"))
    domains = salted_lookup(domains, above, ["suffix"], ["domain"], opts.buckets)
    above = domains.select("domain", "suffix", _mean(_strength(domains, opts)).alias("prior"))
    hosts = written(salted_lookup(hosts, above, ["domain", "suffix"], ["host"], opts.buckets), "host-priors")
    s = _strength(hosts, opts)
    share = F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s + 1)
    return (hosts.withColumn("mean", _mean(s))
            .withColumn("bound", F.col("mean") - F.sqrt(F.lit((1 - opts.miss) / opts.miss) * share))
            .withColumn("blocked", F.col("bound") > opts.max_bad)
            .select("host", "domain", "suffix", "n", "bad", "mean", "bound", "blocked"))


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """``row_key, page_id, host, path``; other columns stay behind, so their names cannot clash."""
    url = F.col(url_col).cast("string")
    return pages.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("page_id"),
                        url_host(url).alias("host"), url_path(url).alias("path"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, key: Column, rules: Sequence[Rule] = (),
                id_col: str = "page_id", url_col: str = "url",
                opts: ReputationOptions = ReputationOptions()) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``outcomes(outcome_key, bad)`` has one row per labelled page, ``bad`` 0, 1 or null; ``key`` computes a
    page's outcome key from its ``page_id``, ``host`` and ``path``.
    """
    rows = parsed(pages, id_col, url_col)
    known = (outcomes.where(F.col("outcome_key").isNotNull() & F.col("bad").isNotNull()).groupBy("outcome_key")
             .agg(F.count("bad").alias("n"), F.sum("bad").cast("bigint").alias("bad")))
    # pages of one host and key count as one row with a weight, so neither a hot key nor a hot host travels as such
    met = rows.groupBy("host", key.alias("outcome_key")).agg(F.count(F.lit(1)).alias("pages"))
    met = salted_lookup(met, known, ["outcome_key"], ["host"], opts.buckets, "left")
    weight = lambda c: (F.col("pages") * F.coalesce(c, F.lit(0))).alias(c)
    scores = host_scores(met.select("host", weight("n"), weight("bad")), opts)
    bad_hosts = scores.where("blocked").select("host", F.lit("block").alias("by_host"))
    judged = salted_lookup(rows, bad_hosts, ["host"], ["row_key"], opts.buckets, "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return judged.withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "by_host", F.lit("allow")).alias("verdict"))
