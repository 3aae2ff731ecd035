"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .host_reputation import RULES, ReputationOptions, judge_pages
from .queries import query


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """``outcome_key, bad``: a labelled document is bad when it is toxic or of low quality."""
    bad = F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int"))
    return labels.select(F.col("doc_id").cast("bigint").alias("outcome_key"), bad.alias("bad"))


def document_of_page():
    """The document a page shows: the number at the head of its path's last part."""
    return F.regexp_extract("path", r"(?s)/([0-9]++)[^/]*+/?\z", 1).try_cast("bigint")


def _reputation_sql(o: ReputationOptions = ReputationOptions()) -> str:
    second = "|".join(o.second_level)
    low, high = 1 / (1 + o.strongest), 1 / (1 + o.weakest)

    def strength(level: str) -> str:
        return f"""(SELECT 1 / least(greatest(coalesce(
            sum(power(bad - n * prior, 2) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0),
            0), {low!r}), {high!r}) - 1 AS s FROM {level} WHERE n > 0)"""

    return f"""
    WITH p AS (SELECT page_id,
                      coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    l AS (SELECT doc_id, greatest(toxic, 1 - quality) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL),
    h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
                  regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\\.?(:[0-9]*)?\\z', '') AS site
           FROM p LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(path, '(?s)/([0-9]+)[^/]*/?\\z', 1) AS BIGINT)
           GROUP BY host),
    h1 AS (SELECT *, CASE WHEN regexp_matches(site, '^[0-9.]*\\z|^\\[|^[^.]*\\z') THEN site
                     ELSE regexp_extract(site, '(?:^|\\.)((?:{second})\\.[a-z]{{2}}|[^.]*)\\z', 1) END AS suffix FROM h0),
    h AS (SELECT *, CASE WHEN suffix = site THEN site
                    ELSE regexp_extract(left(site, length(site) - length(suffix) - 1), '[^.]*\\z') || '.' || suffix END AS domain
          FROM h1),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
    s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
    s2 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM s) AS prior FROM s),
    s3 AS (SELECT suffix, (bad + x.s * prior) / (n + x.s) AS prior FROM s2, {strength("s2")} x),
    d2 AS (SELECT d.*, prior FROM d JOIN s3 USING (suffix)),
    d3 AS (SELECT domain, suffix, (bad + x.s * prior) / (n + x.s) AS prior FROM d2, {strength("d2")} x),
    h2 AS (SELECT h.*, prior FROM h JOIN d3 USING (domain, suffix)),
    h3 AS (SELECT host, n + x.s AS weight, (bad + x.s * prior) / (n + x.s) AS mean FROM h2, {strength("h2")} x),
    b AS (SELECT host, mean - sqrt({(1 - o.miss) / o.miss!r} * mean * (1 - mean) / (weight + 1)) > {o.max_bad} AS bad FROM h3),
    r AS (SELECT p.*, b.bad,
                 CASE WHEN ('.' || p.host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                      WHEN ('.' || p.host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                      WHEN ('.' || p.host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                      WHEN ('.' || p.host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
          FROM p JOIN b ON b.host = p.host)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bad THEN 'block'
                ELSE 'allow' END AS verdict
    FROM r
    """


@query("op12_host_reputation", sql=_reputation_sql())
def op12_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return judge_pages(_read(spark, sf_dir, "pages"), page_outcomes(_read(spark, sf_dir, "labels")),
                       document_of_page(), RULES)
