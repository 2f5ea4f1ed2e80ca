"""URL rules and empirical-Bayes host reputation, in DataFrame operations only.

A url is judged by the longest rule that fits it. Where none fits, the reputation of its
host decides: labelled page outcomes are shrunk through beta-binomial priors from suffix
to registered domain to host, and a host is blocked when the posterior bound of its rate
of good pages lies below a threshold.

A host's registered domain is its public suffix and one label more. Public suffixes of two labels are a parameter; by
default they are the labels of SECOND before a two-letter country code, which is how most registries sell names below a
country. Pass the expression of a public suffix list for others.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged
by the prior of all hosts. Repeated pages are judged alike and each is returned. An empty
table gives an empty result; without any labelled outcome the prior mean is 1/2 with the
weakest concentration. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, lower_ascii, materialize


#: Second labels below country codes: short ones that registries use, and longer ones that schools, offices and companies have.
SECOND = "ac|co|com|edu|gob|gouv|gov|go|govt|gv|id|ltd|ne|net|nhs|nom|or|org|plc|sch|school"
SUFFIXES = rf"^(?:{SECOND})\.[a-z]{{2}}$"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and what the path starts with (``net/es/``)."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class Reputation:
    """bound: standard deviations below the posterior mean; least_rate: rate of good pages that the bound must reach;
    concentrations: limits of the prior's weight in pages; suffixes: public suffixes of two labels as a regular expression."""

    bound: float = 2.0
    least_rate: float = 0.5
    concentrations: tuple[float, float] = (1.0, 1000.0)
    suffixes: str = SUFFIXES


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    has = F.coalesce(url, F.lit("")).contains("://")
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls. Rules are a list held by the driver."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def registered_domain(host: Column, suffixes: str) -> tuple[Column, Column]:
    """Registered domain (suffix and one label more, or the host) and suffix."""
    two = F.substring_index(host, ".", -2)
    long = two.rlike(suffixes)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def _concentration(groups: DataFrame, p: Reputation, name: str) -> DataFrame:
    """One row: the weight of a beta prior for the groups' rates, from factorial moments.

    All sums are of whole numbers, so the result doesn't depend on the order of rows.
    """
    low, high = p.concentrations
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    m1 = d("k") / d("n")
    m2 = d("kk") / d("nn")
    sums = groups.agg(F.sum("good").alias("k"), F.sum("seen").alias("n"), F.sum(F.expr("good * (good - 1)")).alias("kk"), F.sum(F.expr("seen * (seen - 1)")).alias("nn"))
    known = (d("n") > 0) & (d("nn") > 0)
    spread, excess = m1 - m2, m2 - m1 * m1
    weight = F.when(~known, low).when(excess <= 0, high).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), spread / excess)))
    return sums.select(weight.alias(name), F.when(d("n") > 0, m1).otherwise(F.lit(0.5)).alias(f"{name}_mean"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, p: Reputation) -> DataFrame:
    """Posterior of each host of ``hosts`` (host); ``outcomes`` (host, good 0 or 1) are the labelled pages.

    Hosts with outcomes count for their domain and suffix whether or not they are in ``hosts``. A level's
    own pages are left out of the level above before that serves as its prior, so that no page counts twice.
    Counts by host are written once; all that follows reads that table.
    """
    asked = hosts.select("host", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("seen"), F.lit(1).alias("asked"))
    known = outcomes.select("host", F.col("good").cast("long"), F.when(F.col("good").isNotNull(), 1).otherwise(0).cast("long").alias("seen"), F.lit(0).alias("asked"))
    domain, suffix = registered_domain(F.col("host"), p.suffixes)
    at_host = asked.unionByName(known).groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.sum("seen").alias("seen"), F.max("asked").alias("asked"))
    at_host = materialize(at_host.select("host", domain.alias("domain"), suffix.alias("suffix"), "good", "seen", "asked"), "hosts")
    at_domain = materialize(at_host.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")), "domains")
    at_suffix = at_domain.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen"))
    # three frames of one row each
    weights = _concentration(at_host, p, "k_host").crossJoin(F.broadcast(_concentration(at_domain, p, "k_domain"))).crossJoin(F.broadcast(_concentration(at_suffix, p, "k_suffix")))
    s = at_suffix.select("suffix", F.col("good").alias("s_good"), F.col("seen").alias("s_seen"))
    d = keyed_join(at_domain.select("domain", "suffix", F.col("good").alias("d_good"), F.col("seen").alias("d_seen")), s, ["suffix"]).drop("suffix")
    x = keyed_join(at_host.where("asked = 1"), d, ["domain"]).join(F.broadcast(weights))
    top = (F.expr("s_good - d_good") + F.expr("k_suffix * k_suffix_mean")) / (F.expr("s_seen - d_seen") + F.col("k_suffix"))
    x = x.withColumn("_top", top).withColumn("_mid", (F.expr("d_good - good") + F.expr("k_domain * _top")) / (F.expr("d_seen - seen") + F.col("k_domain")))
    x = x.withColumn("_a", F.expr("good + k_host * _mid")).withColumn("_n", F.expr("seen + k_host"))
    x = x.withColumn("rate", F.expr("_a / _n")).withColumn("lower", F.expr(f"rate - {p.bound}D * sqrt(rate * (1D - rate) / (_n + 1D))"))
    return x.select("host", "good", "seen", "rate", "lower")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], p: Reputation | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (key, host, path, rule, verdict, rate, lower) for every row of ``pages``."""
    p = p or Reputation()
    host, path = url_parts(F.col(url))
    parts = materialize(pages.select(F.col(key), host.alias("host"), path.alias("path")), "urls")
    scores = host_reputation(outcomes, parts.select("host").distinct(), p).select("host", "rate", "lower")
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = keyed_join(parts, scores, ["host"], "left")
    by_host = F.when(F.col("lower") >= p.least_rate, "allow").otherwise("block")
    return judged.select(key, "host", "path", text.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "rate", "lower")


#: The rules of the registered query.
RULES = [Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block"), Rule("net/fr/", "block")]


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes (host, good): a page's url ends in the number of the document it shows, whose quality label is its outcome."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    host, path = url_parts(F.col("url"))
    shown = pages.select(host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html|/)?$", 1).alias("_no")).where("_no <> ''")
    return shown.select("host", F.col("_no").cast("long").alias("doc_id")).join(labels, "doc_id").select("host", "good")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labelled_pages(spark, sf_dir), RULES)


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), marks AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
shown AS (SELECT host, TRY_CAST(NULLIF(regexp_extract(path, '/([0-9]{1,18})(?:\.html|/)?$', 1), '') AS BIGINT) AS doc_id FROM parts),
counts AS (SELECT host, sum(good) AS good, count(*) AS seen FROM shown JOIN marks USING (doc_id) GROUP BY 1),
hosts AS (SELECT host, list_reverse(string_split(host, '.')) AS l FROM (SELECT host FROM parts UNION SELECT host FROM counts)),
named AS (SELECT host, CASE WHEN len(l) >= 2 THEN l[2] || '.' || l[1] ELSE l[1] END AS two, l FROM hosts),
split AS (
  SELECT host, CASE WHEN regexp_matches(two, '^(ac|co|com|edu|gob|gouv|gov|go|govt|gv|id|ltd|ne|net|nhs|nom|or|org|plc|sch|school)\.[a-z]{2}$') AND len(l) >= 3 THEN l[3] || '.' || two ELSE two END AS domain,
         CASE WHEN regexp_matches(two, '^(ac|co|com|edu|gob|gouv|gov|go|govt|gv|id|ltd|ne|net|nhs|nom|or|org|plc|sch|school)\.[a-z]{2}$') THEN two ELSE l[1] END AS suffix FROM named
), h AS (SELECT host, domain, suffix, coalesce(good, 0)::BIGINT AS good, coalesce(seen, 0)::BIGINT AS seen FROM split LEFT JOIN counts USING (host)),
d AS (SELECT domain, suffix, sum(good)::BIGINT AS good, sum(seen)::BIGINT AS seen FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(good)::BIGINT AS good, sum(seen)::BIGINT AS seen FROM d GROUP BY 1),
sums AS (
  SELECT 'h' AS lvl, sum(good)::DOUBLE AS k, sum(seen)::DOUBLE AS n, sum(good * (good - 1))::DOUBLE AS kk, sum(seen * (seen - 1))::DOUBLE AS nn FROM h
  UNION ALL SELECT 'd', sum(good), sum(seen), sum(good * (good - 1)), sum(seen * (seen - 1)) FROM d
  UNION ALL SELECT 's', sum(good), sum(seen), sum(good * (good - 1)), sum(seen * (seen - 1)) FROM s
), w AS (
  SELECT lvl, CASE WHEN n > 0 THEN k / n ELSE 0.5 END AS m1,
         CASE WHEN NOT (n > 0 AND nn > 0) THEN 1.0 WHEN kk / nn - (k / n) * (k / n) <= 0 THEN 1000.0
              ELSE greatest(1.0, least(1000.0, (k / n - kk / nn) / (kk / nn - (k / n) * (k / n)))) END::DOUBLE AS c FROM sums
), x AS (
  SELECT h.host, h.good, h.seen, d.good AS d_good, d.seen AS d_seen,
         ((s.good - d.good) + ws.c * ws.m1) / ((s.seen - d.seen) + ws.c) AS top, wd.c AS c_d, wh.c AS c_h
  FROM h JOIN d USING (domain) JOIN s ON s.suffix = h.suffix
  JOIN w ws ON ws.lvl = 's' JOIN w wd ON wd.lvl = 'd' JOIN w wh ON wh.lvl = 'h'
), y AS (SELECT host, good, seen, c_h, ((d_good - good) + c_d * top) / ((d_seen - seen) + c_d) AS mid FROM x),
z AS (SELECT host, (good + c_h * mid) / (seen + c_h) AS rate, seen + c_h AS n FROM y),
b AS (SELECT host, rate, rate - 2.0::DOUBLE * sqrt(rate * (1 - rate) / (n + 1)) AS lower FROM z),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts
)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN lower >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, rate, lower
FROM ruled r LEFT JOIN b ON b.host = r.host
"""
