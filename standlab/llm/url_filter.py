"""URL filter: rules by host and path, and an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host.  Each level of suffix, registered domain and host
is shrunk towards the level above: its good pages are beta-binomial around the posterior mean of
its parent, with a concentration that the level's own spread tells (moments of the counts), so
levels whose members differ little are pulled together strongly.  A host without labels has
its domain's posterior.  A url passes if the lower bound of its host's posterior, mean minus ``z``
standard deviations, reaches ``least``.  Rules go first: a rule fits its host and all subdomains
where the path starts with the rule's; the longest rule wins.

The suffix is a host's last label and the registered domain its last two, after any user and
port are cut; a host of one label is its own domain.  Only DataFrame functions are used.  Hosts
are pre-aggregated in every task, and only the join back to the pages meets a hot host,
which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import table
from standlab.session import cut_lineage, literal_table

# fixed values: host, path and verdict of the rules
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, Z = 0.5, 1.645
STRENGTH = (1.0, 10000.0)  # concentrations are held within these


def host_of(url):
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host):
    """Last two labels of a host, without user and port."""
    return F.substring_index(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), ".", -2)


def outcomes(labels: DataFrame) -> DataFrame:
    """One outcome a page: good if no row of it says low quality or toxic."""
    return (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg((F.min("quality") == 1).alias("fine"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
            .select(F.col("doc_id").alias("label_id"), (F.col("fine") & (F.col("toxic") == 0)).cast("long").alias("good")))


def _concentration(children: DataFrame) -> DataFrame:
    """One row: the concentration of children (k good of n) around their parents' means p."""
    spread = F.pow(F.col("k") - F.col("n") * F.col("p"), 2) - F.col("n") * F.col("p") * (1 - F.col("p"))
    room = F.col("n") * (F.col("n") - 1) * F.col("p") * (1 - F.col("p"))
    rho = F.sum(spread) / F.nullif(F.sum(room), F.lit(0.0))
    return children.agg(F.when(rho > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), 1 / rho - 1)))
                        .otherwise(F.lit(STRENGTH[1])).alias("m"))


def reputation(counts: DataFrame) -> DataFrame:
    """host and the posterior (mean, lower bound inputs a and b) from host, k and n of all hosts."""
    hosts = counts.withColumn("domain", domain_of(F.col("host"))).withColumn(
        "suffix", F.substring_index("domain", ".", -1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = suffixes.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = suffixes.select("suffix", F.lit(((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)).alias("p"))

    def shrunk(children, parents, key):
        joined = children.join(parents, key)
        m = _concentration(joined).first()["m"]
        return joined.withColumn("a", F.col("k") + m * F.col("p")).withColumn(
            "b", F.col("n") - F.col("k") + m * (1 - F.col("p")))

    def mean(level, key):
        return level.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("p"))

    by_suffix = shrunk(suffixes, overall, "suffix")
    by_domain = shrunk(domains, mean(by_suffix, "suffix"), "suffix")
    return shrunk(hosts.drop("suffix"), mean(by_domain, "domain"), "domain").select("host", "a", "b")


def _rules(spark, rules) -> DataFrame:
    return literal_table(spark, [(h, p, h + p, v) for h, p, v in rules],
                         "rule_host string, rule_path string, rule string, rule_verdict string")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least: float = LEAST, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    Outcomes come from ``labels`` whose doc_id is the page_id.  A null url, or one without ``://``,
    has an empty host and path and is judged as any host.  A row without page_id has no outcome.
    Pages that repeat an id share its outcome.  Without labels the mean is one half.  Equally long
    rules go by their text.  Other columns are not used.
    """
    spark = pages.sparkSession
    # the expressions are cut in two projects so that each regular expression runs once a url
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counts = cut_lineage(urls.join(outcomes(labels), F.col("page_id") == F.col("label_id"), "left").groupBy("host")
              .agg(F.coalesce(F.sum("good"), F.lit(0)).alias("k"), F.count("good").alias("n")))
    labels_of = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels_of)), lambda i: F.array_join(
        F.slice(labels_of, i, F.size(labels_of) - i + 1), "."))
    fitting = (counts.select("host", F.explode(parents).alias("rule_host"))
               .join(_rules(spark, rules), "rule_host").groupBy("host")
               .agg(F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "rule_path", "rule_verdict")).alias("rules")))
    centre = F.col("a") / (F.col("a") + F.col("b"))
    bound = centre - z * F.sqrt(centre * (1 - centre) / (F.col("a") + F.col("b") + 1))
    known = (reputation(counts).select("host", F.when(bound >= least, "allow").otherwise("block").alias("method"))
             .join(fitting, "host", "left"))
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    return (urls.join(known, "host").withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.rule_verdict", "method").alias("verdict")))


@register("op5_url_filter", sql=r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT doc_id, CASE WHEN min(quality) = 1 AND max(coalesce(toxic, 0)) = 0 THEN 1 ELSE 0 END AS good FROM labels
      WHERE quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, coalesce(sum(good), 0)::DOUBLE AS k, count(good)::DOUBLE AS n FROM u LEFT JOIN l ON doc_id = page_id GROUP BY host),
h AS (SELECT host, k, n, regexp_extract(regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', ''), '([^.]*\.)?[^.]*$') AS domain FROM c),
d AS (SELECT domain, regexp_extract(domain, '[^.]*$') AS suffix, sum(k) AS k, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM d GROUP BY ALL),
s1 AS (SELECT s.*, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) AS p FROM s),
sm AS (SELECT sum((k - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0) AS r FROM s1),
s2 AS (SELECT suffix, k, n, p, CASE WHEN r > 0 THEN greatest(1, least(10000, 1 / r - 1)) ELSE 10000 END AS m FROM s1, sm),
d1 AS (SELECT domain, d.k, d.n, (s2.k + m * p) / (s2.n + m) AS p FROM d JOIN s2 ON s2.suffix = d.suffix),
dm AS (SELECT sum((k - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0) AS r FROM d1),
d2 AS (SELECT domain, k, n, p, CASE WHEN r > 0 THEN greatest(1, least(10000, 1 / r - 1)) ELSE 10000 END AS m FROM d1, dm),
h1 AS (SELECT host, h.k, h.n, (d2.k + m * p) / (d2.n + m) AS p FROM h JOIN d2 ON d2.domain = h.domain),
hm AS (SELECT sum((k - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0) AS r FROM h1),
h2 AS (SELECT host, k, n, p, CASE WHEN r > 0 THEN greatest(1, least(10000, 1 / r - 1)) ELSE 10000 END AS m FROM h1, hm),
v AS (SELECT host, (k + m * p) / (n + m) AS c, n + m AS w FROM h2),
w AS (SELECT u.page_id, u.host, u.path, CASE WHEN c - 1.645 * sqrt(c * (1 - c) / (w + 1)) >= 0.5 THEN 'allow' ELSE 'block' END AS method,
      CASE WHEN (u.host = 'example.net' OR u.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (u.host = 'org' OR u.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (u.host = 'net' OR u.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM u JOIN v ON v.host = u.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       ELSE method END AS verdict FROM w
""")
def op5_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
