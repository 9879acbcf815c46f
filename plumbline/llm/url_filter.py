"""URL rules by expansion: each URL becomes expressions of host suffix and path prefix, which meet the rules in an equi-join on
short hash prefixes; full digests confirm, then the longest rule decides.

Only suffixes with as many labels and prefixes as long as some rule has are made, so the expansion is bounded by the rules, not by
the URL. URLs are judged once per distinct host and path, which also gathers hot hosts before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a digest that the join compares.
PREFIX = 4
#: Rules up to this many are sent to all executors; more are joined by shuffle.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """The verdict on each url.

    pages: page_id, url. rules: host, path, verdict; a rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest fitting rule (host, then path) wins, among equal rules with both verdicts block. Without a fitting rule:
    default. Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ? or #. A null url, or one
    without ://, has neither and fits no rule.

    Returns page_id, host, path, rule (host and path as one string, or null), verdict; a row for each row of pages, repeats and
    null page_ids included. An empty table gives no row; without rules all get the default. Other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules or [], "host string, path string, verdict string")
    expression = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    rules = rules.groupBy("host", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("v"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "v", expression(F.col("host"), F.col("path")).alias("digest")).withColumn("short", F.substring("digest", 1, 2 * PREFIX))
    labels = F.size(F.split("rule_host", r"\."))
    shape = rules.agg(F.count(F.lit(1)), F.array_sort(F.collect_set(labels)), F.array_sort(F.collect_set(F.length("rule_path")))).first()
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    if not shape[0]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*map(F.lit, shape[1])), lambda n: n <= F.size(parts)), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, shape[2])), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = rows.where("host <> ''").select("host", "path").distinct()
    expanded = expanded.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes)).withColumn("own", expression(F.col("h"), F.col("p"))).withColumn("short", F.substring("own", 1, 2 * PREFIX))
    if shape[0] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    fits = expanded.join(rules, "short").where("own = digest")
    longest = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule_host").alias("a"), F.length("rule_path").alias("b"), "rule_host", "rule_path", "v")).alias("best"))
    best = longest.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.v").alias("v"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: The rule of the query, as SQL over each row.
SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parted AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules(rule_host, rule_path, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), urls AS (SELECT DISTINCT host, path FROM parted),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parted p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.place = 1
"""
