"""URL filter: host-suffix and path-prefix expressions against a rule list, by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8  # hex digits of the short hash that expressions and rules are joined on
#: The production rules (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def folder_of(path: Column) -> Column:
    """The path up to and with its last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_folders(path: Column) -> Column:
    """Every prefix of the path that ends in a slash, and the empty one."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """`urls` (with `url`) plus host, path, rule and verdict.

    A rule (action, host, path) fits its host and all subdomains if the url's path starts with the
    rule's. The longest rule wins, then `block`, then the first by text; without a rule the verdict is
    `default`. Distinct (host, path) pairs are expanded once into host suffixes times path folders; a rule
    is keyed by its path's folder, joined on the first digits of SHA-256 and confirmed by full digest and path.
    Null or empty urls have an empty host and path; repeated rows each come back; null rules are ignored.
    """
    parsed = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    listed = rules.where("host is not null and path is not null and action is not null").select(
        "action", F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"),
        F.sha2(F.concat("host", F.lit("\n"), folder_of(F.col("path"))), 256).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, PREFIX_HEX)).distinct()
    places = parsed.select("host", "path").where("host <> ''").distinct()
    expressions = places.select(
        "host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix")
    ).select("host", "path", "suffix", F.explode(path_folders(F.col("path"))).alias("folder"))
    keyed = expressions.select("host", "path", F.sha2(F.concat("suffix", F.lit("\n"), "folder"), 256).alias("full")).withColumn(
        "short", F.substring("full", 1, PREFIX_HEX)
    )
    hits = keyed.join(listed, "short").where("full = digest and startswith(path, rule_path)")
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("shortness"), (F.col("action") != "block").alias("allows"), F.col("rule"), F.col("action"))).alias("best")
    ).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    return parsed.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(
        *parsed.columns, "rule", "verdict"
    )
