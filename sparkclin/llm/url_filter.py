"""URL filter: nested host rules found by a sorted sweep over reversed-host keys (DataFrame functions only).

``net.example.blog.`` is the key of host ``blog.example.net``. A rule for a host and its subdomains is then
the key interval from ``net.example.`` to ``net.example.`` + 0xFF, and intervals either nest or are disjoint.
Sorting interval bounds together with the keys of hosts and sweeping over them, the rules that hold for a host
are those on the stack at its place. The stack after each bound depends on the rules alone, so the sweep is a
window that carries the last bound's stack forward.

Scale: only distinct hosts are swept (a map-side combined ``distinct``, so a hot host is one row), spread
evenly over ``salts`` partitions, each with its own copy of the bounds; the rule table is the curated side
and costs rules x salts rows. The join back to the urls is an equi-join on the host that adaptive execution
can split where a host is hot, or broadcast when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values: (host, path, verdict)
DEFAULT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a DataFrame (host, path, verdict)."""
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    structs = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
               for h, p, v in rules]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(authority, _UPPER, _UPPER.lower()), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\.", -1))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(".")).cast("binary")


def _bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): interval bounds in key space and the rules that hold from there on."""
    entry = F.struct(F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("host_len"),
                     F.concat("host", "path").alias("rule"), F.col("verdict"), F.col("path"))
    by_host = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
               .groupBy("host").agg(F.collect_set(entry).alias("own"))
               .select("host", "own", _labels(F.col("host")).alias("labels")))
    above = (by_host.select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
             .select("host", "labels", _key(F.slice("labels", F.lit(1), F.col("n"))).alias("above"),
                     (F.col("n") == F.size("labels")).alias("self")))
    stacks = (above.join(by_host.select(_key(F.col("labels")).alias("above"), "own"), "above")
              .groupBy("host", "labels")
              .agg(F.flatten(F.collect_list("own")).alias("opened"),
                   F.flatten(F.collect_list(F.when(~F.col("self"), F.col("own")))).alias("closed")))
    start = stacks.select(_key(F.col("labels")).alias("key"), F.col("opened").alias("stack"))
    end = stacks.select(F.concat(_key(F.col("labels")), F.expr("X'FF'")).alias("key"), F.col("closed").alias("stack"))
    return start.unionByName(end)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", salts: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path
    starts with the rule's path. The longest rule text wins (ties: the longer host, then the greater text,
    then ``block``). Without a fitting rule ``rule`` is null and ``verdict`` is ``default``. A null url or one
    without ``://`` has an empty host and path. Repeated rows are judged alike and all returned; an empty table
    or rule table gives no rows / no rules; other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("__url"))
    urls = (pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("__url"))
            .select("__id", host.alias("host"), path.alias("path")))
    hosts = urls.select("host").distinct().select(
        "host", _key(_labels(F.col("host"))).alias("key"),
        F.pmod(F.xxhash64("host"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"))
    bounds = _bounds(rules).select("key", "stack", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                                   F.lit(0).alias("kind"))
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = (hosts.unionByName(bounds, allowMissingColumns=True)
              .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
              .where("kind = 1").select("host", "stack"))
    best = F.array_max(F.transform(
        F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])),
        lambda r: F.struct(r["len"], r["host_len"], r["rule"], r["verdict"])))
    return (urls.join(active, "host", "left").withColumn("__best", best)
            .select(F.col("__id").alias(id_col), "host", "path", F.col("__best.rule").alias("rule"),
                    F.coalesce("__best.verdict", F.lit(default)).alias("verdict")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark, DEFAULT_RULES))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM (SELECT DISTINCT host, path FROM h) JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, h.host, h.path, rule, coalesce(rverdict, 'allow') AS verdict
FROM h LEFT JOIN fits ON h.host = fits.host AND h.path = fits.path
"""
