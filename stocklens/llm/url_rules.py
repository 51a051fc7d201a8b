"""URL filter: host-and-path rules joined to urls as nested key intervals by a sorted sweep.

A rule (host, path) becomes the interval of binary keys that start with its path, inside the reversed canonical form of its
host. Rules of one host nest or are disjoint, so a stack tells which one is innermost at any key. The sweep keeps that stack
as one register for each depth: windows over the rule boundaries give every boundary the rule that is on top after it, and
a window over boundaries and urls in key order hands each url the last boundary before it.

Each url is probed once for every suffix of its host that carries a rule. Groups of a busy host are split by a salt, and its
boundaries, which are few beside the urls, are repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
BROADCAST_HOSTS = 100_000


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both are empty where url is null or has no '://'."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumn("host", ascii_lower(host)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1))


def reversed_host(labels):
    return F.array_join(F.reverse(labels), ".")


def rule_boundaries(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) -> (rev, key, rank, top): the rule on top of the stack from key on; top.rule is null where none is.

    Equal (host, path) pairs count once; block beats allow. Rules with a null host or path are ignored.
    """
    clean = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    clean = clean.select(reversed_host(F.split("host", r"\.")).alias("rev"), F.concat("host", "path").alias("rule"), "path", "verdict")
    start = clean.select("rev", F.col("path").cast("binary").alias("key"), F.lit(1).alias("step"), F.struct("rule", "verdict").alias("opened"))
    close = clean.select("rev", F.concat(F.col("path").cast("binary"), F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(start.schema["opened"].dataType).alias("opened"))
    # Several intervals may close at one key only if their paths are equal, which the grouping has ruled out.
    order = Window.partitionBy("rev").orderBy("key", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = start.unionByName(close).withColumn("depth", F.sum("step").over(order))
    register = Window.partitionBy("rev", "depth").orderBy("key", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.when(F.col("depth") > 0, F.last("opened", ignorenulls=True).over(register))
    return events.select("rev", "key", F.lit(0).alias("rank"), F.struct(top["rule"].alias("rule"), top["verdict"].alias("verdict")).alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, default_verdict: str = "allow", rows_per_group: int = 20_000) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A rule fits its host and every subdomain if the url's path starts with the rule's path; the longest rule text wins, then
    the longer host. Null page_id and url are kept (empty host and path, no rule, the default verdict); equal rows are
    counted before the shuffle and given back at the end. Extra columns of either input are ignored.
    """
    boundaries = rule_boundaries(rules)
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("most")).first()["most"]
    urls = with_host_and_path(pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies")))
    labels = F.split("host", r"\.")
    levels = urls.withColumn("labels", labels).withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(deepest, 1))))))
    probes = levels.withColumn("rev", reversed_host(F.expr("slice(labels, size(labels) - level + 1, level)"))).drop("labels", "level")
    held = boundaries.groupBy("rev").agg(F.count(F.lit(1)).alias("n_rules"))
    # Rule hosts go to every task while they are few; beyond that the joins shuffle and Spark splits skewed partitions.
    few = F.broadcast if held.count() <= BROADCAST_HOSTS else lambda df: df
    probes = probes.join(few(held.select("rev")), "rev", "left_semi")
    busy = probes.groupBy("rev").agg(F.count(F.lit(1)).alias("n_urls")).join(held, "rev")
    salts = few(busy.select("rev", F.ceil(F.col("n_urls") / F.greatest(F.lit(rows_per_group), 4 * F.col("n_rules"))).cast("int").alias("salts")))
    probes = probes.join(salts, "rev").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("salts")).cast("int")).drop("salts")
    probes = probes.select("rev", "salt", F.col("path").cast("binary").alias("key"), F.lit(1).alias("rank"), "page_id", "url")
    spread = boundaries.join(salts, "rev").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    sweep = Window.partitionBy("rev", "salt").orderBy("key", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = spread.unionByName(probes, allowMissingColumns=True).withColumn("hit", F.last("top", ignorenulls=True).over(sweep))
    hits = swept.where("rank = 1 and hit.rule is not null")
    best = hits.groupBy("page_id", "url").agg(F.max(F.struct(F.length("hit.rule").alias("size"), F.length("rev").alias("host_size"), F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))).alias("best"))
    best = best.withColumnsRenamed({"page_id": "p", "url": "u"})
    judged = urls.join(best, urls["page_id"].eqNullSafe(best["p"]) & urls["url"].eqNullSafe(best["u"]), "left")
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default_verdict)).alias("verdict"))


def op8_url_rules(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


SQL = """
with parts as (
  select page_id, case when url is not null and instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select row_number() over () as row_no, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from parts),
rules(rhost, rpath, rverdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select row_no, rhost || rpath as rule, rverdict from split, rules
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
best as (
  select row_no, rule, rverdict from fits qualify row_number() over (partition by row_no order by length(rule) desc) = 1)
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from split left join best using (row_no)
"""
