"""URL filters as a sort-merge range join (DataFrame functions only).

A host's labels in reverse order followed by the path make a canonical key, in which
``www.example.com/en/7`` is ``com.example.www/en/7``. A rule's key is the prefix of
the keys it fits, so it stands for the interval of all strings with that prefix, and
such intervals are nested or apart. A rule fits its host and all subdomains, so a URL
is looked up once for each of its host's suffixes (``com.example.www``, ``com.example``
and ``com``, each with the path).

The sweep: rules and distinct URL keys are sorted together by range partitioning and a
sort inside each partition. A rule carries the stack of the rules around it; a key
takes the stack of the last rule before it, and pops the rules whose interval ended by
testing which of them are still a prefix. The last rule of the earlier partitions is
carried into the next ones by a table of one row per partition.

The longest rule (characters of host and path) wins; of equally long ones the one with
the longer host, then block.

Cases: a null URL or one without ``://`` has empty host and path and meets no rule;
equal URLs are looked up once; an empty table gives an empty result; only ``page_id``
and ``url`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tyscope.session import materialize

LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), LOWER_FROM, LOWER_TO)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) triples as a rule DataFrame."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def stacked_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules by key, each with the keys of the rules around it and its own,
    outermost first. A rule's surroundings are found by looking up its own prefixes."""
    keyed = (rules.select(F.concat(reversed_host(F.translate("host", LOWER_FROM, LOWER_TO)), "path").alias("key"),
                          F.concat(F.translate("host", LOWER_FROM, LOWER_TO), "path").alias("rule"),
                          F.length("host").alias("host_len"), "action")
             .groupBy("key").agg(F.max(F.struct(F.col("action") == "block", "action", "rule", "host_len")).alias("r"))
             .select("key", F.struct(F.col("key").alias("key"), F.col("r.rule").alias("rule"),
                                     F.col("r.host_len").alias("host_len"), F.col("r.action").alias("action")).alias("r")))
    prefixes = keyed.select(F.col("key").alias("inner"),
                            F.explode(F.transform(F.sequence(F.lit(1), F.length("key")),
                                                  lambda i: F.substring("key", F.lit(1), i))).alias("key"))
    stacks = prefixes.join(keyed, "key").groupBy("inner").agg(F.collect_list("r").alias("stack"))
    return stacks.select(F.col("inner").alias("key"),
                         F.array_sort("stack", lambda a, b: F.length(a["key"]) - F.length(b["key"])).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split("host", r"\.", -1))
    points = (urls.where(F.col("host") != "").select("host", "path").distinct()
              .select("host", "path", F.explode(F.transform(
                  F.sequence(F.lit(1), F.size(labels)),
                  lambda j: F.concat(F.array_join(F.slice(labels, F.lit(1), j), "."), F.col("path")))).alias("key")))
    stacked = stacked_rules(rules)
    events = (stacked.select("key", "stack", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(0).alias("is_url"))
              .unionByName(points.select("key", F.lit(None).cast(stacked.schema["stack"].dataType).alias("stack"),
                                         "host", "path", F.lit(1).alias("is_url"))))
    # written once, so that both reads below see the same partition bounds
    swept = materialize(events.repartitionByRange(n, "key", "is_url").withColumn("part", F.spark_partition_id()),
                        "url-sweep")
    last = (swept.where(F.col("is_url") == 0).groupBy("part").agg(F.max_by("stack", "key").alias("own")))
    every = swept.select("part").distinct().join(last, "part", "left")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = every.select("part", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    found = (swept.withColumn("seen", F.last("stack", ignorenulls=True).over(sweep))
             .where(F.col("is_url") == 1).join(F.broadcast(carried), "part")
             .withColumn("active", F.filter(F.coalesce("seen", "carried"),
                                            lambda r: F.startswith(F.col("key"), r["key"])))
             .where(F.size("active") > 0)
             .withColumn("top", F.element_at("active", -1)))
    best = (found.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("top.rule").alias("len"), F.col("top.host_len").alias("host_len"),
                                (F.col("top.action") == "block").alias("block"), F.col("top.rule").alias("rule"),
                                F.col("top.action").alias("action"))).alias("best")))
    return (urls.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.action", F.lit(default)).alias("verdict")))
