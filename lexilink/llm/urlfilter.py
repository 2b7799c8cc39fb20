"""URL filters by host-suffix and path-prefix expressions.

A rule is (action, host, path). Each URL is expanded into the expressions host suffix + path prefix
that a rule could have: the suffixes of its host at label borders with at most as many labels as a rule has, and the prefixes of its path in the lengths that
occur among the rules (the number of both is bounded by the rules, not by the data). Expressions meet rules in an
equi-join on a 32-bit prefix; an equal SHA-256 digest of the whole expression confirms. Of the confirmed rules the
longest wins; ties go to the longer host, then to `block`.

Rules are broadcast only while there are at most `broadcast_rules` of them; beyond that the join shuffles
the expressions by their short prefix.

Edge cases: a null URL or one without `://` has empty host and path and gets the default verdict. Repeated
rows each get their own verdict. Tables without rows give tables without rows. Columns of the input that are not
`id_col` or `url_col` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilink.llm.common import UPPER

#: The contract's rules as (action, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def compile_rules(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Rules with short prefix, full digest and rank order; repeated expressions keep the blocking one."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "action string, host string, path string")
    expression = F.concat("host", "path")
    return (
        df.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))
        .select(
            F.crc32(expression.cast("binary")).alias("short"),
            F.sha2(expression, 256).alias("digest"),
            expression.alias("rule"),
            "action",
            F.length("path").alias("path_length"),
            F.length("host").alias("host_length"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
        )
    )


def expressions(urls: DataFrame, path_lengths: list[int], most_labels: int) -> DataFrame:
    """One row per URL and candidate expression; urls has key, host and path."""
    # substring_index counts dots from the right: no list of a host's labels is made, however many it has. Fewer labels than asked for give the whole host again.
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, most_labels + 1)]))
    lengths = F.array(*[F.lit(n) for n in path_lengths]) if path_lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return (
        urls.where(F.col("host") != "")
        .select("key", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("key", "suffix", F.explode("prefixes").alias("prefix"))
        .select("key", F.concat("suffix", "prefix").alias("expression"))
        .withColumn("short", F.crc32(F.col("expression").cast("binary")))
    )


def filter_urls(
    df: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = 100_000,
) -> DataFrame:
    """id, host, path, rule (null if none fits), verdict, n_rules_fitting."""
    spark = df.sparkSession
    compiled = compile_rules(spark, rules)
    lengths = sorted(r[0] for r in compiled.select("path_length").distinct().collect())
    most_labels = compiled.agg(F.max("labels")).first()[0] or 1
    n_rules = compiled.limit(broadcast_rules + 1).count()
    # The whole URL is the key: the answer is a function of it, so repeated rows and URLs are matched once.
    urls = df.select(F.col(url_col).alias("key")).where(F.col(url_col).isNotNull()).distinct()
    urls = urls.select("key", host_of(F.col("key")).alias("host"), path_of(F.col("key")).alias("path"))
    side = F.broadcast(compiled) if n_rules <= broadcast_rules else compiled
    found = expressions(urls, lengths, most_labels).join(side, "short").where(F.sha2("expression", 256) == F.col("digest"))
    best = found.groupBy("key").agg(
        F.max(F.struct(F.length("rule").alias("length"), "host_length", "action", "rule")).alias("best"),
        F.count("*").alias("n_fitting"),
    )
    rows = df.select(F.col(id_col), F.col(url_col).alias("key"))
    # Rows without a URL meet nothing, so they stay out of the shuffle.
    unmet = [F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("best", "n_fitting")]
    out = rows.where("key IS NOT NULL").join(best, "key", "left").select(id_col, "key", "best", "n_fitting").unionByName(rows.where("key IS NULL").select(id_col, "key", *unmet))
    return out.select(
        F.col(id_col),
        host_of(F.col("key")).alias("host"),
        path_of(F.col("key")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.coalesce("n_fitting", F.lit(0)).cast("long").alias("n_rules_fitting"),
    )
