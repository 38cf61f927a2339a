"""The given tables as domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, reference): a user is a group, an event with its key an item, a day a cited report.

    Purchases and sign-ups are software (S...), other events techniques (T...) with sub-techniques after a dot.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    head = F.when(F.col("event_type").isin("purchase", "signup"), "S").otherwise("T")
    item = F.concat(head, "event_type", F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))
    return (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("source"),
            item.alias("target"),
            F.date_format("ts", "yyyy-MM-dd").alias("reference"),
        )
        .where("source is not null and target is not null and reference is not null")
        .distinct()
    )


def campaign_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campaign, grp, target, reference): a campaign is what a user did of one event type in one week."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    head = F.when(F.col("event_type").isin("purchase", "signup"), "S").otherwise("T")
    return e.select(
        F.concat_ws(":", F.lit("C"), F.col("user_id").cast("string"), "event_type", week.cast("string")).alias("campaign"),
        F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("grp"),
        F.concat(head, "event_type", F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string")).alias("target"),
        F.date_format("ts", "yyyy-MM-dd").alias("reference"),
    ).distinct()


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, fold, p, correct, method2): labelled documents as scored decisions.

    p is a fixed function of the length; a second method's decision comes from the toxicity label.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    p = (F.pmod(F.col("n_chars") * 7919, F.lit(1000)) / 1000.0).alias("p")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("grp"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2).alias("fold"),
        p, (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("correct2"),
    )


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, predicted): embeddings' labels against a bucket of their first components' signs."""
    sign = lambda i: F.when(F.col("embedding")[i] > 0, 1).otherwise(0)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("truth"), (sign(0) * 4 + sign(1) * 2 + sign(2)).alias("predicted")
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, facet, value): every order as an event; its parts are capabilities, its suppliers infrastructure, its
    customer the victim."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    l = l.join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    named = lambda head, key: F.concat(F.lit(head), F.col(key).cast("string"))
    facets = F.array(
        F.struct(F.lit("capability").alias("facet"), named("P", "l_partkey").alias("value")),
        F.struct(F.lit("infrastructure").alias("facet"), named("S", "l_suppkey").alias("value")),
    )
    lines = l.select(named("E", "l_orderkey").alias("event_id"), F.inline(facets)).distinct()
    return lines.union(o.select(named("E", "o_orderkey"), F.lit("victim"), named("C", "o_custkey")))


#: Words that reports are searched for: the most frequent of five letters or more.
REPORT_WORDS = 300


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, url, host, title, text): web pages as reports; the host is the publisher, without www. or m."""
    p = table(spark, sf_dir, "pages")
    plain = F.regexp_replace("html", "(?s)<script.*?</script>|<style.*?</style>|<[^>]+>", " ")
    return p.select(
        F.col("page_id").alias("report_id"), "url", F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/]+)", 1).alias("host"),
        F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), plain.alias("text"),
    )


def report_keywords(found: DataFrame) -> DataFrame:
    """(item_id, item_type, name, keywords, ord): the REPORT_WORDS words that most reports hold, every third as software.

    The techniques are numbered by fives, so that some share a parent.
    """
    words = found.select("report_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^A-Za-z0-9]+"), lambda w: w.rlike("^[a-z]{5,}$")))).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(REPORT_WORDS)
    rank = F.row_number().over(W.orderBy(F.desc("n"), "word")) - 1  # REPORT_WORDS rows
    tool = F.col("ord") % 3 == 0
    item = F.when(tool, F.concat(F.lit("S"), "ord")).otherwise(F.concat(F.lit("T"), F.floor(F.col("ord") / 5).cast("string"), F.lit("."), (F.col("ord") % 5).cast("string")))
    return top.withColumn("ord", rank).select(item.alias("item_id"), F.when(tool, "tool").otherwise("ttp").alias("item_type"), F.col("word").alias("name"), F.array("word").alias("keywords"), "ord")
