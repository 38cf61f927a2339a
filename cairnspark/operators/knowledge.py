"""Knowledge base: usage counts, common and rare items, actor profiles, support sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.domain import idf, parent_of
from cairnspark.functions.ranking import numbered

#: Shares and counts at which items count as common and rare.
COMMON_FRAC, RARE_MAX, MIN_PROFILE, MIN_ITEMS = 0.15, 13, 8, 4


def groups(uses: DataFrame) -> DataFrame:
    """(actor_id, ord): actors by name."""
    names = uses.select(F.col("source").alias("actor_id")).distinct()
    return numbered(names, "actor_id", name="ord").withColumn("ord", F.col("ord") - 1)


def usage_counts(uses: DataFrame) -> DataFrame:
    """(item_id, usage): distinct groups per item."""
    return uses.groupBy(F.col("target").alias("item_id")).agg(F.countDistinct("source").alias("usage"))


def group_count(uses: DataFrame) -> DataFrame:
    return uses.agg(F.countDistinct("source").alias("n_groups"))


def kb(uses: DataFrame, common_frac: float = COMMON_FRAC, rare_max: int = RARE_MAX) -> DataFrame:
    """(item_id, kind, parent, usage, n_groups, is_common, is_rare, idf)."""
    n = F.broadcast(group_count(uses))  # one row
    return usage_counts(uses).crossJoin(n).select(
        "item_id",
        F.when(F.col("item_id").startswith("S"), "tool").otherwise("ttp").alias("kind"),
        parent_of(F.col("item_id")).alias("parent"),
        "usage",
        "n_groups",
        (F.col("usage") >= F.col("n_groups") * common_frac).alias("is_common"),
        F.col("usage").between(1, rare_max).alias("is_rare"),
        idf(F.col("n_groups"), F.col("usage")).alias("idf"),
    )


def profile_items(uses: DataFrame) -> DataFrame:
    """(actor_id, item_id, parent): the normalised profile."""
    return uses.select(
        F.col("source").alias("actor_id"), F.col("target").alias("item_id"), parent_of(F.col("target")).alias("parent")
    ).distinct()


def actor_profiles(uses: DataFrame, min_items: int = 1, exclude: list[str] | DataFrame | None = None) -> DataFrame:
    """(actor_id, techniques, tools): sorted arrays without `exclude`; min_items is tested before the exclusion.

    exclude: items, as a list or as a table (item_id) of any length.
    """
    keep = F.lit(True)
    if isinstance(exclude, DataFrame):
        gone = exclude.select(F.col("item_id").alias("target"), F.lit(True).alias("gone")).distinct()
        uses, keep = uses.join(gone, "target", "left"), F.col("gone").isNull()
    elif exclude:
        keep = ~F.col("target").isin(exclude)
    tool = F.col("target").startswith("S")
    return (
        uses.groupBy(F.col("source").alias("actor_id"))
        .agg(
            F.countDistinct("target").alias("n"),
            F.sort_array(F.collect_set(F.when(keep & ~tool, F.col("target")))).alias("techniques"),
            F.sort_array(F.collect_set(F.when(keep & tool, F.col("target")))).alias("tools"),
        )
        .where(F.col("n") >= min_items)
        .select("actor_id", "techniques", "tools")
    )


def via_software(uses: DataFrame, software_uses: DataFrame) -> DataFrame:
    """(source, target): items used directly, or by software that is used."""
    direct = uses.select("source", "target")
    hop = uses.select("source", F.col("target").alias("via")).join(software_uses.withColumnRenamed("source", "via"), "via")
    return direct.union(hop.select("source", "target")).distinct()


def support(uses: DataFrame) -> DataFrame:
    """(source, target, refs): references per group and item; an uncited use counts as one pseudo-reference."""
    ref = F.coalesce(F.nullif("reference", F.lit("")), F.lit("<uncited>"))
    return uses.groupBy("source", "target").agg(F.sort_array(F.collect_set(ref)).alias("refs"))


def summary(uses: DataFrame) -> DataFrame:
    """(name, n): sizes of the knowledge base."""
    tool = F.col("target").startswith("S")
    one = uses.agg(
        F.countDistinct("source").alias("groups"),
        F.countDistinct(F.when(~tool, F.col("target"))).alias("techniques"),
        F.countDistinct(F.when(tool, F.col("target"))).alias("software"),
        F.countDistinct("reference").alias("references"),
        F.count(F.lit(1)).alias("uses"),
    )
    return one.unpivot([], ["groups", "techniques", "software", "references", "uses"], "name", "n")
