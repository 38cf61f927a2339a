"""Hold-out incidents and the worlds without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.operators.knowledge import MIN_ITEMS, MIN_PROFILE, support


def report_incidents(
    uses: DataFrame, min_items: int = MIN_ITEMS, max_per_group: int | None = 3, min_profile: int = MIN_PROFILE
) -> DataFrame:
    """(incident_id, grp, reference, n_items, n_removed, n_left): what one report tells of one group.

    An incident needs min_items items; without the items that only it supports, min_profile must be left. Of what is
    kept, the first max_per_group by reference.
    """
    sole = support(uses).where(F.size("refs") == 1).select("source", "target", F.col("refs")[0].alias("reference"))
    size = uses.groupBy("source").agg(F.countDistinct("target").alias("n_all"))
    removed = sole.groupBy("source", "reference").agg(F.count(F.lit(1)).alias("n_removed"))
    out = (
        uses.groupBy("source", "reference")
        .agg(F.countDistinct("target").alias("n_items"))
        .where(F.col("n_items") >= min_items)
        .join(removed, ["source", "reference"], "left")
        .join(size, "source")
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
        .withColumn("n_left", F.col("n_all") - F.col("n_removed"))
        .where(F.col("n_left") >= min_profile)
    )
    if max_per_group is not None:
        order = W.partitionBy("source").orderBy("reference")
        out = out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_per_group)
    return out.select(
        F.concat_ws("|", "source", "reference").alias("incident_id"), F.col("source").alias("grp"), "reference", "n_items", "n_removed", "n_left"
    )


def incident_items(uses: DataFrame, incidents: DataFrame) -> DataFrame:
    """(incident_id, grp, item_id)."""
    return (
        uses.withColumnRenamed("source", "grp")
        .join(incidents.select("incident_id", "grp", "reference"), ["grp", "reference"])
        .select("incident_id", "grp", F.col("target").alias("item_id"))
        .distinct()
    )


def removed_items(uses: DataFrame, incidents: DataFrame) -> DataFrame:
    """(incident_id, grp, item_id): items of the group that nothing but the incident's reference supports."""
    sole = support(uses).where(F.size("refs") == 1).select(
        F.col("source").alias("grp"), F.col("target").alias("item_id"), F.col("refs")[0].alias("reference")
    )
    return sole.join(incidents.select("incident_id", "grp", "reference"), ["grp", "reference"]).select("incident_id", "grp", "item_id")


def temporal_incidents(uses: DataFrame, cut: str, min_items: int = MIN_ITEMS, min_profile: int = MIN_PROFILE) -> DataFrame:
    """Reports that a later release cites and the earlier one (up to the cut day) does not, of groups tracked before."""
    old, new = uses.where(F.col("reference") <= cut), uses
    tracked = old.groupBy("source").agg(F.countDistinct("target").alias("n_old")).where(F.col("n_old") >= min_profile)
    fresh = new.join(old.select("source", "reference").distinct(), ["source", "reference"], "left_anti")
    return (
        fresh.join(tracked, "source")
        .groupBy("source", "reference", "n_old")
        .agg(F.countDistinct("target").alias("n_items"))
        .where(F.col("n_items") >= min_items)
        .select(F.col("source").alias("grp"), "reference", "n_items", "n_old")
    )


def campaign_incidents(campaign_uses: DataFrame, uses: DataFrame, min_items: int = 3, min_profile: int = MIN_PROFILE) -> DataFrame:
    """(campaign, grp, n_items, n_refs, n_left): attributed campaigns; what is left has support outside its references."""
    refs = campaign_uses.select("campaign", "grp", "reference").distinct()
    items = campaign_uses.groupBy("campaign", "grp").agg(
        F.countDistinct("target").alias("n_items"), F.countDistinct("reference").alias("n_refs")
    )
    mine = refs.groupBy("campaign", "grp").agg(F.collect_set("reference").alias("mine"))
    left = (
        mine.join(support(uses).withColumnRenamed("source", "grp"), "grp")
        .where(F.size(F.array_except("refs", "mine")) > 0)
        .groupBy("campaign", "grp")
        .agg(F.countDistinct("target").alias("n_left"))
    )
    return (
        items.where(F.col("n_items") >= min_items)
        .join(left, ["campaign", "grp"])
        .where(F.col("n_left") >= min_profile)
        .select("campaign", "grp", "n_items", "n_refs", "n_left")
    )


def released(uses: DataFrame, releases: list[str]) -> DataFrame:
    """uses with `release`: the newest of the given days before the one that cites them; earlier uses drop out.

    What a report of that day could be compared with is the knowledge base as of the release.
    """
    days = F.array(*[F.lit(d) for d in sorted(releases)])
    return uses.withColumn("release", F.array_max(F.filter(days, lambda d: d < F.col("reference")))).where("release is not null")


def campaign_removed(campaign_uses: DataFrame, uses: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(incident_id, grp, item_id): items of the group that only the campaign's own references support."""
    own = campaigns.select("campaign", "grp")
    mine = campaign_uses.join(own, ["campaign", "grp"], "left_semi").groupBy("campaign", "grp").agg(F.collect_set("reference").alias("mine"))
    held = mine.join(support(uses).withColumnRenamed("source", "grp"), "grp")
    return held.where(F.size(F.array_except("refs", "mine")) == 0).select(F.col("campaign").alias("incident_id"), "grp", F.col("target").alias("item_id"))


def framing(actors: DataFrame) -> DataFrame:
    """(grp, framed): every actor frames the next one by order; the last frames the first."""
    n = actors.agg(F.count(F.lit(1)).alias("n"))
    nxt = actors.select(F.col("actor_id").alias("framed"), F.col("ord").alias("o"))
    a = actors.crossJoin(F.broadcast(n)).withColumn("o", (F.col("ord") + 1) % F.col("n"))
    return a.join(nxt, "o").select(F.col("actor_id").alias("grp"), "framed")


def mimicry_items(uses: DataFrame, incidents: DataFrame, frames: DataFrame, usage: DataFrame, n: int = 3) -> DataFrame:
    """(incident_id, framed, item_id, rn): the n rarest items of the framed actor that the incident lacks."""
    have = incident_items(uses, incidents).select("incident_id", "item_id")
    theirs = uses.select(F.col("source").alias("framed"), F.col("target").alias("item_id")).distinct()
    cand = incidents.select("incident_id", "grp").join(frames, "grp").join(theirs, "framed").join(have, ["incident_id", "item_id"], "left_anti")
    order = W.partitionBy("incident_id").orderBy("usage", "item_id")
    return (
        cand.join(usage, "item_id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("incident_id", "framed", "item_id", "rn")
    )
