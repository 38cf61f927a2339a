"""Attribution methods: evidence from items, cosine similarity, coverage, shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.functions.domain import MARKER_ORDER, RELIABILITY, grade_of
from cairnspark.operators import search

B2 = RELIABILITY["B"] * 0.85



def evidence_from_items(items: DataFrame, kb: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Evidence rows of (case_id, item_id): numbered in item order, grade B2; items of kind tool begin with S.

    kb gives is_common and is_rare, by item or (`on`) by case and item.
    """
    on = on or ["item_id"]
    order = W.partitionBy("case_id").orderBy("item_id")
    tool = F.col("item_id").startswith("S") | F.col("item_id").startswith("tool:")
    flags = kb.select(*on, "is_common", "is_rare")
    numbered = items.select("case_id", "item_id").distinct().withColumn("ord", F.row_number().over(order))
    return numbered.join(flags, on, "left").select(
        "case_id", F.concat(F.lit("E"), F.col("ord").cast("string")).alias("evidence_id"), "ord",
        F.when(tool, "tool").otherwise("ttp").alias("kind"), F.col("item_id").alias("value"), F.array().cast("array<string>").alias("points_to"),
        F.lit(False).alias("spoofable"), F.lit(B2).alias("base_weight"),
        F.coalesce("is_common", F.lit(False)).alias("is_common"), F.coalesce("is_rare", F.lit(False)).alias("is_rare"),
    )


def planted_markers(targets: DataFrame, n: int = 3) -> DataFrame:
    """n spoofable rows per (case_id, target) that point at the target, kinds in turn, grade B2."""
    kinds = F.array(*[F.lit(k) for k in MARKER_ORDER])
    rows = targets.where("target is not null").select("case_id", "target", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    return rows.select(
        "case_id", F.concat(F.lit("M"), F.col("i").cast("string")).alias("evidence_id"), (F.col("i") + 100000).alias("ord"),
        F.element_at(kinds, (F.col("i") - 1) % len(MARKER_ORDER) + 1).alias("kind"), F.lit("").alias("value"),
        F.array("target").alias("points_to"), F.lit(True).alias("spoofable"), F.lit(B2).alias("base_weight"),
        F.lit(False).alias("is_common"), F.lit(False).alias("is_rare"),
    )


def profile_norms(profile: DataFrame, kb: DataFrame) -> DataFrame:
    """(actor_id, norm2): squared length of each actor's vector of inverse document frequencies."""
    return profile.join(kb.select("item_id", "idf"), "item_id").groupBy("actor_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("norm2"))


def similarity(items: DataFrame, profile: DataFrame, kb: DataFrame, markers: DataFrame | None = None, boost: float = 0.15) -> DataFrame:
    """(case_id, actor_id, cosine, coverage, score) of actors that share an item or are pointed at.

    score is the cosine plus the boost for every marker that points at the actor. Only shared items are joined: the
    norms come per actor and per case.
    """
    w = kb.select("item_id", "idf")
    seen = items.select("case_id", "item_id").distinct().join(w, "item_id", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    own = seen.groupBy("case_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("obs2"), F.sum("idf").alias("obs"))
    hit = (
        seen.join(profile.select("actor_id", "item_id"), "item_id")
        .groupBy("case_id", "actor_id")
        .agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.sum("idf").alias("matched"))
    )
    out = (
        hit.join(own, "case_id").join(profile_norms(profile, kb), "actor_id")
        .select(
            "case_id", "actor_id", (F.col("dot") / (F.sqrt("obs2") * F.sqrt("norm2"))).alias("cosine"), (F.col("matched") / F.col("obs")).alias("coverage"),
        )
    )
    if markers is None:
        return out.withColumn("score", F.col("cosine"))
    m = markers.select("case_id", F.explode("points_to").alias("actor_id")).groupBy("case_id", "actor_id").agg(F.count(F.lit(1)).alias("marks"))
    return out.join(m, ["case_id", "actor_id"], "full_outer").select(
        "case_id", "actor_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        (F.coalesce("cosine", F.lit(0.0)) + boost * F.coalesce("marks", F.lit(0))).alias("score"),
    )


def ranked(scores: DataFrame, actors: DataFrame, by: str = "score") -> DataFrame:
    """scores with the actors' order and rank: highest first, ties in profile order."""
    order = W.partitionBy("case_id").orderBy(F.round(by, 9).desc(), "ord")
    return scores.join(actors.select("actor_id", "ord"), "actor_id").withColumn("rank", F.row_number().over(order))


def shortlist(scores: DataFrame, actors: DataFrame, k: int = 8, markers: DataFrame | None = None) -> DataFrame:
    """(case_id, actor_id, ord): the k most similar actors and every actor that markers point at."""
    top = ranked(scores, actors).where(F.col("rank") <= k).select("case_id", "actor_id", "ord")
    if markers is None:
        return top
    named = markers.select("case_id", F.explode("points_to").alias("actor_id")).join(actors.select("actor_id", "ord"), "actor_id")
    return top.unionByName(named.select("case_id", "actor_id", "ord")).distinct()


def softmax_top(scores: DataFrame, actors: DataFrame, n_candidates: int | None = None, temperature: float = 0.05) -> DataFrame:
    """(case_id, leading, probability, confidence): top-1 with its softmax share; actors without a score count as 0."""
    r = ranked(scores, actors)
    n = actors.agg(F.count(F.lit(1)).alias("n")) if n_candidates is None else None
    top = r.groupBy("case_id").agg(F.max("score").alias("m"))
    mass = r.join(top, "case_id").groupBy("case_id", "m").agg(
        F.sum(F.exp((F.col("score") - F.col("m")) / temperature)).alias("z"), F.count(F.lit(1)).alias("k")
    )
    mass = mass.crossJoin(F.broadcast(n)) if n is not None else mass.withColumn("n", F.lit(n_candidates))
    z = F.col("z") + (F.col("n") - F.col("k")) * F.exp(-F.col("m") / temperature)
    return r.where("rank = 1").join(mass.select("case_id", (1.0 / z).alias("probability")), "case_id").select(
        "case_id", F.col("actor_id").alias("leading"), "probability", grade_of(F.col("probability")).alias("confidence")
    )


def best_actors(items: DataFrame, profile: DataFrame, kb: DataFrame, actors: DataFrame, markers: DataFrame, k: int = 8, temperature: float = 0.0, boost: float = 0.15) -> DataFrame:
    """search() by the score of similarity(), without a table of all pairs. The markers of a case point at one actor."""
    of, seen = search.numbered_items(kb), items.select("case_id", "item_id").distinct().join(kb.select("item_id", "idf"), "item_id")
    m = markers.select("case_id", F.explode("points_to").alias("actor_id")).groupBy("case_id", "actor_id").agg((boost * F.count(F.lit(1))).alias("boost"))
    m = m.join(actors.select("actor_id", F.col("ord").cast("long").alias("target")), "actor_id").drop("actor_id")
    x = search.case_items(seen, of).join(m, "case_id", "full_outer").select(
        "case_id", F.col("case_id").alias("key"), F.coalesce("items", F.array().cast("array<struct<item:int,idf:double>>")).alias("items"),
        F.array().cast("array<struct<item:int,was:double,now:double>>").alias("changed"), F.lit(False).alias("open"), F.lit(None).cast("long").alias("own"), "target",
        F.coalesce("boost", F.lit(0.0)).alias("boost"), F.lit(None).cast("double").alias("shown"),
    )
    return search.search(x, search.packed_actors(profile, actors, kb, of), ("score",), k, temperature)


def searched_shortlist(found: DataFrame, actors: DataFrame, k: int, markers: DataFrame) -> DataFrame:
    """What shortlist() gives, of best_actors()."""
    named = markers.select("case_id", F.explode("points_to").alias("actor_id")).join(actors.select("actor_id", "ord"), "actor_id")
    top = search.tops(found, actors, "score").where(F.col("rank") <= k)
    return top.select("case_id", "actor_id", "ord").unionByName(named.select("case_id", "actor_id", "ord")).distinct()


def searched_softmax(found: DataFrame, actors: DataFrame, temperature: float = 0.05) -> DataFrame:
    """What softmax_top() gives, of best_actors() at that temperature."""
    n = actors.agg(F.count(F.lit(1)).alias("all"))
    x = found.where("metric = 'score'").crossJoin(F.broadcast(n))  # one row
    x = x.select("case_id", (1.0 / (F.col("z") + (F.col("all") - F.col("n")) * F.exp(-F.col("m") / temperature))).alias("probability"))
    top = search.tops(found, actors, "score").where("rank = 1").select("case_id", F.col("actor_id").alias("leading"))
    return top.join(x, "case_id").select("case_id", "leading", "probability", grade_of(F.col("probability")).alias("confidence"))
