"""Leave-one-report-out evaluation: worlds by deltas, five settings, outcomes, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.functions.domain import GRADE_PROBABILITY, grade_of, idf, lookup
from cairnspark.functions.reuse import settled
from cairnspark.operators import ach, search
from cairnspark.operators.attribution import evidence_from_items, planted_markers
from cairnspark.operators.incidents import framing, incident_items, mimicry_items, removed_items
from cairnspark.operators.knowledge import COMMON_FRAC, RARE_MAX

SETTINGS = ["closed", "open", "false_flag", "authentic", "mimicry"]


def cases(incidents: DataFrame, frames: DataFrame, settings: list[str] | None = None) -> DataFrame:
    """(case_id, incident_id, grp, setting, framed, target): an incident in each setting; target: whom markers name."""
    s = F.explode(F.array(*[F.lit(x) for x in settings or SETTINGS])).alias("setting")
    c = incidents.select("incident_id", "grp", s).join(frames, "grp")
    target = F.when(F.col("setting") == "false_flag", F.col("framed")).when(F.col("setting") == "authentic", F.col("grp"))
    return c.select(F.concat_ws("#", "incident_id", "setting").alias("case_id"), "incident_id", "grp", "setting", "framed", target.alias("target"))


def case_items(case: DataFrame, items: DataFrame, mimic: DataFrame) -> DataFrame:
    """(case_id, item_id): the incident's items and, under mimicry, the copied ones."""
    own = case.select("case_id", "incident_id").join(items.select("incident_id", "item_id"), "incident_id")
    copied = case.where("setting = 'mimicry'").select("case_id", "incident_id").join(mimic.select("incident_id", "item_id"), "incident_id")
    return own.select("case_id", "item_id").union(copied.select("case_id", "item_id")).distinct()


def deltas(case: DataFrame, removed: DataFrame, profile: DataFrame) -> DataFrame:
    """(case_id, grp, item_id): items whose usage is one less in the case's world.

    With the group in the world, those that only the incident supports; in the open setting all of the group's.
    """
    closed = case.where("setting <> 'open'").select("case_id", "incident_id", "grp").join(removed.select("incident_id", "item_id"), "incident_id")
    opened = case.where("setting = 'open'").select("case_id", "grp").join(
        profile.select(F.col("actor_id").alias("grp"), "item_id").distinct(), "grp"
    )
    return closed.select("case_id", "grp", "item_id").union(opened.select("case_id", "grp", "item_id"))


def case_usage(case: DataFrame, items: DataFrame, kb: DataFrame, delta: DataFrame, common_frac=COMMON_FRAC, rare_max=RARE_MAX) -> DataFrame:
    """(case_id, item_id, usage, n_groups, is_common, is_rare, idf) of the items that a case observes.

    Techniques keep the common flag of the full knowledge base; tools are judged by the case's world alone.
    """
    x = items.join(kb.select("item_id", "kind", F.col("usage").alias("u"), F.col("n_groups").alias("n"), F.col("is_common").alias("frozen")), "item_id")
    d = delta.select("case_id", "item_id", F.lit(1).alias("less"))
    x = x.join(d, ["case_id", "item_id"], "left").join(case.select("case_id", "setting"), "case_id")
    usage = F.greatest(F.col("u") - F.coalesce("less", F.lit(0)), F.lit(0))
    n = F.col("n") - F.when(F.col("setting") == "open", 1).otherwise(0)
    x = x.withColumn("usage", usage).withColumn("n_groups", n)
    fresh = (F.col("usage") > 0) & (F.col("usage") >= F.col("n_groups") * common_frac)
    return x.select(
        "case_id", "item_id", "usage", "n_groups", ((F.col("kind") == "ttp") & F.col("frozen") | fresh).alias("is_common"),
        F.col("usage").between(1, rare_max).alias("is_rare"), idf(F.col("n_groups"), F.col("usage")).alias("idf"),
    )


def changed_idf(case: DataFrame, delta: DataFrame, kb: DataFrame) -> DataFrame:
    """(case_id, grp, item_id, was, now): the weights of items whose usage is one less in the case's world."""
    n = F.col("n_groups") - F.when(F.col("setting") == "open", 1).otherwise(0)
    return delta.join(case.select("case_id", "setting"), "case_id").join(kb.select("item_id", "usage", "n_groups"), "item_id").select(
        "case_id", "grp", "item_id", idf(n, F.col("usage")).alias("was"), idf(n, F.col("usage") - 1).alias("now")
    )


def world_norms(case: DataFrame, delta: DataFrame, profile: DataFrame, kb: DataFrame, pairs: DataFrame, few: bool = False) -> DataFrame:
    """(case_id, actor_id, norm2) for the wanted pairs: base norms corrected where the world differs.

    Base norms exist for the two possible numbers of groups; a correction joins only the items whose usage changes. few:
    pairs are few a case, so that they are joined first.
    """
    k = kb.select("item_id", "usage", "n_groups")
    base = profile.select("actor_id", "item_id").distinct().join(k, "item_id").groupBy("actor_id").agg(
        F.sum(F.pow(idf(F.col("n_groups"), F.col("usage")), 2)).alias("full"),
        F.sum(F.pow(idf(F.col("n_groups") - 1, F.col("usage")), 2)).alias("less"),
    )
    changed, held, wanted = changed_idf(case, delta, kb), profile.select("actor_id", "item_id").distinct(), pairs.select("case_id", "actor_id")
    if few:
        changed = changed.join(wanted, "case_id").join(held, ["actor_id", "item_id"])
    else:
        changed = changed.join(held, "item_id").join(wanted, ["case_id", "actor_id"], "left_semi")
    fix = (
        changed
        .groupBy("case_id", "actor_id")
        .agg(
            F.sum(
                F.when(F.col("actor_id") == F.col("grp"), -F.pow("was", F.lit(2))).otherwise(F.pow("now", F.lit(2)) - F.pow("was", F.lit(2)))
            ).alias("fix")
        )
    )
    return (
        pairs.select("case_id", "actor_id").join(case.select("case_id", "setting"), "case_id").join(base, "actor_id")
        .join(fix, ["case_id", "actor_id"], "left")
        .select(
            "case_id", "actor_id",
            (F.when(F.col("setting") == "open", F.col("less")).otherwise(F.col("full")) + F.coalesce("fix", F.lit(0.0))).alias("norm2"),
        )
    )


def world_scores(case, usage, delta, profile, kb, markers, boost: float = 0.15) -> DataFrame:
    """(case_id, actor_id, cosine, coverage, score) in each case's world."""
    gone = delta.select("case_id", F.col("grp").alias("actor_id"), "item_id")
    hit = (
        usage.join(profile.select("actor_id", "item_id").distinct(), "item_id")
        .join(gone, ["case_id", "actor_id", "item_id"], "left_anti")
        .groupBy("case_id", "actor_id")
        .agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.sum("idf").alias("matched"))
    )
    own = usage.groupBy("case_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("obs2"), F.sum("idf").alias("obs"))
    norms = world_norms(case, delta, profile, kb, hit)
    out = hit.join(own, "case_id").join(norms, ["case_id", "actor_id"]).select(
        "case_id", "actor_id", (F.col("dot") / (F.sqrt("obs2") * F.sqrt("norm2"))).alias("cosine"), (F.col("matched") / F.col("obs")).alias("coverage")
    )
    m = markers.select("case_id", F.explode("points_to").alias("actor_id")).groupBy("case_id", "actor_id").agg(F.count(F.lit(1)).alias("marks"))
    return out.join(m, ["case_id", "actor_id"], "full_outer").select(
        "case_id", "actor_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        (F.coalesce("cosine", F.lit(0.0)) + boost * F.coalesce("marks", F.lit(0))).alias("score"),
    )


def target_cosines(world, profile: DataFrame, kb: DataFrame) -> DataFrame:
    """(case_id, shown): the cosine of whom markers name, in the case's world; 0 without a shared item."""
    case, usage, held = world["cases"], world["usage"], profile.select("actor_id", "item_id").distinct()
    wanted = case.where("target is not null").select("case_id", F.col("target").alias("actor_id"))
    gone = world["deltas"].select("case_id", F.col("grp").alias("actor_id"), "item_id")
    hit = (
        usage.join(wanted, "case_id").join(held, ["actor_id", "item_id"]).join(gone, ["case_id", "actor_id", "item_id"], "left_anti")
        .groupBy("case_id", "actor_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    )
    own = usage.groupBy("case_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("obs2"))
    norms = world_norms(case, world["deltas"], profile, kb, wanted, few=True)
    found = hit.join(own, "case_id").join(norms, ["case_id", "actor_id"]).select("case_id", (F.col("dot") / (F.sqrt("obs2") * F.sqrt("norm2"))).alias("shown"))
    return wanted.join(found, "case_id", "left").select("case_id", F.coalesce("shown", F.lit(0.0)).alias("shown"))


def world_search(world, profile: DataFrame, kb: DataFrame, actors: DataFrame, metrics: tuple[str, ...], k: int = 8, temperature: float = 0.0, boost: float = 0.15) -> DataFrame:
    """search() over every case in its world: what world_scores() and with_rank() tell, without a table of all pairs."""
    case, items = world["cases"], search.numbered_items(kb)
    changed = changed_idf(case, world["deltas"], kb).join(items, "item_id").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("item", "was", "now"))).alias("changed"))
    marks = world["markers"].groupBy("case_id").agg((boost * F.count(F.lit(1))).alias("boost"))
    place = lambda c, name: actors.select(F.col("actor_id").alias(c), F.col("ord").cast("long").alias(name))
    x = case.select("case_id", F.col("incident_id").alias("key"), "grp", "target", (F.col("setting") == "open").alias("open"))
    x = x.join(place("grp", "own"), "grp", "left").drop("grp").withColumnRenamed("target", "named").join(place("named", "target"), "named", "left").drop("named")
    x = x.join(search.case_items(world["usage"], items), "case_id", "left").join(changed, "case_id", "left").join(marks, "case_id", "left")
    x = x.withColumn("items", F.coalesce("items", F.array().cast("array<struct<item:int,idf:double>>"))).withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    x = x.join(target_cosines(world, profile, kb), "case_id", "left") if "cosine" in metrics else x.withColumn("shown", F.lit(None).cast("double"))
    return search.search(x, search.packed_actors(profile, actors, kb, items), metrics, k, temperature)


def searched_attribution(found: DataFrame, case: DataFrame, actors: DataFrame, by: str, method: str, temperature: float = 0.05) -> DataFrame:
    """What simple_attribution() gives, of world_search() at that temperature."""
    n = actors.agg(F.count(F.lit(1)).alias("all"))
    top = search.tops(found, actors, by).where("rank <= 5").groupBy("case_id").agg(
        F.sort_array(F.collect_list("actor_id")).alias("top5"), F.max(F.when(F.col("rank") == 1, F.col("actor_id"))).alias("leading")
    )
    x = found.where(F.col("metric") == by).join(top, "case_id").join(case.select("case_id", "setting"), "case_id").crossJoin(F.broadcast(n))  # one row
    zeros = F.col("all") - F.when(F.col("setting") == "open", 1).otherwise(0) - F.col("n")
    p = 1.0 / (F.col("z") + zeros * F.exp(-F.col("m") / temperature))
    return x.select(
        F.lit(method).alias("method"), "case_id", "leading", F.lit("actor").alias("kind"), F.lit(None).cast("string").alias("flagged"),
        p.alias("probability"), grade_of(p).alias("confidence"), "top5",
    )


def searched_candidates(world, found: DataFrame, actors: DataFrame, k: int = 8) -> DataFrame:
    """What world_candidates() gives, of world_search()."""
    marked = world["markers"].select("case_id", F.explode("points_to").alias("actor_id")).distinct().join(actors.select("actor_id", "ord"), "actor_id")
    return search.tops(found, actors, "score").where(F.col("rank") <= k).select("case_id", "actor_id", "ord").union(marked.select("case_id", "actor_id", "ord")).distinct()


def with_rank(scores: DataFrame, actors: DataFrame, case: DataFrame, by: str) -> DataFrame:
    """Ranks among actors that the case's world has (the open setting lacks the group)."""
    order = W.partitionBy("case_id").orderBy(F.round(by, 9).desc(), "ord")
    x = scores.join(actors.select("actor_id", "ord"), "actor_id").join(case.select("case_id", "grp", "setting"), "case_id")
    x = x.where((F.col("setting") != "open") | (F.col("actor_id") != F.col("grp")))
    return x.withColumn("rank", F.row_number().over(order))


def simple_attribution(ranked: DataFrame, case: DataFrame, actors: DataFrame, by: str, method: str, temperature: float = 0.05) -> DataFrame:
    """(method, case_id, leading, kind, flagged, probability, top5): top-1 by softmax over all actors of the world."""
    n = actors.agg(F.count(F.lit(1)).alias("n"))
    top = ranked.groupBy("case_id").agg(F.max(by).alias("m"))
    z = ranked.join(top, "case_id").groupBy("case_id", "m").agg(
        F.sum(F.exp((F.col(by) - F.col("m")) / temperature)).alias("z"), F.count(F.lit(1)).alias("k"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.col("actor_id")))).alias("top5"),
        F.max(F.when(F.col("rank") == 1, F.col("actor_id"))).alias("leading"), F.max("setting").alias("setting"),
    ).crossJoin(F.broadcast(n))
    zeros = F.col("n") - F.when(F.col("setting") == "open", 1).otherwise(0) - F.col("k")
    p = 1.0 / (F.col("z") + zeros * F.exp(-F.col("m") / temperature))
    return z.select(
        F.lit(method).alias("method"), "case_id", "leading", F.lit("actor").alias("kind"), F.lit(None).cast("string").alias("flagged"),
        p.alias("probability"), grade_of(p).alias("confidence"), "top5",
    )


def outcomes(case: DataFrame, attributions: DataFrame) -> DataFrame:
    """The fact table: was the attribution right, was the framed actor named, and so on."""
    x = case.join(attributions, "case_id")
    named, s = F.coalesce(F.col("leading") == F.col("grp"), F.lit(False)), F.col("setting")
    spotted = F.coalesce(F.col("flagged") == F.col("framed"), F.lit(False))
    right = (
        F.when(s.isin("closed", "authentic"), named).when(s == "open", F.col("leading").isNull())
        .otherwise(named | spotted)
    )
    return x.select(
        "method", "setting", "incident_id", "grp", "leading", right.alias("correct"),
        (s.isin("false_flag", "mimicry") & F.coalesce(F.col("leading") == F.col("framed"), F.lit(False))).alias("framed_named"),
        F.array_contains("top5", F.col("grp")).alias("top5"), F.col("leading").isNotNull().alias("named"),
        F.when(s == "authentic", F.coalesce(F.col("flagged") == F.col("grp"), F.lit(False))).otherwise(spotted).alias("detected"),
        "probability", F.col("confidence").alias("grade"),
    )


def summarise(outcome: DataFrame, *by: str) -> DataFrame:
    """Rates per method and setting."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return outcome.groupBy(*(by or ("method", "setting"))).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("correct")).alias("accuracy"), rate(F.col("framed_named")).alias("framed_rate"),
        rate(F.col("top5")).alias("top5_rate"), rate(~F.col("named")).alias("declined"), rate(F.col("detected")).alias("detected_rate"),
        F.round(F.try_divide(F.count_if(F.col("correct") & F.col("named")), F.count_if("named")), 9).alias("precision_when_named"),
        F.count_if((F.col("probability") >= 0.8) & ~F.col("correct")).alias("overconfident_errors"),
        F.round(F.avg("probability"), 9).alias("mean_probability"),
    )


def worlds(uses: DataFrame, incidents: DataFrame, actors: DataFrame, kb: DataFrame, profile: DataFrame, settings=None) -> dict[str, DataFrame]:
    """Everything that the methods need: cases, items, markers, deltas, usage."""
    frames = framing(actors)
    case = settled(cases(incidents, frames, settings))
    mimic = mimicry_items(uses, incidents, frames, kb.select("item_id", "usage"))
    items = settled(case_items(case, incident_items(uses, incidents), mimic))
    delta = settled(deltas(case, removed_items(uses, incidents), profile))
    usage = settled(case_usage(case, items, kb, delta))
    return {"cases": case, "items": items, "deltas": delta, "usage": usage, "markers": planted_markers(case.select("case_id", "target"))}


def world_of(case: DataFrame, items: DataFrame, removed: DataFrame, kb: DataFrame, profile: DataFrame) -> dict[str, DataFrame]:
    """The worlds of cases whose items and removals are given, over any knowledge base.

    case as from cases(); items (incident_id, item_id); removed (incident_id, grp, item_id): what the group loses with the
    incident, by whatever references. In the open setting the group is not there at all.
    """
    case = settled(case)
    items = settled(case.select("case_id", "incident_id").join(items.select("incident_id", "item_id").distinct(), "incident_id").select("case_id", "item_id"))
    delta = settled(deltas(case, removed, profile))
    usage = settled(case_usage(case, items, kb, delta))
    return {"cases": case, "items": items, "deltas": delta, "usage": usage, "markers": planted_markers(case.select("case_id", "target"))}


def world_candidates(world, scores: DataFrame, actors: DataFrame, k: int = 8) -> DataFrame:
    """(case_id, actor_id, ord): the k most similar actors of each case and those that markers point at."""
    ranked = with_rank(scores, actors, world["cases"], "score")
    marked = world["markers"].select("case_id", F.explode("points_to").alias("actor_id")).distinct()
    return ranked.where(F.col("rank") <= k).select("case_id", "actor_id", "ord").union(
        ranked.join(marked, ["case_id", "actor_id"], "left_semi").select("case_id", "actor_id", "ord")
    ).distinct()


def world_assessment(world, candidates: DataFrame, profile: DataFrame, config: ach.Config = ach.DEFAULT) -> ach.Assessment:
    """Matrix, ranking and grade for all cases in one plan."""
    flags = world["usage"].select("case_id", "item_id", "is_common", "is_rare")
    evidence = evidence_from_items(world["items"], flags, ["case_id", "item_id"]).unionByName(world["markers"])
    facets = profile.select("actor_id", F.when(F.col("item_id").startswith("S"), "tool").otherwise("ttp").alias("facet"), F.col("item_id").alias("value"), "parent")
    removed = world["deltas"].select("case_id", F.col("grp").alias("actor_id"), F.col("item_id").alias("value"))
    return ach.assess(evidence, candidates, facets, removed, None, config)


def ach_decisions(world, candidates: DataFrame, profile: DataFrame, config: ach.Config = ach.DEFAULT) -> DataFrame:
    """The cases with leading and flagged by ACH."""
    return decided(world, world_assessment(world, candidates, profile, config)["assessments"])


def decided(world, a: DataFrame) -> DataFrame:
    """The cases with leading and flagged as assessed."""
    return world["cases"].join(a.select(
        "case_id", F.when(F.col("leading_kind") == "actor", F.col("leading_actor")).alias("leading"), F.when(F.col("leading_kind") == "false_flag", F.col("leading_actor")).alias("flagged")
    ), "case_id")


def ach_attribution(world, candidates: DataFrame, profile: DataFrame, config: ach.Config = ach.DEFAULT, method="ach"):
    """ACH's attribution of every case, in the form of searched_attribution."""
    out = world_assessment(world, candidates, profile, config)
    a = out["assessments"]
    top5 = out["scores"].where("kind = 'actor'")
    by = W.partitionBy("case_id").orderBy("rank")
    top5 = top5.withColumn("r", F.row_number().over(by)).where("r <= 5").groupBy("case_id").agg(F.sort_array(F.collect_list("actor_id")).alias("top5"))
    return a.join(top5, "case_id").select(
        F.lit(method).alias("method"), "case_id", F.when(F.col("leading_kind") == "actor", F.col("leading_actor")).alias("leading"),
        F.col("leading_kind").alias("kind"), F.when(F.col("leading_kind") == "false_flag", F.col("leading_actor")).alias("flagged"),
        lookup(GRADE_PROBABILITY, F.col("confidence")).alias("probability"), "confidence", "top5",
    )


# --- variants of a case: thresholds, numbers of markers --------------------------------------------------------------------


def variant(case_id, v) -> Column:
    """The case's id in a variant."""
    return F.concat_ws("@", case_id, v.cast("string"))


def spread(t: DataFrame, grid: DataFrame) -> DataFrame:
    """t once for each variant v of a small grid, a parameter."""
    return t.crossJoin(F.broadcast(grid.select("v"))).withColumn("case_id", variant(F.col("case_id"), F.col("v"))).drop("v")


def threshold_variants(world, kb: DataFrame, grid: DataFrame) -> dict[str, DataFrame]:
    """The world with every case at each pair of thresholds of grid (v, common_frac, rare_max): only the flags differ.

    Cases, items, markers and what is taken from profiles are the same in all variants; they are repeated, not rebuilt.
    """
    whole = kb.select("item_id", "kind", F.col("usage").alias("u"), F.col("n_groups").alias("n"))
    x = world["usage"].select("case_id", "item_id", "usage", "n_groups").join(whole, "item_id").crossJoin(F.broadcast(grid))
    common = ((F.col("kind") == "ttp") & (F.col("u") >= F.col("n") * F.col("common_frac"))) | ((F.col("usage") > 0) & (F.col("usage") >= F.col("n_groups") * F.col("common_frac")))
    flags = x.select(variant(F.col("case_id"), F.col("v")).alias("case_id"), "item_id", common.alias("is_common"), F.col("usage").between(F.lit(1), F.col("rare_max")).alias("is_rare"))
    return {"usage": settled(flags)} | {k: settled(spread(world[k], grid)) for k in ("cases", "items", "deltas", "markers")}


def marker_variants(world, counts: list[int]) -> dict[str, DataFrame]:
    """The world with every case at each number of planted markers; v is the number."""
    grid = world["cases"].sparkSession.createDataFrame([(n,) for n in counts], "v int")
    out = {k: settled(spread(world[k], grid)) for k in ("cases", "items", "deltas", "usage")}
    target = world["cases"].select("case_id", "target")
    marks = union([planted_markers(target, n).withColumn("case_id", variant(F.col("case_id"), F.lit(n))) for n in counts])
    return out | {"markers": settled(marks)}


def marker_scores(scores: DataFrame, case: DataFrame, counts: list[int], boost: float = 0.15) -> DataFrame:
    """scores for each number of markers: cosine and coverage stay, markers add their boost to their target."""
    grid = scores.sparkSession.createDataFrame([(n,) for n in counts], "v int")
    t = case.select("case_id", F.col("target").alias("actor_id"), F.lit(1).alias("marked")).where("actor_id is not null")
    x = scores.select("case_id", "actor_id", "cosine", "coverage").join(t, ["case_id", "actor_id"], "left").crossJoin(F.broadcast(grid))
    return x.select(
        variant(F.col("case_id"), F.col("v")).alias("case_id"), "actor_id", "cosine", "coverage", (F.col("cosine") + boost * F.col("v") * F.coalesce("marked", F.lit(0))).alias("score")
    )


def rates(x: DataFrame, *by: str) -> DataFrame:
    """Of judged decisions: how many, and the five rates."""
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(c).cast("double")), 9).alias(c) for c in ("accuracy", "named_true", "framed_named", "detected", "declined"))
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
