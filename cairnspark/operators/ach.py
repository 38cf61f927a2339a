"""Analysis of competing hypotheses for many cases at once.

Tables carry case_id; a case has evidence rows and candidate actors. A case becomes one row that holds its evidence and the
ratings by each of its actors; every stage is told by that row alone, without a join, and unfolded into a DataFrame of (case,
evidence, hypothesis) or coarser grain when it is asked for.

evidence:   case_id, evidence_id, ord, kind, value, points_to array, spoofable, base_weight, is_common, is_rare
candidates: case_id, actor_id, ord
profile:    actor_id, facet (ttp, tool, infrastructure, victimology), value, parent
removed:    case_id, actor_id, value: what a case's world lacks of a profile (optional)
overrides:  case_id, evidence_id, hyp_id, rating (optional)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.domain import GRADE_PROBABILITY, lookup, parse_rating
from cairnspark.functions.reuse import settled


@dataclass(frozen=True)
class Config:
    """Variants of the engine, for ablations."""

    false_flags: bool = True
    unknown: bool = True
    spoof_discount: bool = True
    diagnosticity: bool = True
    caps: bool = True
    balanced: bool = False
    support_weight: float = 0.5


DEFAULT = Config()


def _rating(e: Column, actor: Column, has: Column, near: Column) -> Column:
    """The first rule that applies to an evidence row and an actor."""
    kind, listed = e["kind"], F.array_contains(e["points_to"], actor)
    return (
        F.when(F.size(e["points_to"]) > 0, F.when(listed, F.when(e["spoofable"], 1).otherwise(2)).otherwise(F.when(e["spoofable"], -1).otherwise(-2)))
        .when((kind == "ttp") & e["is_common"], 0)
        .when((kind == "ttp") & has, F.when(e["is_rare"], 2).otherwise(1))
        .when((kind == "ttp") & near, 0)
        .when(kind == "ttp", -1)
        .when((kind == "tool") & has, F.when(e["is_common"], 1).otherwise(2))
        .when(kind == "tool", F.when(e["is_common"], 0).otherwise(-1))
        .when(kind == "infrastructure", F.when(has, 2).otherwise(-1))
        .when(kind == "victimology", F.when(has, 1).otherwise(-1))
        .otherwise(0)
    )


def _key(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, value)


def rated(evidence: DataFrame, candidates: DataFrame, profile: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(case_id, ev, actors): a case's evidence in the order of its ids, and its actors (ord, actor_id, r), r in that order.

    An actor's profile travels as one row, and a case's evidence once for each of its actors.
    """
    fields = ["evidence_id", "kind", "value", "points_to", "spoofable", "base_weight", "is_common", "is_rare"]
    ev = settled(evidence.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ev")))
    near = F.when(F.col("facet") == "ttp", F.struct(F.col("value").alias("value"), F.col("parent").alias("parent")))
    held = profile.groupBy("actor_id").agg(F.collect_set(F.struct("facet", "value")).alias("held"), F.collect_set(near).alias("ttps"))
    pairs = candidates.select("case_id", "actor_id", F.col("ord").cast("long").alias("ord")).join(ev, "case_id").join(held, "actor_id", "left")
    if removed is None:
        pairs = pairs.withColumn("gone", F.lit(None).cast("array<string>"))
    else:
        pairs = pairs.join(removed.groupBy("case_id", "actor_id").agg(F.collect_set("value").alias("gone")), ["case_id", "actor_id"], "left")
    there = lambda of: F.when(F.col("gone").isNull(), F.col(of)).otherwise(F.filter(of, lambda h: ~F.array_contains("gone", h["value"])))
    none = F.array().cast("array<string>")
    asked = F.transform("ev", lambda e: _key(e["kind"], e["value"]))
    parents = F.transform("ev", lambda e: F.substring_index(e["value"], ".", 1))
    has = F.array_intersect(F.transform(there("held"), lambda h: _key(h["facet"], h["value"])), asked)
    near = F.array_intersect(F.transform(there("ttps"), lambda h: h["parent"]), parents)
    own = F.struct(F.coalesce(has, none).alias("has"), F.coalesce(near, none).alias("near"))

    def ratings(own: Column) -> Column:
        return F.transform("ev", lambda e: _rating(e, F.col("actor_id"), F.array_contains(own["has"], _key(e["kind"], e["value"])), F.array_contains(own["near"], F.substring_index(e["value"], ".", 1))))

    r = F.get(F.transform(F.array(own), ratings), F.lit(0))  # own is a variable here, so that it is computed once a pair
    told = pairs.select("case_id", F.struct("ord", "actor_id", r.alias("r")).alias("a")).groupBy("case_id").agg(F.array_sort(F.collect_list("a")).alias("actors"))
    bare = candidates.select("case_id", "actor_id", F.col("ord").cast("long").alias("ord")).join(ev, "case_id", "left_anti")
    empty = F.array().cast("array<int>")
    bare = bare.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "actor_id", empty.alias("r")))).alias("actors"))
    kinds = dict(ev.dtypes)["ev"], dict(told.dtypes)["actors"]
    cases = ev.join(told, "case_id", "left").unionByName(bare.select("case_id", F.array().cast(kinds[0]).alias("ev"), F.col("actors").cast(kinds[1]).alias("actors")))
    return cases.withColumn("actors", F.coalesce("actors", F.array().cast(kinds[1])))


def actor_cells(evidence: DataFrame, candidates: DataFrame, profile: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(case_id, evidence_id, actor_id, rating): the first rule that applies to each evidence row and actor."""
    return _actor_cells(rated(evidence, candidates, profile, removed))


def _actor_cells(case: DataFrame) -> DataFrame:
    x = case.select("case_id", "ev", F.explode("actors").alias("a")).select("case_id", "a.actor_id", F.inline(F.zip_with("ev", "a.r", lambda e, r: F.struct(e["evidence_id"].alias("evidence_id"), r.alias("rating")))))
    return x.select("case_id", "evidence_id", "actor_id", "rating")


def _weighed(case: DataFrame, config: Config, overrides: DataFrame | None) -> DataFrame:
    """case with marked (whom markers point at), hyps (hyp_id, kind, actor_id, ord, r) and wt (spread, weight, spoofable)."""
    marks = F.flatten(F.transform(F.filter("ev", lambda e: e["spoofable"]), lambda e: e["points_to"]))
    x = case.withColumn("marked", F.array_sort(F.array_distinct(marks)))
    own = F.transform("actors", lambda a: F.struct(a["actor_id"].alias("hyp_id"), F.lit("actor").alias("kind"), a["actor_id"].alias("actor_id"), a["ord"].alias("ord"), a["r"].alias("r")))
    hyps = [own]
    if config.false_flags:
        def turned(e: Column, r: Column, t: Column) -> Column:
            return F.when(e["spoofable"], F.when(F.array_contains(e["points_to"], t), 2).otherwise(0)).when(r <= -1, 1).when(r >= 1, -1).otherwise(0)

        def flag(t: Column, i: Column) -> Column:
            by = F.get(F.filter("actors", lambda a: a["actor_id"] == t), F.lit(0))["r"]
            r = F.zip_with("ev", F.coalesce(by, F.array().cast("array<int>")), lambda e, r: turned(e, r, t))
            return F.struct(F.concat(F.lit("FF-"), t).alias("hyp_id"), F.lit("false_flag").alias("kind"), t.alias("actor_id"), (F.lit(1_000_001) + i).cast("long").alias("ord"), r.alias("r"))

        hyps.append(F.transform("marked", flag))
    if config.unknown:
        doubt = F.transform("ev", lambda e, j: F.when(~e["spoofable"] & F.exists("actors", lambda a: F.get(a["r"], j) == 2), -1).otherwise(0))
        none = F.struct(F.lit("UNKNOWN").alias("hyp_id"), F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("actor_id"), F.lit(2_000_000).cast("long").alias("ord"), doubt.alias("r"))
        hyps.append(F.filter(F.array(none), lambda h: F.size("ev") > 0))
    x = x.withColumn("hyps", F.concat(*hyps))
    if overrides is not None:  # an analyst's override wins, also one to N
        at = F.struct("evidence_id", "hyp_id")
        o = overrides.groupBy("case_id", at.alias("at")).agg(F.max(parse_rating(F.col("rating"))).alias("told"))
        x = x.join(o.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "told"))).alias("told")), "case_id", "left")
        told = lambda e, h: F.col("told")[F.struct(e["evidence_id"].alias("evidence_id"), h["hyp_id"].alias("hyp_id"))]
        x = x.withColumn("hyps", F.transform("hyps", lambda h: h.withField("r", F.zip_with("ev", h["r"], lambda e, r: F.coalesce(told(e, h), r))))).drop("told")

    def weight(e: Column, j: Column) -> Column:
        of = F.transform("hyps", lambda h: F.get(h["r"], j))
        spread = (F.array_max(of) - F.array_min(of)) / 4.0
        w = e["base_weight"]
        if config.diagnosticity:
            w = w * spread
        if config.spoof_discount:
            w = w * F.when(e["spoofable"], 0.5).otherwise(1.0)
        return F.struct(e["evidence_id"].alias("evidence_id"), e["spoofable"].alias("spoofable"), spread.alias("spread"), w.alias("weight"))

    return x.withColumn("wt", F.transform("ev", weight))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _scored(weighed: DataFrame, config: Config) -> DataFrame:
    """weighed with ranked: hypotheses, best first, with their sums; the key that ranks them comes first."""
    value = lambda h, test: _sum(F.zip_with(h["r"], "wt", lambda r, w: F.when(test(r, w), r * w["weight"]).otherwise(0.0)))

    def summed(h: Column) -> Column:
        return F.struct(
            *(h[c].alias(c) for c in ("hyp_id", "kind", "actor_id", "ord", "r")), value(h, lambda r, w: r < 0).alias("inconsistency"), value(h, lambda r, w: r > 0).alias("support"),
            value(h, lambda r, w: (r > 0) & w["spoofable"]).alias("spoof"),
        )

    def keyed(h: Column) -> Column:
        inc = h["inconsistency"] + config.support_weight * (h["support"] - h["spoof"]) if config.balanced else h["inconsistency"]
        ratio = F.when(F.round(h["support"], 9) > 0, h["spoof"] / h["support"]).otherwise(0.0)
        return F.struct(
            *_order(inc, h["kind"], h["support"], h["ord"]), h["hyp_id"].alias("hyp_id"), h["kind"].alias("kind"), h["actor_id"].alias("actor_id"),
            inc.alias("inconsistency"), h["support"].alias("support"), ratio.alias("spoof_ratio"), h["r"].alias("r"),
        )

    x = weighed.withColumn("sums", F.when(F.size("ev") > 0, F.transform("hyps", summed)).otherwise(F.array()))
    return x.withColumn("ranked", F.array_sort(F.transform("sums", keyed))).drop("sums")


def _order(inconsistency: Column, kind: Column, support: Column, ord: Column) -> list[Column]:
    """Fields whose rising order ranks hypotheses."""
    place = F.when(kind == "unknown", 0).when(kind == "false_flag", 1).otherwise(2)
    return [(-F.round(inconsistency, 9)).alias("by_inc"), place.alias("by_kind"), (-F.round(support, 9)).alias("by_sup"), ord.alias("ord")]


def parse_override(text: str) -> tuple[str, str, str]:
    """EID:HID=RATING."""
    head, _, rating = text.partition("=")
    evidence, _, hypothesis = head.partition(":")
    return evidence, hypothesis, rating


class Assessment:
    """All stages of a set of cases; what they are told by is computed when first asked for and then kept (see settled)."""

    def __init__(self, evidence, candidates, profile, removed=None, overrides=None, config: Config = DEFAULT):
        self._given, self._overrides, self.config = (evidence, candidates, profile, removed), overrides, config

    @cached_property
    def _rated(self) -> DataFrame:
        return settled(rated(*self._given))

    @cached_property
    def _weighed(self) -> DataFrame:
        return _weighed(self._rated, self.config, self._overrides)

    @cached_property
    def _ranked(self) -> DataFrame:
        return settled(_scored(self._weighed, self.config))

    @cached_property
    def hypotheses(self) -> DataFrame:
        """(case_id, hyp_id, kind, actor_id, ord): actors in order, a false flag per marked actor, then unknown."""
        return self._weighed.select("case_id", F.inline("hyps")).drop("r")

    @cached_property
    def actor_cells(self) -> DataFrame:
        return _actor_cells(self._rated)

    @cached_property
    def cells(self) -> DataFrame:
        """(case_id, evidence_id, hyp_id, rating) for every hypothesis; an analyst's override wins, also one to N."""
        x = self._weighed.select("case_id", "ev", F.explode("hyps").alias("h")).select("case_id", F.col("h.hyp_id").alias("hyp_id"), F.inline(F.zip_with("ev", "h.r", lambda e, r: F.struct(e["evidence_id"].alias("evidence_id"), r.alias("rating")))))
        return x.select("case_id", "evidence_id", "hyp_id", "rating")

    @cached_property
    def weights(self) -> DataFrame:
        """(case_id, evidence_id, spoofable, spread, weight)."""
        return self._weighed.select("case_id", F.inline("wt")).where("spread is not null")

    @cached_property
    def scores(self) -> DataFrame:
        """(case_id, hyp_id, kind, actor_id, inconsistency, support, spoof_ratio, rank, ord)."""
        x = self._ranked.select("case_id", F.posexplode("ranked").alias("rank", "h")).withColumn("rank", F.col("rank") + 1)
        return x.select("case_id", *(f"h.{c}" for c in ("hyp_id", "kind", "actor_id", "inconsistency", "support", "spoof_ratio")), "rank", "h.ord")

    @cached_property
    def indicators(self) -> DataFrame:
        """(case_id, many_targets, contradicted): signs of a false flag.

        many_targets: markers point at more than one actor; contradicted: marked candidates that hard evidence speaks against.
        """
        return self._weighed.where(F.size("marked") > 0).select("case_id", *_signs())

    @cached_property
    def assessments(self) -> DataFrame:
        """One row per case: leader, gap, grade after caps, probability, flags."""
        return _assessed(self._ranked, self.config)

    @cached_property
    def sensitivity(self) -> DataFrame:
        """(case_id, dropped, new_leader, flips): the leader when one evidence row is left out, weights unchanged.

        By subtraction from the totals: work grows with evidence times hypotheses, not its square.
        """
        def leader(w: Column, j: Column) -> Column:
            def less(h: Column, place: Column) -> Column:
                r = F.get(h["r"], j)
                v = r * w["weight"]
                inc, sup = h["inconsistency"] - F.when(r < 0, v).otherwise(0.0), h["support"] - F.when(r > 0, v).otherwise(0.0)
                return F.struct(*_order(inc, h["kind"], sup, h["ord"]), h["hyp_id"].alias("hyp_id"), place.alias("place"))

            best = F.array_min(F.transform("ranked", less))
            return F.struct(w["evidence_id"].alias("dropped"), best["hyp_id"].alias("new_leader"), (best["place"] != 0).alias("flips"))

        return self._ranked.where((F.size("ev") > 1) & (F.size("ranked") > 0)).select("case_id", F.inline(F.transform("wt", leader)))

    def drivers(self, n: int = 3) -> DataFrame:
        """(case_id, evidence_id, contribution, rn): what speaks most against the runner-up."""
        second = self._ranked.select("case_id", "wt", F.get("ranked", F.lit(1))["r"].alias("r")).where("r is not null")
        against = F.filter(F.zip_with("r", "wt", lambda r, w: F.struct(F.round(r * w["weight"], 9).alias("by"), w["evidence_id"].alias("evidence_id"), (r * w["weight"]).alias("contribution"))), lambda c: c["contribution"] < 0)
        x = second.select("case_id", F.posexplode(F.slice(F.array_sort(against), 1, n)).alias("rn", "c"))
        return x.select("case_id", "c.evidence_id", "c.contribution", (F.col("rn") + 1).alias("rn"))

    @cached_property
    def matrix_text(self) -> DataFrame:
        """(case_id, evidence_id, row): ratings in ranking order, * for spoofable rows."""
        names = F.create_map(*[F.lit(x) for kv in {2: "CC", 1: "C", 0: "N", -1: "I", -2: "II"}.items() for x in kv])
        shown = lambda w, j: F.array_join(F.transform("ranked", lambda h: names[F.get(h["r"], j)]), " ")
        row = lambda w, j: F.struct(w["evidence_id"].alias("evidence_id"), F.concat(shown(w, j), F.when(w["spoofable"], " *").otherwise("")).alias("row"))
        return self._ranked.where(F.size("ranked") > 0).select("case_id", F.inline(F.transform("wt", row)))

    def reranked(self, config: Config) -> Assessment:
        """The same ratings by actors under another config."""
        out = Assessment(*self._given, self._overrides, config)
        out.__dict__["_rated"] = self._rated
        return out

    def __getitem__(self, stage: str) -> DataFrame:
        return getattr(self, stage)


def _signs() -> list[Column]:
    against = lambda a: F.exists(F.zip_with("ev", a["r"], lambda e, r: ~e["spoofable"] & (r < 0)), lambda x: x)
    contradicted = F.filter("actors", lambda a: F.array_contains("marked", a["actor_id"]) & against(a))
    return [(F.size("marked") > 1).alias("many_targets"), F.size(contradicted).cast("long").alias("contradicted")]


def _assessed(ranked: DataFrame, config: Config) -> DataFrame:
    x = ranked.where(F.size("ranked") > 0).select(
        "case_id", F.get("ranked", F.lit(0)).alias("first"), F.get("ranked", F.lit(1)).alias("second"), "ranked", *_signs(),
        _sum(F.transform("wt", lambda w: w["weight"])).alias("sum"), F.size(F.filter("wt", lambda w: F.round(w["weight"], 9) > 0)).cast("long").alias("n_diag"),
    )
    flag = F.filter("ranked", lambda h: (h["kind"] == "false_flag") & (h["actor_id"] == F.col("leading_actor")))
    x = x.select(
        "case_id", F.col("first.hyp_id").alias("leading"), F.col("first.kind").alias("leading_kind"), F.col("first.actor_id").alias("leading_actor"), F.col("first.inconsistency").alias("inc1"),
        F.col("second.inconsistency").alias("inc2"), F.col("first.spoof_ratio").alias("ratio1"), "ranked", "many_targets", "contradicted", F.when(F.col("sum") > 0, F.col("sum")).otherwise(1e-9).alias("total"), "n_diag",
    ).withColumn("inc_ff", F.get(flag, F.lit(0))["inconsistency"]).withColumn("gap", F.round((F.col("inc1") - F.coalesce("inc2", "inc1")) / F.col("total"), 9))
    base = F.when((F.col("gap") >= 0.35) & (F.col("n_diag") >= 5), 2).when((F.col("gap") >= 0.15) & (F.col("n_diag") >= 3), 1).otherwise(0)
    flagged = F.col("many_targets") | (F.col("contradicted") > 0)
    cap = F.lit(2)
    if config.caps:
        actor_ff = (F.col("leading_kind") == "actor") & (F.round((F.col("inc1") - F.col("inc_ff")) / F.col("total"), 9) < 0.35)
        cap = F.least(
            F.when(F.round("ratio1", 9) >= 0.5, 0).otherwise(2),
            F.when(F.col("leading_kind") != "actor", 1).otherwise(2),
            F.when(F.coalesce(actor_ff, F.lit(False)), 1).otherwise(2),
            F.when(flagged, 1).otherwise(2),
        )
    level = F.least(base, cap)
    grade = F.when(level == 2, "high").when(level == 1, "moderate").otherwise("low")
    return x.select(
        "case_id", "leading", "leading_kind", "leading_actor", "gap", "total", "n_diag", grade.alias("confidence"), flagged.alias("flagged"),
    ).withColumn("probability", lookup(GRADE_PROBABILITY, F.col("confidence")))


def assess(evidence, candidates, profile, removed=None, overrides=None, config: Config = DEFAULT) -> Assessment:
    return Assessment(evidence, candidates, profile, removed, overrides, config)
