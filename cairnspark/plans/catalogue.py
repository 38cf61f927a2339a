"""Registered queries of the library, each over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions.domain import parent_of
from cairnspark.functions.reuse import settled
from cairnspark.operators import ach, attribution, calibration, clustering, evaluation, extraction, incidents, intervals, knowledge, metrics, protocols, sinks
from cairnspark.plans.oracles import BLOCKS, sql
from cairnspark.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DRAWS = 1000
#: Thresholds to choose from, and those of the frontier.
TAUS = [round(0.1 + 0.02 * i, 2) for i in range(21)]
FINE_TAUS = [round(0.005 * i, 3) for i in range(161)]


def query(oracle: str | None = None, whole: bool = False) -> Callable[[Query], Query]:
    """Registers a query and its SQL, which reads blocks unless it is whole already."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _SQL[f.__name__] = oracle if whole else sql(oracle)
        return f

    return add


def _all() -> None:
    """Has the other modules of queries registered, too."""
    from cairnspark.plans import protocol_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def r9(*names: str):
    return [F.round(n, 9).alias(n) for n in names]


def _facets(profile: DataFrame) -> DataFrame:
    kind = F.when(F.col("item_id").startswith("S"), "tool").otherwise("ttp")
    return profile.select("actor_id", kind.alias("facet"), F.col("item_id").alias("value"), "parent")


class StaticWorld:
    """Cases are incidents, three of each group at most as in hold-outs, with markers that point at the next group; shortlist of eight.

    Each part is made when first asked for.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._uses = lambda: settled(bridge.uses(spark, sf_dir))

    @cached_property
    def uses(self) -> DataFrame:
        return self._uses()

    @cached_property
    def kb(self) -> DataFrame:
        return settled(knowledge.kb(self.uses))

    @cached_property
    def profile(self) -> DataFrame:
        return knowledge.profile_items(self.uses)

    @cached_property
    def actors(self) -> DataFrame:
        return settled(knowledge.groups(self.uses))

    @cached_property
    def incidents(self) -> DataFrame:
        return settled(incidents.report_incidents(self.uses))

    @cached_property
    def items(self) -> DataFrame:
        return settled(incidents.incident_items(self.uses, self.incidents).select(F.col("incident_id").alias("case_id"), "item_id"))

    @cached_property
    def frames(self) -> DataFrame:
        return incidents.framing(self.actors)

    @cached_property
    def markers(self) -> DataFrame:
        return attribution.planted_markers(self.incidents.join(self.frames, "grp").select(F.col("incident_id").alias("case_id"), F.col("framed").alias("target")))

    @cached_property
    def sims(self) -> DataFrame:
        """All pairs of cases and actors that share an item or are pointed at."""
        return attribution.similarity(self.items, self.profile, self.kb, self.markers)

    @cached_property
    def found(self) -> DataFrame:
        """The best of these pairs, without a table of all."""
        return attribution.best_actors(self.items, self.profile, self.kb, self.actors, self.markers)

    @cached_property
    def candidates(self) -> DataFrame:
        return attribution.searched_shortlist(self.found, self.actors, 8, self.markers)

    @cached_property
    def evidence(self) -> DataFrame:
        return attribution.evidence_from_items(self.items, self.kb).unionByName(self.markers)

    def __getitem__(self, part: str) -> DataFrame:
        return getattr(self, part)


def static_world(spark: SparkSession, sf_dir: str) -> StaticWorld:
    return StaticWorld(spark, sf_dir)


def static_ach(spark, sf_dir, config=ach.DEFAULT) -> ach.Assessment:
    w = static_world(spark, sf_dir)
    return ach.assess(w["evidence"], w["candidates"], _facets(w["profile"]), config=config)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ach_confidence(spark, sf_dir)


# --- knowledge base ------------------------------------------------------------------------------------------------------


@query("SELECT item_id, usage FROM usage")
def kb_usage_counts(spark, sf_dir):
    return knowledge.usage_counts(bridge.uses(spark, sf_dir))


@query("SELECT item_id, kind, parent, usage, n_groups, is_common, is_rare, round(idf, 9) AS idf FROM kb")
def kb_common_rare(spark, sf_dir):
    return knowledge.kb(bridge.uses(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@query("""SELECT 'groups' AS name, count(DISTINCT source) AS n FROM uses UNION ALL SELECT 'techniques', count(DISTINCT target) FROM uses WHERE target LIKE 'T%'
UNION ALL SELECT 'software', count(DISTINCT target) FROM uses WHERE target LIKE 'S%' UNION ALL SELECT 'references', count(DISTINCT reference) FROM uses
UNION ALL SELECT 'uses', count(*) FROM uses""")
def knowledge_summary(spark, sf_dir):
    return knowledge.summary(bridge.uses(spark, sf_dir))


@query("""SELECT source AS actor_id, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (target LIKE 'T%'), '') AS techniques,
coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (target LIKE 'S%'), '') AS tools FROM uses GROUP BY 1""")
def actor_profiles(spark, sf_dir):
    p = knowledge.actor_profiles(bridge.uses(spark, sf_dir))
    return p.select("actor_id", F.array_join("techniques", ",").alias("techniques"), F.array_join("tools", ",").alias("tools"))


@query("SELECT source, target, string_agg(DISTINCT reference, ',' ORDER BY reference) AS refs FROM uses GROUP BY 1, 2")
def support_sets(spark, sf_dir):
    return knowledge.support(bridge.uses(spark, sf_dir)).withColumn("refs", F.array_join("refs", ","))


@query("SELECT DISTINCT source, target FROM uses UNION SELECT source, 'T' || substr(target, 2) FROM uses WHERE target LIKE 'S%'")
def usage_via_software(spark, sf_dir):
    """A tool brings the technique of the same name."""
    u = bridge.uses(spark, sf_dir)
    s = u.where("target LIKE 'S%'").select(F.col("target").alias("source"), F.concat(F.lit("T"), F.expr("substring(target, 2)")).alias("target")).distinct()
    return knowledge.via_software(u, s)


# --- incidents -------------------------------------------------------------------------------------------------------------

_INC = "SELECT incident_id, grp, reference, n_items, n_removed, n_left FROM "


@query(_INC + "incidents")
def incidents_loro(spark, sf_dir):
    return incidents.report_incidents(bridge.uses(spark, sf_dir), max_per_group=None)


@query(_INC + "inc3")
def incidents_capped(spark, sf_dir):
    return incidents.report_incidents(bridge.uses(spark, sf_dir))


@query("""SELECT n.source AS grp, n.reference, count(DISTINCT n.target) AS n_items, o.n_old FROM uses n
JOIN (SELECT source, count(DISTINCT target) AS n_old FROM uses WHERE reference <= '2024-01-15' GROUP BY 1 HAVING count(DISTINCT target) >= 8) o ON o.source = n.source
WHERE NOT EXISTS (SELECT 1 FROM uses p WHERE p.reference <= '2024-01-15' AND p.source = n.source AND p.reference = n.reference)
GROUP BY 1, 2, 4 HAVING count(DISTINCT n.target) >= 4""")
def temporal_incidents(spark, sf_dir):
    return incidents.temporal_incidents(bridge.uses(spark, sf_dir), "2024-01-15")


@query("""SELECT c.campaign, c.grp, c.n_items, c.n_refs, l.n_left FROM
(SELECT campaign, grp, count(DISTINCT target) AS n_items, count(DISTINCT reference) AS n_refs FROM camp GROUP BY 1, 2 HAVING count(DISTINCT target) >= 3) c
JOIN (SELECT x.campaign, count(DISTINCT u.target) AS n_left FROM (SELECT DISTINCT campaign, grp FROM camp) x JOIN uses u ON u.source = x.grp
  WHERE NOT EXISTS (SELECT 1 FROM camp r WHERE r.campaign = x.campaign AND r.reference = u.reference) GROUP BY 1 HAVING count(DISTINCT u.target) >= 8) l ON l.campaign = c.campaign""")
def campaign_incidents(spark, sf_dir):
    return incidents.campaign_incidents(bridge.campaign_uses(spark, sf_dir), bridge.uses(spark, sf_dir))


@query("""SELECT incident_id, framed, item_id, rn FROM (SELECT i.incident_id, f.framed, u.item_id, row_number() OVER (PARTITION BY i.incident_id ORDER BY k.usage, u.item_id) AS rn
FROM inc3 i JOIN frames f ON f.grp = i.grp JOIN profile u ON u.actor_id = f.framed JOIN usage k ON k.item_id = u.item_id
WHERE NOT EXISTS (SELECT 1 FROM uses v WHERE v.source = i.grp AND v.reference = i.reference AND v.target = u.item_id)) WHERE rn <= 3""")
def mimicry_items(spark, sf_dir):
    u = bridge.uses(spark, sf_dir)
    return incidents.mimicry_items(u, incidents.report_incidents(u), incidents.framing(knowledge.groups(u)), knowledge.usage_counts(u))


@query("SELECT i.incident_id, i.grp, s.target AS item_id FROM inc3 i JOIN support s ON s.source = i.grp AND s.ref1 = i.reference AND s.n_refs = 1")
def holdout_removed(spark, sf_dir):
    u = bridge.uses(spark, sf_dir)
    return incidents.removed_items(u, incidents.report_incidents(u))


# --- ACH -------------------------------------------------------------------------------------------------------------------


@query("SELECT case_id, evidence_id, kind, value, coalesce(target, '') AS target, spoofable, round(base_weight, 9) AS base_weight, is_common, is_rare FROM ev")
def evidence_rows(spark, sf_dir):
    e = static_world(spark, sf_dir)["evidence"]
    return e.select("case_id", "evidence_id", "kind", "value", F.array_join("points_to", ",").alias("target"), "spoofable", *r9("base_weight"), "is_common", "is_rare")


@query("SELECT case_id, hyp_id, kind, coalesce(actor_id, '') AS actor_id, ord FROM hyps")
def ach_hypotheses(spark, sf_dir):
    return static_ach(spark, sf_dir)["hypotheses"].withColumn("actor_id", F.coalesce("actor_id", F.lit("")))


@query("SELECT case_id, evidence_id, hyp_id, rating FROM mat")
def ach_cells(spark, sf_dir):
    return static_ach(spark, sf_dir)["cells"]


@query("SELECT case_id, evidence_id, round(spread, 9) AS spread, round(weight, 9) AS weight FROM wts")
def ach_weights(spark, sf_dir):
    return static_ach(spark, sf_dir)["weights"].select("case_id", "evidence_id", *r9("spread", "weight"))


@query("SELECT case_id, hyp_id, round(inconsistency, 9) AS inconsistency, round(support, 9) AS support, round(spoof_ratio, 9) AS spoof_ratio, rank FROM scored")
def ach_ranking(spark, sf_dir):
    s = static_ach(spark, sf_dir)["scores"]
    return s.select("case_id", "hyp_id", *[F.round(c, 9).alias(c) for c in ("inconsistency", "support", "spoof_ratio")], "rank")


@query('SELECT case_id, "leading", leading_kind, round(gap, 9) AS gap, n_diag, confidence, flagged FROM graded')
def ach_confidence(spark, sf_dir):
    a = static_ach(spark, sf_dir)["assessments"]
    return a.select("case_id", "leading", "leading_kind", F.round("gap", 9).alias("gap"), "n_diag", "confidence", "flagged")


@query("SELECT case_id, many AS many_targets, contradicted FROM signs")
def ach_indicators(spark, sf_dir):
    return static_ach(spark, sf_dir)["indicators"]


@query("""SELECT case_id, evidence_id AS dropped, hyp_id AS new_leader, was <> 1 AS flips FROM (SELECT x.*, row_number() OVER (PARTITION BY case_id, evidence_id
ORDER BY round(inc, 9) DESC, CASE kind WHEN 'unknown' THEN 0 WHEN 'false_flag' THEN 1 ELSE 2 END, round(sup, 9) DESC, ord) AS rn FROM (
SELECT m.case_id, m.evidence_id, m.hyp_id, s.kind, s.ord, s.rank AS was, s.inconsistency - CASE WHEN rating < 0 THEN rating * weight ELSE 0 END AS inc,
s.support - CASE WHEN rating > 0 THEN rating * weight ELSE 0 END AS sup FROM mat m JOIN wts w USING (case_id, evidence_id) JOIN scored s USING (case_id, hyp_id)) x) WHERE rn = 1""")
def ach_sensitivity(spark, sf_dir):
    return static_ach(spark, sf_dir)["sensitivity"]


@query("""SELECT case_id, evidence_id, round(c, 9) AS contribution, rn FROM (SELECT case_id, evidence_id, rating * weight AS c,
row_number() OVER (PARTITION BY case_id ORDER BY round(rating * weight, 9), evidence_id) AS rn FROM mat JOIN wts USING (case_id, evidence_id)
JOIN (SELECT case_id, hyp_id FROM scored WHERE rank = 2) USING (case_id, hyp_id) WHERE rating * weight < 0) WHERE rn <= 3""")
def ach_drivers(spark, sf_dir):
    return static_ach(spark, sf_dir).drivers().withColumn("contribution", F.round("contribution", 9))


@query("""SELECT case_id, hyp_id FROM (SELECT case_id, hyp_id, row_number() OVER (PARTITION BY case_id ORDER BY round(inconsistency + 0.5 * (support - spoof), 9) DESC,
CASE kind WHEN 'unknown' THEN 0 WHEN 'false_flag' THEN 1 ELSE 2 END, round(support, 9) DESC, ord) AS rn FROM sums JOIN hyps USING (case_id, hyp_id)) WHERE rn = 1""")
def ach_balanced(spark, sf_dir):
    return static_ach(spark, sf_dir, ach.Config(balanced=True))["scores"].where("rank = 1").select("case_id", "hyp_id")


@query("""SELECT to_json({'case_id': case_id, 'leading': "leading", 'confidence': confidence, 'gap': round(gap, 3), 'n_diag': n_diag, 'flagged': flagged})::VARCHAR AS line FROM graded""")
def assessment_dump(spark, sf_dir):
    """Every assessment as a JSON line with three decimals."""
    return sinks.dump(static_ach(spark, sf_dir)["assessments"], "case_id", "leading", "confidence", "gap", "n_diag", "flagged")


@query("""SELECT source AS actor_id, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (target LIKE 'T%' AND c.item_id IS NULL), '') AS techniques,
coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (target LIKE 'S%' AND c.item_id IS NULL), '') AS tools FROM uses LEFT JOIN (SELECT item_id FROM kb WHERE is_common) c ON c.item_id = target GROUP BY 1 HAVING count(DISTINCT target) >= 8""")
def uncommon_profiles(spark, sf_dir):
    """Profiles of eight items or more, without the items that are common: the items to leave out are a table."""
    u = bridge.uses(spark, sf_dir)
    p = knowledge.actor_profiles(u, knowledge.MIN_PROFILE, knowledge.kb(u).where("is_common").select("item_id"))
    return p.select("actor_id", F.array_join("techniques", ",").alias("techniques"), F.array_join("tools", ",").alias("tools"))


ABLATIONS = {
    "no_false_flags": ach.Config(false_flags=False), "no_unknown": ach.Config(unknown=False), "no_discount": ach.Config(spoof_discount=False),
    "no_diagnosticity": ach.Config(diagnosticity=False), "no_caps": ach.Config(caps=False),
}


def _ablation_sql() -> str:
    """The static assessment with one block of its rules changed at a time."""
    hyps, wts, graded = (BLOCKS[b] for b in ("hyps", "wts", "graded"))
    flags, unknown, least = hyps.index("UNION ALL SELECT case_id, 'FF-'"), hyps.rindex("UNION ALL"), graded.index("(least(")
    changed = {
        "no_false_flags": {"hyps": hyps[:flags] + hyps[unknown:]}, "no_unknown": {"hyps": hyps[:unknown]},
        "no_discount": {"wts": wts.replace(" * (CASE WHEN e.spoofable THEN 0.5 ELSE 1.0 END)", "")}, "no_diagnosticity": {"wts": wts.replace("e.base_weight * s.spread", "e.base_weight")},
        "no_caps": {"graded": graded[:least] + "(" + graded[least + 7 : graded.index("ELSE 0 END") + 10] + " + 1)::INT] AS confidence FROM assessed"},
    }
    one = "SELECT leading_kind, confidence, count(*) AS n, '{}' AS variant FROM graded GROUP BY 1, 2"
    return " UNION ALL ".join(f"SELECT * FROM ({sql(one.format(name), **blocks)})" for name, blocks in changed.items())


@query(_ablation_sql(), whole=True)
def ach_ablations(spark, sf_dir):
    """How leaders and grades come out with one switch off at a time."""
    parts, base = [], static_ach(spark, sf_dir)
    for name, config in ABLATIONS.items():
        a = base.reranked(config)["assessments"]
        parts.append(a.groupBy("leading_kind", "confidence").agg(F.count(F.lit(1)).alias("n")).withColumn("variant", F.lit(name)))
    return evaluation.union(parts)


@query("""SELECT case_id, evidence_id, string_agg(CASE rating WHEN 2 THEN 'CC' WHEN 1 THEN 'C' WHEN 0 THEN 'N' WHEN -1 THEN 'I' ELSE 'II' END, ' ' ORDER BY rank)
|| CASE WHEN bool_or(w.spoofable) THEN ' *' ELSE '' END AS row FROM mat JOIN scored USING (case_id, hyp_id) JOIN wts w USING (case_id, evidence_id) GROUP BY 1, 2""")
def ach_matrix_text(spark, sf_dir):
    return static_ach(spark, sf_dir)["matrix_text"]


# --- similarity ------------------------------------------------------------------------------------------------------------


@query("SELECT case_id, actor_id, round(cosine, 9) AS cosine, round(coverage, 9) AS coverage, round(score, 9) AS score FROM sims")
def sim_scores(spark, sf_dir):
    return static_world(spark, sf_dir)["sims"].select("case_id", "actor_id", *r9("cosine", "coverage", "score"))


@query("SELECT case_id, actor_id, ord FROM cand")
def shortlist(spark, sf_dir):
    return static_world(spark, sf_dir)["candidates"]


@query("""SELECT case_id, "leading", round(p, 9) AS probability, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.55 THEN 'moderate' ELSE 'low' END AS confidence FROM (
SELECT r.case_id, max(CASE WHEN rank = 1 THEN actor_id END) AS "leading", 1 / (sum(exp((score - m) / 0.05)) + ((SELECT count(*) FROM actors) - count(*)) * exp(-max(m) / 0.05)) AS p
FROM ranks r JOIN (SELECT case_id, max(score) AS m FROM ranks GROUP BY 1) t ON t.case_id = r.case_id GROUP BY 1)""")
def sim_attribution(spark, sf_dir):
    w = static_world(spark, sf_dir)
    found = attribution.best_actors(w["items"], w["profile"], w["kb"], w["actors"], w["markers"], 1, 0.05)
    return attribution.searched_softmax(found, w["actors"]).withColumn("probability", F.round("probability", 9))


# --- evaluation ------------------------------------------------------------------------------------------------------------


def _evaluated(spark, sf_dir, methods=("similarity", "coverage"), settings=None):
    uses = settled(bridge.uses(spark, sf_dir))
    kb, profile, actors = settled(knowledge.kb(uses)), knowledge.profile_items(uses), settled(knowledge.groups(uses))
    inc = settled(incidents.report_incidents(uses))
    world = evaluation.worlds(uses, inc, actors, kb, profile, settings)
    by = {"ach": "score", "similarity": "score", "coverage": "coverage"}
    found = evaluation.world_search(world, profile, kb, actors, tuple(sorted({by[m] for m in methods})), temperature=0.05)
    parts = []
    for m in methods:
        if m == "ach":
            parts.append(evaluation.ach_attribution(world, evaluation.searched_candidates(world, found, actors), profile))
        else:
            parts.append(evaluation.searched_attribution(found, world["cases"], actors, by[m], m))
    return evaluation.outcomes(world["cases"], evaluation.union(parts))


@query("""SELECT * FROM (WITH cs AS (SELECT i.incident_id || '#' || s AS case_id, i.incident_id, i.grp, i.reference, s AS setting FROM inc3 i, (SELECT unnest(['closed','open']) AS s) t(s)),
delta AS (SELECT c.case_id, c.grp, p.target AS item_id FROM cs c JOIN support p ON p.source = c.grp AND ((c.setting = 'closed' AND p.n_refs = 1 AND p.ref1 = c.reference) OR c.setting = 'open')),
obs AS (SELECT DISTINCT c.case_id, c.setting, u.target AS item_id FROM cs c JOIN uses u ON u.source = c.grp AND u.reference = c.reference)
SELECT o.case_id, o.item_id, k.usage - (d.item_id IS NOT NULL)::INT AS usage, k.n_groups - (o.setting = 'open')::INT AS n_groups,
round(ln((1.0 + k.n_groups - (o.setting = 'open')::INT) / (1.0 + k.usage - (d.item_id IS NOT NULL)::INT)) + 1, 9) AS idf
FROM obs o JOIN kb k ON k.item_id = o.item_id LEFT JOIN delta d ON d.case_id = o.case_id AND d.item_id = o.item_id)""")
def holdout_usage(spark, sf_dir):
    u = bridge.uses(spark, sf_dir)
    inc = incidents.report_incidents(u)
    w = evaluation.worlds(u, inc, knowledge.groups(u), knowledge.kb(u), knowledge.profile_items(u), ["closed", "open"])
    return w["usage"].select("case_id", "item_id", "usage", "n_groups", *r9("idf"))


@query("""SELECT s.case_id, s.actor_id, round(s.cosine, 9) AS cosine, round(s.coverage, 9) AS coverage, round(s.score, 9) AS score
FROM wsim s JOIN wcs c ON c.case_id = s.case_id WHERE c.setting IN ('closed', 'open')""")
def world_similarity(spark, sf_dir):
    """Cosine in hold-out worlds by corrected norms; the SQL builds every world in full."""
    u = settled(bridge.uses(spark, sf_dir))
    kb, profile, actors = settled(knowledge.kb(u)), knowledge.profile_items(u), settled(knowledge.groups(u))
    w = evaluation.worlds(u, settled(incidents.report_incidents(u)), actors, kb, profile, ["closed", "open"])
    s = evaluation.world_scores(w["cases"], w["usage"], w["deltas"], profile, kb, w["markers"])
    return s.select("case_id", "actor_id", *r9("cosine", "coverage", "score"))


@query("SELECT * REPLACE (round(probability, 9) AS probability) FROM wout")
def eval_outcomes(spark, sf_dir):
    """Similarity and coverage on every incident in the five settings."""
    return _evaluated(spark, sf_dir).withColumn("probability", F.round("probability", 9))


@query("""SELECT method, setting, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(framed_named::INT), 9) AS framed_rate, round(avg(top5::INT), 9) AS top5_rate,
round(avg((NOT named)::INT), 9) AS declined, round(avg(detected::INT), 9) AS detected_rate, round(count(*) FILTER (correct AND named) / nullif(count(*) FILTER (named), 0), 9) AS precision_when_named,
count(*) FILTER (probability >= 0.8 AND NOT correct) AS overconfident_errors, round(avg(probability), 9) AS mean_probability FROM wout GROUP BY 1, 2""")
def eval_summary(spark, sf_dir):
    return evaluation.summarise(_evaluated(spark, sf_dir))


@query("""SELECT 'ach' AS method, setting, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(framed_named::INT), 9) AS framed_rate, round(avg(top5::INT), 9) AS top5_rate, round(avg(("leading" IS NULL)::INT), 9) AS declined,
round(avg(detected::INT), 9) AS detected_rate, round(count(*) FILTER (correct AND "leading" IS NOT NULL) / nullif(count(*) FILTER ("leading" IS NOT NULL), 0), 9) AS precision_when_named,
count(*) FILTER (p >= 0.8 AND NOT correct) AS overconfident_errors, round(avg(p), 9) AS mean_probability FROM (SELECT r.*, CASE WHEN setting = 'open' THEN r."leading" IS NULL WHEN setting IN ('closed', 'authentic') THEN named_true ELSE named_true OR detected END AS correct,
CASE g.confidence WHEN 'high' THEN 0.875 WHEN 'moderate' THEN 0.675 ELSE 0.5 END AS p, coalesce(t.hit, FALSE) AS top5 FROM xrec r JOIN xgraded g ON g.case_id = r.case_id LEFT JOIN (SELECT case_id, actor_id, rn <= 5 AS hit FROM (SELECT case_id, actor_id,
row_number() OVER (PARTITION BY case_id ORDER BY rank) AS rn FROM xscored WHERE kind = 'actor')) t ON t.case_id = r.case_id AND t.actor_id = r.grp) GROUP BY 2""")
def eval_ach(spark, sf_dir):
    """ACH on every incident in the five settings, summarised."""
    return evaluation.summarise(_evaluated(spark, sf_dir, ("ach",)))


def _rank_table(spark, sf_dir):
    u = settled(bridge.uses(spark, sf_dir))
    kb, profile, actors = settled(knowledge.kb(u)), knowledge.profile_items(u), settled(knowledge.groups(u))
    w = evaluation.worlds(u, settled(incidents.report_incidents(u)), actors, kb, profile)
    found = evaluation.world_search(w, profile, kb, actors, ("cosine",), 1)
    return settled(protocols.searched_ranks(found, w["cases"], actors))


_KS = "(SELECT unnest([" + ", ".join(map(str, protocols.KS)) + "]) AS k, unnest(range(" + str(len(protocols.KS)) + ")) AS i)"
_GATE = """SELECT *, CASE WHEN setting = 'open' THEN "leading" IS NULL WHEN setting IN ('false_flag', 'mimicry') THEN coalesce("leading" = grp, FALSE) OR coalesce(flagged = framed, FALSE)
ELSE coalesce("leading" = grp, FALSE) END AS accuracy FROM (SELECT t.*, g.k, g.i, CASE WHEN coalesce(place <= k, FALSE) THEN visible ELSE top END AS "leading",
CASE WHEN coalesce(place <= k, FALSE) THEN NULL ELSE visible END AS flagged FROM wtop t, """ + _KS + " g)"
_BEST = """SELECT 1 - fold AS fold, k FROM (SELECT fold, k, row_number() OVER (PARTITION BY fold ORDER BY round((avg(accuracy::INT) FILTER (setting = '{a}') + avg(accuracy::INT) FILTER (setting = '{b}')) / 2, 9) DESC, i) AS rn
FROM ({x}) y GROUP BY fold, k, i) WHERE rn = 1"""


@query(f"""SELECT y.case_id, y.setting, y.grp, y.fold, y.k::DOUBLE AS chosen, y."leading", y.flagged, y.accuracy FROM ({_GATE}) y
JOIN ({_BEST.format(a="false_flag", b="authentic", x=_GATE)}) b ON b.fold = y.fold AND b.k = y.k""")
def consistency_gate(spark, sf_dir):
    """The gate with the rank that did best on the other fold of groups."""
    x = protocols.crossfit(_rank_table(spark, sf_dir), protocols.gate, protocols.KS, ("false_flag", "authentic"))
    return x.select("case_id", "setting", "grp", F.col("fold").cast("long").alias("fold"), "chosen", "leading", "flagged", "accuracy")


_ABSTAIN = """SELECT *, CASE WHEN setting = 'open' THEN "leading" IS NULL ELSE coalesce("leading" = grp, FALSE) END AS accuracy FROM (
SELECT t.*, g.k, g.i, CASE WHEN hard >= k THEN top END AS "leading" FROM wtop t, (SELECT i, round(0.1 + 0.02 * i, 2)::DOUBLE AS k FROM generate_series(0, 20) q(i)) g)"""


@query(f"""SELECT y.case_id, y.setting, y.grp, y.k AS chosen, y."leading", y.accuracy FROM ({_ABSTAIN}) y
JOIN ({_BEST.format(a="closed", b="open", x=_ABSTAIN)}) b ON b.fold = y.fold AND b.k = y.k""")
def abstention_crossfit(spark, sf_dir):
    """Abstention at the threshold that did best on the other fold of groups."""
    x = protocols.crossfit(_rank_table(spark, sf_dir), protocols.abstain, TAUS, ("closed", "open"))
    return x.select("case_id", "setting", "grp", "chosen", "leading", "accuracy")


@query("""SELECT i::INT AS i, tau, round(avg((coalesce(hard >= tau, FALSE) AND top = grp)::INT) FILTER (setting = 'closed'), 9) AS closed_accuracy,
round(avg((hard < tau)::INT) FILTER (setting = 'open'), 9) AS open_declined FROM wtop, (SELECT i, round(0.005 * i, 3)::DOUBLE AS tau FROM generate_series(0, 160) q(i)) g GROUP BY 1, 2""")
def abstention_frontier(spark, sf_dir):
    """Accuracy when the group is there against declining when it is not, at 161 thresholds."""
    return protocols.frontier(_rank_table(spark, sf_dir), FINE_TAUS).select("i", "tau", *r9("closed_accuracy", "open_declined"))


@query("""SELECT method, setting, incident_id, round(p, 9) AS p, round((p - correct::INT) * (p - correct::INT), 9) AS sq, NOT correct AND p >= 0.8 AS overconfident FROM (
SELECT o.*, (coalesce(c.h, 0) + b.base) / (coalesce(c.n, 0) + 1) AS p FROM (SELECT *, CAST(substr(grp, 2) AS BIGINT) % 2 AS fold, least(floor(probability * 10), 9) AS bin FROM wout WHERE setting IN ('closed', 'open', 'false_flag')) o
JOIN (SELECT method, 1 - CAST(substr(grp, 2) AS BIGINT) % 2 AS fold, (count(*) FILTER (correct) + 1) / (count(*) + 2) AS base FROM wout WHERE setting IN ('closed', 'open', 'false_flag') GROUP BY 1, 2) b ON b.method = o.method AND b.fold = o.fold
LEFT JOIN (SELECT method, 1 - CAST(substr(grp, 2) AS BIGINT) % 2 AS fold, least(floor(probability * 10), 9) AS bin, count(*) FILTER (correct) AS h, count(*) AS n FROM wout WHERE setting IN ('closed', 'open', 'false_flag') GROUP BY 1, 2, 3) c
ON c.method = o.method AND c.fold = o.fold AND c.bin = o.bin)""")
def pooled_records(spark, sf_dir):
    """Outcomes of three settings pooled, with cross-fitted probabilities, squared errors and overconfident errors."""
    return protocols.pooled_records(_evaluated(spark, sf_dir)).select("method", "setting", "incident_id", *r9("p", "sq"), "overconfident")


@query("""SELECT n_markers, setting, count(*) AS n, round(avg(("leading" = grp)::INT), 9) AS accuracy, round(avg((setting <> 'authentic' AND "leading" = framed)::INT), 9) AS framed_rate FROM (
SELECT n AS n_markers, s.case_id, c.setting, c.grp, c.framed, s.actor_id AS "leading", row_number() OVER (PARTITION BY n, s.case_id ORDER BY round(s.cosine + 0.15 * n * (m.actor_id IS NOT NULL)::INT, 9) DESC, a.ord) AS rank
FROM wsim s JOIN wcs c ON c.case_id = s.case_id JOIN actors a ON a.actor_id = s.actor_id LEFT JOIN wmark m ON m.case_id = s.case_id AND m.actor_id = s.actor_id, (SELECT unnest([1, 6]) AS n) q
WHERE c.setting IN ('false_flag', 'authentic', 'mimicry')) WHERE rank = 1 GROUP BY 1, 2""")
def marker_sweep(spark, sf_dir):
    """Similarity with one and with six planted markers: how often the group and the framed actor are named."""
    u = settled(bridge.uses(spark, sf_dir))
    kb, profile, actors = settled(knowledge.kb(u)), knowledge.profile_items(u), settled(knowledge.groups(u))
    w = evaluation.worlds(u, settled(incidents.report_incidents(u)), actors, kb, profile, ["false_flag", "authentic", "mimicry"])
    parts = []
    for n in (1, 6):
        marks = attribution.planted_markers(w["cases"].select("case_id", "target"), n)
        s = evaluation.world_scores(w["cases"], w["usage"], w["deltas"], profile, kb, marks)
        top = evaluation.with_rank(s, actors, w["cases"], "score").where("rank = 1").select("case_id", F.col("actor_id").alias("leading"))
        x = w["cases"].join(top, "case_id")
        framed = (F.col("setting") != "authentic") & (F.col("leading") == F.col("framed"))
        rate = lambda c: F.round(F.avg(c.cast("double")), 9)
        parts.append(x.groupBy(F.lit(n).alias("n_markers"), "setting").agg(
            F.count(F.lit(1)).alias("n"), rate(F.col("leading") == F.col("grp")).alias("accuracy"), rate(framed).alias("framed_rate")
        ))
    return evaluation.union(parts)


GRID = [(c, r) for c in (0.1, 0.15, 0.2) for r in (5, 13, 20)]


def _grid_sql() -> str:
    """The static assessment at each pair of thresholds."""
    parts = []
    for c, r in GRID:
        one = sql("SELECT leading_kind, confidence, count(*) AS n FROM graded GROUP BY 1, 2")
        one = one.replace("n_groups * 0.15", f"n_groups * {c}").replace("BETWEEN 1 AND 13", f"BETWEEN 1 AND {r}")
        parts.append(f"SELECT {c}::DOUBLE AS common_frac, {r} AS rare_max, * FROM ({one})")
    return " UNION ALL ".join(parts)


@query(_grid_sql())
def sensitivity_grid(spark, sf_dir):
    """ACH at a grid of common and rare thresholds: all pairs in one plan, the pair being part of the case."""
    w = static_world(spark, sf_dir)
    grid = spark.createDataFrame([(i, *g) for i, g in enumerate(GRID)], "v int, common_frac double, rare_max int")
    case = F.concat_ws("@", "case_id", F.col("v").cast("string")).alias("case_id")
    flags = w["kb"].crossJoin(F.broadcast(grid)).select(
        F.col("v"), "item_id", (F.col("usage") >= F.col("n_groups") * F.col("common_frac")).alias("is_common"), F.col("usage").between(1, F.col("rare_max")).alias("is_rare")
    )
    items = w["items"].crossJoin(F.broadcast(grid.select("v")))
    flags = items.join(flags, ["v", "item_id"]).select(case, "item_id", "is_common", "is_rare")
    spread = lambda t: t.crossJoin(F.broadcast(grid.select("v"))).withColumn("case_id", F.concat_ws("@", "case_id", F.col("v").cast("string"))).drop("v")
    evidence = attribution.evidence_from_items(spread(w["items"]), settled(flags), ["case_id", "item_id"]).unionByName(spread(w["markers"]))
    a = ach.assess(settled(evidence), settled(spread(w["candidates"])), _facets(w["profile"]))["assessments"]
    a = a.withColumn("v", F.substring_index("case_id", "@", -1).cast("int")).join(F.broadcast(grid), "v")
    return a.groupBy("common_frac", "rare_max", "leading_kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


_KNOWN = "(SELECT DISTINCT target AS item_id FROM uses WHERE reference <= '2024-01-15' UNION SELECT DISTINCT split_part(target, '.', 1) FROM uses WHERE reference <= '2024-01-15')"


@query(f"""SELECT incident_id, count(*) AS n_items, count(*) FILTER (way = 'known') AS n_known, count(*) FILTER (way = 'revoked') AS n_revoked, count(*) FILTER (way = 'parent') AS n_parent,
count(*) FILTER (way = 'dropped') AS n_dropped, count(DISTINCT new) >= 4 AS kept FROM (SELECT x.incident_id, CASE WHEN k.item_id IS NOT NULL THEN 'known' WHEN o.item_id IS NOT NULL THEN 'revoked' WHEN p.item_id IS NOT NULL THEN 'parent' ELSE 'dropped' END AS way,
coalesce(k.item_id, o.item_id, p.item_id) AS new FROM (SELECT DISTINCT i.incident_id, u.target AS item_id, CASE WHEN u.target LIKE '%.9' THEN left(u.target, length(u.target) - 1) || '8' END AS older
FROM incidents i JOIN uses u ON u.source = i.grp AND u.reference = i.reference WHERE i.reference > '2024-01-15') x LEFT JOIN {_KNOWN} k ON k.item_id = x.item_id LEFT JOIN {_KNOWN} o ON o.item_id = x.older
LEFT JOIN {_KNOWN} p ON p.item_id = split_part(x.item_id, '.', 1) AND x.item_id LIKE '%.%') GROUP BY 1""")
def id_remap(spark, sf_dir):
    """Items of incidents after a day in terms of what was known by it; sub-technique 9 counts as what was 8."""
    u = bridge.uses(spark, sf_dir)
    inc = incidents.report_incidents(u, max_per_group=None).where("reference > '2024-01-15'")
    old = u.where("reference <= '2024-01-15'").select(F.col("target").alias("item_id"))
    known = old.union(old.select(parent_of(F.col("item_id"))))
    revoked = u.where("target like '%.9'").select(F.col("target").alias("item_id"), F.regexp_replace("target", "9$", "8").alias("older")).distinct()
    return protocols.remap(incidents.incident_items(u, inc), known, revoked)[1]


@query("SELECT incident_id, grp, n_items FROM incidents ORDER BY md5('7:' || incident_id), incident_id LIMIT 50")
def sampled_incidents(spark, sf_dir):
    """A seeded sample of fifty incidents."""
    return protocols.sampled(incidents.report_incidents(bridge.uses(spark, sf_dir), max_per_group=None), 50, 7).select("incident_id", "grp", "n_items")


@query("""SELECT item_id, to_json({'id': item_id, 'kind': kind, 'parent': parent, 'usage': usage, 'common': is_common, 'rare': is_rare})::VARCHAR AS line FROM kb""")
def compact_kb(spark, sf_dir):
    """The knowledge base in its compact form, a JSON line an item."""
    return sinks.compact_kb(knowledge.kb(bridge.uses(spark, sf_dir)))


# --- calibration, metrics, intervals ------------------------------------------------------------------------------------------


@query("SELECT round(avg((p - correct::INT) * (p - correct::INT)), 9) AS brier FROM outc")
def brier(spark, sf_dir):
    return metrics.brier(bridge.outcomes(spark, sf_dir)).select(*r9("brier"))


@query("SELECT least(floor(p * 10), 9)::INT AS bin, round(avg(p), 9) AS mean_p, round(avg(correct::INT), 9) AS accuracy, count(*) AS n FROM outc GROUP BY 1")
def reliability_bins(spark, sf_dir):
    return metrics.reliability(bridge.outcomes(spark, sf_dir)).select("bin", *r9("mean_p", "accuracy"), "n")


@query("SELECT round(sum(n * abs(mp - acc)) / sum(n), 9) AS ece FROM (SELECT least(floor(p * 10), 9) AS b, avg(p) AS mp, avg(correct::INT) AS acc, count(*) AS n FROM outc GROUP BY 1)")
def expected_calibration_error(spark, sf_dir):
    return metrics.ece(bridge.outcomes(spark, sf_dir)).select(*r9("ece"))


@query("""SELECT o.id, round((coalesce(c.h, 0) + b.base) / (coalesce(c.n, 0) + 1), 9) AS p_cal FROM outc o
JOIN (SELECT 1 - fold AS fold, (count(*) FILTER (correct) + 1) / (count(*) + 2) AS base FROM outc GROUP BY fold) b ON b.fold = o.fold
LEFT JOIN (SELECT 1 - fold AS fold, least(floor(p * 10), 9) AS bin, count(*) FILTER (correct) AS h, count(*) AS n FROM outc GROUP BY fold, 2) c ON c.fold = o.fold AND c.bin = least(floor(o.p * 10), 9)""")
def hist_crossfit(spark, sf_dir):
    return calibration.histogram_crossfit(bridge.outcomes(spark, sf_dir)).select("id", *r9("p_cal"))


_GRADED = "SELECT *, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.55 THEN 'moderate' ELSE 'low' END AS grade FROM outc"


@query(f"""SELECT fold, round(least(p0, (p0*w0+p1*w1)/(w0+w1), (p0*w0+p1*w1+p2*w2)/(w0+w1+w2)), 9) AS low,
round(greatest(least(p1, (p1*w1+p2*w2)/(w1+w2)), least((p0*w0+p1*w1)/(w0+w1), (p0*w0+p1*w1+p2*w2)/(w0+w1+w2))), 9) AS moderate,
round(greatest(p2, (p1*w1+p2*w2)/(w1+w2), (p0*w0+p1*w1+p2*w2)/(w0+w1+w2)), 9) AS high FROM (
SELECT fold, (count(*) FILTER (correct AND grade='low') + 1) / (count(*) FILTER (grade='low') + 2) AS p0, count(*) FILTER (grade='low') + 2 AS w0,
(count(*) FILTER (correct AND grade='moderate') + 1) / (count(*) FILTER (grade='moderate') + 2) AS p1, count(*) FILTER (grade='moderate') + 2 AS w1,
(count(*) FILTER (correct AND grade='high') + 1) / (count(*) FILTER (grade='high') + 2) AS p2, count(*) FILTER (grade='high') + 2 AS w2 FROM ({_GRADED}) g GROUP BY 1)""")
def grade_calibration(spark, sf_dir):
    from cairnspark.functions.domain import grade_of

    x = bridge.outcomes(spark, sf_dir).withColumn("grade", grade_of(F.col("p")))
    return calibration.grade_map(x, "fold").select("fold", *r9("low", "moderate", "high"))


_TAU = "(SELECT i, round(0.1 + 0.02 * i, 2)::DOUBLE AS tau FROM generate_series(0, 20) t(i))"


@query(f"""SELECT i::INT AS i, tau, round(avg((p >= tau)::INT), 9) AS answered, round(count(*) FILTER (p >= tau AND correct) / nullif(count(*) FILTER (p >= tau), 0), 9) AS accuracy,
round(count(*) FILTER (p >= tau AND correct) / count(*), 9) AS right FROM outc, (SELECT i, round(0.005 * i, 3)::DOUBLE AS tau FROM generate_series(0, 160) t(i)) g GROUP BY 1, 2""")
def abstain_frontier(spark, sf_dir):
    return calibration.abstention(bridge.outcomes(spark, sf_dir), FINE_TAUS).select("i", "tau", *r9("answered", "accuracy", "right"))


@query(f"""SELECT fold, tau, round(worth / n, 9) AS worth FROM (SELECT s.*, row_number() OVER (PARTITION BY 1) AS z FROM (SELECT fold, i, tau, sum(CASE WHEN p < tau THEN 0 WHEN correct THEN 1 ELSE -1 END) AS worth, count(*) AS n
FROM outc, {_TAU} g GROUP BY 1, 2, 3) s) a JOIN (SELECT 1 - fold AS f2, i AS i2 FROM (SELECT fold, i, row_number() OVER (PARTITION BY fold ORDER BY sum(CASE WHEN p < tau THEN 0 WHEN correct THEN 1 ELSE -1 END) DESC, i) AS rn
FROM outc, {_TAU} g GROUP BY fold, i) WHERE rn = 1) b ON a.fold = b.f2 AND a.i = b.i2""")
def crossfit_tau(spark, sf_dir):
    return calibration.crossfit_threshold(bridge.outcomes(spark, sf_dir), TAUS).select("fold", "tau", *r9("worth"))


def _gold(spark, sf_dir):
    d = bridge.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    gold = d.select("doc_id", F.explode(F.array("lang", "source")).alias("label"))
    guess = F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang"))
    src = F.concat(F.lit("src"), (F.col("doc_id") % 20 + F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0)).cast("string"))
    return gold, d.select("doc_id", F.explode(F.array(guess, src)).alias("label"))


_F = "coalesce(2 * p * r / nullif(p + r, 0), 0)"


@query(f"""SELECT average, round(p, 9) AS precision, round(r, 9) AS recall, round({_F}, 9) AS f FROM (SELECT 'micro' AS average, sum(tp) / (sum(tp) + sum(fp)) AS p, sum(tp) / (sum(tp) + sum(fn)) AS r FROM lcount)
UNION ALL SELECT 'macro', round(avg(p), 9), round(avg(r), 9), round(avg({_F}), 9) FROM (SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM lcount WHERE tp + fn > 0)""")
def prf_micro_macro(spark, sf_dir):
    return metrics.micro_macro(*_gold(spark, sf_dir))


_F5 = "coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0)"


@query(f"""SELECT average, round(p, 9) AS precision, round(r, 9) AS recall, round({_F5}, 9) AS f FROM (SELECT 'micro' AS average, sum(tp) / (sum(tp) + sum(fp)) AS p, sum(tp) / (sum(tp) + sum(fn)) AS r FROM lcount)
UNION ALL SELECT 'macro', round(avg(p), 9), round(avg(r), 9), round(avg({_F5}), 9) FROM (SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM lcount)""")
def fbeta(spark, sf_dir):
    return metrics.micro_macro(*_gold(spark, sf_dir), beta=0.5, all_labels=True)


@query("SELECT label, tp + fn AS support, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM lcount WHERE tp + fn > 0")
def per_label_f1(spark, sf_dir):
    return metrics.per_label_f1(*_gold(spark, sf_dir))


@query("""SELECT round(pur, 9) AS purity, round(mi / ((ht + hp) / 2), 9) AS nmi, round((same - pt * pp / (n * (n - 1) / 2.0)) / ((pt + pp) / 2 - pt * pp / (n * (n - 1) / 2.0)), 9) AS ari, k AS n_clusters FROM
(SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS same FROM ctab) a, (SELECT sum(m) / (SELECT sum(n) FROM ctab) AS pur, count(*) AS k FROM (SELECT predicted, max(n) AS m FROM ctab GROUP BY 1)),
(SELECT sum(n * (n - 1) / 2.0) AS pt, -sum(n / t * ln(n / t)) AS ht FROM (SELECT truth, sum(n) AS n, (SELECT sum(n) FROM ctab) AS t FROM ctab GROUP BY 1)),
(SELECT sum(n * (n - 1) / 2.0) AS pp, -sum(n / t * ln(n / t)) AS hp FROM (SELECT predicted, sum(n) AS n, (SELECT sum(n) FROM ctab) AS t FROM ctab GROUP BY 1)),
(SELECT sum(c.n / t * ln(c.n * t / (x.n * y.n))) AS mi FROM ctab c JOIN (SELECT truth, sum(n) AS n FROM ctab GROUP BY 1) x ON x.truth = c.truth
 JOIN (SELECT predicted, sum(n) AS n FROM ctab GROUP BY 1) y ON y.predicted = c.predicted, (SELECT sum(n) AS t FROM ctab))""")
def partition_scores(spark, sf_dir):
    return metrics.partition_scores(bridge.partitions(spark, sf_dir))


@query("""SELECT grp, hits, n, round(greatest((p + 1.9208 / n) / d - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) / d, 0), 9) AS low,
round(least((p + 1.9208 / n) / d + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) / d, 1), 9) AS high FROM (
SELECT grp, count(*) FILTER (correct) AS hits, count(*) AS n, count(*) FILTER (correct) / count(*) AS p, 1 + 3.8416 / count(*) AS d FROM outc GROUP BY 1)""")
def wilson_ci(spark, sf_dir):
    return intervals.wilson_by(bridge.outcomes(spark, sf_dir), "grp")


@query("""SELECT grp, b AS only_a, c AS only_b, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0)))
FROM generate_series(0, least(b, c)) t(i)) / pow(2.0, b + c)), 9) END AS p FROM (SELECT grp, count(*) FILTER (correct AND NOT correct2) AS b, count(*) FILTER (NOT correct AND correct2) AS c FROM outc GROUP BY 1)""")
def mcnemar(spark, sf_dir):
    return intervals.mcnemar_test(bridge.outcomes(spark, sf_dir), "correct", "correct2", "grp")


@query(f"""SELECT round(est, 9) AS estimate, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT max(CASE WHEN k = {int(0.025 * DRAWS) + 1} THEN r END) AS low, max(CASE WHEN k = {int(0.975 * DRAWS)} THEN r END) AS high FROM (
SELECT r, row_number() OVER (ORDER BY r, draw) AS k FROM (SELECT d.draw, sum(g.s) / sum(g.c) AS r FROM (
SELECT draw, ('0x' || substr(md5(draw || ':' || slot), 1, 8))::BIGINT % (SELECT count(DISTINCT grp) FROM outc) AS at FROM generate_series(0, {DRAWS - 1}) a(draw), generate_series(0, (SELECT count(DISTINCT grp) FROM outc) - 1) b(slot)) d
JOIN (SELECT row_number() OVER (ORDER BY grp) - 1 AS at, count(*) FILTER (correct) AS s, count(*) AS c FROM outc GROUP BY grp) g ON g.at = d.at GROUP BY 1))), (SELECT avg(correct::INT) AS est FROM outc)""")
def cluster_bootstrap(spark, sf_dir):
    sums = intervals.group_sums(bridge.outcomes(spark, sf_dir))
    return intervals.bootstrap(sums, intervals.hashed_draws(sums.select("grp"), DRAWS), DRAWS).select(*r9("estimate", "low", "high"))


@query(f"""SELECT round(max(CASE WHEN k = {int(0.025 * DRAWS) + 1} THEN r END), 9) AS low, round(max(CASE WHEN k = {int(0.975 * DRAWS)} THEN r END), 9) AS high FROM (SELECT r, row_number() OVER (ORDER BY r, draw) AS k FROM (
SELECT d.draw, sum(g.s) / sum(g.c) - sum(g.s2) / sum(g.c) AS r FROM (
SELECT draw, ('0x' || substr(md5(draw || ':' || slot), 1, 8))::BIGINT % (SELECT count(DISTINCT grp) FROM outc) AS at FROM generate_series(0, {DRAWS - 1}) a(draw), generate_series(0, (SELECT count(DISTINCT grp) FROM outc) - 1) b(slot)) d
JOIN (SELECT row_number() OVER (ORDER BY grp) - 1 AS at, count(*) FILTER (correct) AS s, count(*) FILTER (correct2) AS s2, count(*) AS c FROM outc GROUP BY grp) g ON g.at = d.at GROUP BY 1))""")
def paired_differences(spark, sf_dir):
    """The interval of the difference of two methods' accuracies over the same resamples of groups."""
    x = bridge.outcomes(spark, sf_dir)
    a, b = intervals.group_sums(x), intervals.group_sums(x, "correct2")
    return intervals.paired_bootstrap(a, b, intervals.hashed_draws(a.select("grp"), DRAWS), DRAWS).select(*r9("low", "high"))


@query("""SELECT round(e.ari, 9) AS estimate, round(round(e.ari, 9) - 1.96 * se, 6) AS low, round(round(e.ari, 9) + 1.96 * se, 6) AS high FROM
(SELECT ari FROM rand WHERE t = -1) e, (SELECT sqrt((count(*) - 1) * var_pop(round(ari, 9))) AS se FROM rand WHERE t >= 0)""")
def jackknife_ari(spark, sf_dir):
    return intervals.jackknife(bridge.partitions(spark, sf_dir))


@query("SELECT fold, round(avg(p), 9) AS mean, round(stddev_samp(p), 9) AS sd, count(*) AS n FROM outc GROUP BY 1")
def mean_sd(spark, sf_dir):
    return intervals.mean_sd(bridge.outcomes(spark, sf_dir), "p", "fold").select("fold", *r9("mean", "sd"), "n")


# --- clustering --------------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS node, 'event' AS kind FROM bask UNION SELECT facet || ':' || value, facet FROM bask")
def diamond_nodes(spark, sf_dir):
    return clustering.diamond_nodes(bridge.baskets(spark, sf_dir))


@query("SELECT DISTINCT event_id AS a, facet || ':' || value AS b, facet FROM bask")
def diamond_edges(spark, sf_dir):
    return clustering.diamond_edges(bridge.baskets(spark, sf_dir))


@query("SELECT a, b, sim FROM jac WHERE sim >= 0.3")
def weighted_jaccard(spark, sf_dir):
    return clustering.jaccard_pairs(clustering.event_weights(bridge.baskets(spark, sf_dir)), 0.3)


def _knn(spark, sf_dir):
    return clustering.knn_edges(clustering.nearest(settled(clustering.event_weights(bridge.baskets(spark, sf_dir)))))


@query("""SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b DESC) AS k FROM
(SELECT a, b, sim FROM jac WHERE sim >= 0.05 UNION ALL SELECT b, a, sim FROM jac WHERE sim >= 0.05)) WHERE k <= 5""")
def knn_edges(spark, sf_dir):
    """The five best of each event at similarity 0.05 or more."""
    return _knn(spark, sf_dir)


def _components(spark, sf_dir):
    f = settled(clustering.event_weights(bridge.baskets(spark, sf_dir)))
    pairs = settled(clustering.jaccard_pairs(f, 0.3))
    return clustering.components(f.select("id").distinct(), pairs), f


_REACH = """reach(id, c) AS (SELECT id, id FROM tot UNION SELECT e.x, r.c FROM reach r JOIN (SELECT a AS x, b AS y FROM jac WHERE sim >= 0.3 UNION ALL SELECT b, a FROM jac WHERE sim >= 0.3) e ON e.y = r.id WHERE r.c < e.x)"""
_COMPONENTS = "SELECT id, min(c) AS component FROM (WITH RECURSIVE " + _REACH + " SELECT * FROM reach) GROUP BY 1"


@query(_COMPONENTS)
def components(spark, sf_dir):
    """Single linkage at similarity 0.3."""
    return _components(spark, sf_dir)[0]


@query(f"""SELECT * FROM (WITH comp AS MATERIALIZED ({_COMPONENTS}), size AS (SELECT component, count(*) AS n_members, string_agg(id, ',' ORDER BY id) AS members FROM comp GROUP BY 1),
common AS (SELECT component, string_agg(feature, ',' ORDER BY feature) AS shared FROM (SELECT c.component, f.feature, count(*) AS m FROM comp c JOIN fw f ON f.id = c.id GROUP BY 1, 2)
JOIN size USING (component) WHERE m = n_members AND n_members > 1 GROUP BY 1)
SELECT printf('CAMPAIGN-%02d', row_number() OVER (ORDER BY n_members DESC, component)) AS campaign, n_members, members, coalesce(shared, '') AS shared FROM size LEFT JOIN common USING (component))""")
def campaigns(spark, sf_dir):
    return clustering.campaigns(*_components(spark, sf_dir))


@query()
def communities(spark, sf_dir):
    """Multi-level communities of the five-nearest graph (tests/test_operators.py has small graphs)."""
    return clustering.communities(_knn(spark, sf_dir))


# --- extraction and sinks ------------------------------------------------------------------------------------------------------

#: A small knowledge base over the given texts' words.
KEYWORDS = [
    ("T1001", "ttp", "Reading", ["and the", "that the"]), ("T1002", "ttp", "Contempt", ["worthless", "pathetic"]), ("T1003.001", "ttp", "Conjunction", ["und der", "et de"]),
    ("S0001", "tool", "Nicht", ["Nicht"]), ("S0002", "tool", "Que", ["Que la", "por"]), ("S0003", "tool", "Ing", ["ing", "Was"]),
]


def keyword_kb(spark):
    rows = [(i, t, n, k, o) for o, (i, t, n, k) in enumerate(KEYWORDS)]
    return spark.createDataFrame(rows, "item_id string, item_type string, name string, keywords array<string>, ord int")


def _keyword_sql() -> str:
    parts = []
    for item, _, _, words in KEYWORDS:
        tests = []
        for w in words:
            flag = "" if any(c.isupper() for c in w) else "(?i)"
            tests.append(f"WHEN regexp_matches(text, '{flag}(^|[^A-Za-z0-9]){w}([^A-Za-z0-9]|$)') THEN '{w}'")
        parts.append(f"SELECT doc_id, '{item}' AS item_id, CASE {' '.join(tests)} END AS matched FROM documents")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE matched IS NOT NULL"


def _hits(spark, sf_dir):
    return extraction.keyword_hits(bridge.table(spark, sf_dir, "documents").select("doc_id", "text"), keyword_kb(spark))


@query(_keyword_sql())
def keyword_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "item_id", "matched")


def _ioc_sql() -> str:
    """Matches laid end to end give offsets; then each type in order of precedence keeps what overlaps nothing kept before."""
    parts = []
    for i, (name, pattern) in enumerate(extraction.INDICATORS):
        p = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {i} AS k, '{name}' AS type, regexp_extract_all(c, '{p}') AS hits, regexp_split_to_array(c, '{p}') AS gaps FROM clean")
    steps = []
    for i in range(len(extraction.INDICATORS)):
        before = f"SELECT * FROM kept{i - 1}" if i else "SELECT * FROM places WHERE FALSE"
        steps.append(f"kept{i} AS MATERIALIZED ({before} UNION ALL SELECT * FROM places p WHERE k = {i} AND NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.doc_id = p.doc_id AND b.a < p.b AND b.b > p.a))")
    return rf"""WITH clean AS (SELECT doc_id, text, regexp_replace(replace(text, '[.]', '.'), 'hxxp', 'http', 'gi') AS c FROM documents WHERE text IS NOT NULL),
found AS (SELECT doc_id, k, type, unnest(hits) AS value, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS place FROM ({" UNION ALL ".join(parts)}) WHERE len(hits) > 0),
ends AS (SELECT *, sum(length(value) + length(gap)) OVER (PARTITION BY doc_id, k ORDER BY place) AS b FROM found),
places AS (SELECT doc_id, k, type, value, b - length(value) AS a, b FROM ends), {", ".join(steps)},
pieces AS (SELECT doc_id, unnest(string_split(text, '[.]')) AS piece, unnest(range(len(string_split(text, '[.]')))) AS place FROM clean WHERE contains(text, '[.]')),
dots AS (SELECT doc_id, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY place) AS behind, place < max(place) OVER (PARTITION BY doc_id) AS real FROM pieces),
shifted AS (SELECT p.*, (SELECT count(*) FROM dots d WHERE d.doc_id = p.doc_id AND d.real AND d.behind <= p.a) AS da, (SELECT count(*) FROM dots d WHERE d.doc_id = p.doc_id AND d.real AND d.behind <= p.b - 1) AS db FROM kept{len(steps) - 1} p)
SELECT s.doc_id, type, regexp_replace(value, '[.,);\]]+$', '') AS value, (a + 2 * da)::INT AS "start", (b + 2 * db)::INT AS "end", substr(text, (a + 2 * da + 1)::BIGINT, (b + 2 * db - a - 2 * da)::BIGINT) AS text,
(row_number() OVER (PARTITION BY s.doc_id ORDER BY k, a) - 1)::INT AS pos FROM shifted s JOIN documents d ON d.doc_id = s.doc_id"""


@query(_ioc_sql())
def ioc_spans(spark, sf_dir):
    """Every indicator with its span in the original text."""
    return extraction.indicators(bridge.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b')) AS value FROM documents")
def ioc_ipv4(spark, sf_dir):
    return extraction.indicators(bridge.table(spark, sf_dir, "documents").select("doc_id", "text")).where("type = 'ipv4'").select("doc_id", "value")


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\b[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,10}\b')) AS value FROM documents")
def ioc_email(spark, sf_dir):
    return extraction.indicators(bridge.table(spark, sf_dir, "documents").select("doc_id", "text")).where("type = 'email'").select("doc_id", "value")


@query(r"""SELECT doc_id, s AS sentence, count(*) AS n FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\n|$)')), E' \t\n\r') AS s FROM documents) WHERE length(s) >= 20 GROUP BY 1, 2""")
def sentences(spark, sf_dir):
    d = bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    return extraction.sentences(d).groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query()
def navigator_layers(spark, sf_dir):
    return sinks.navigator(_hits(spark, sf_dir))


@query()
def stix_objects(spark, sf_dir):
    d = bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sinks.stix_objects(extraction.keyword_hits(d, keyword_kb(spark)), extraction.indicators(d))


@query("""SELECT DISTINCT line FROM (SELECT 'MERGE (:Event {id: ''' || event_id || '''});' AS line FROM bask UNION ALL
SELECT 'MERGE (e:Event {id: ''' || event_id || '''}) MERGE (f:' || CASE facet WHEN 'capability' THEN 'Capability' WHEN 'infrastructure' THEN 'Infrastructure' ELSE 'Victim' END
|| ' {value: ''' || replace(value, '''', '\\''') || '''}) MERGE (e)-[:HAS]->(f);' FROM bask)""")
def cypher_lines(spark, sf_dir):
    return sinks.cypher(bridge.baskets(spark, sf_dir))


@query()
def classifier_labels(spark, sf_dir):
    """Languages of all documents by a classifier fitted on the labelled ones (tests/test_operators.py has small texts)."""
    from cairnspark.operators.ml import Classifier

    d = bridge.table(spark, sf_dir, "documents").where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").alias("label"))
    some = d.join(bridge.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return Classifier.fit(some.select("doc_id", "text"), some.select("doc_id", "label")).predict(d.select("doc_id", "text"))


@query("""SELECT report_id, grp, tier FROM (SELECT report_id, tier, count(DISTINCT grp) AS n, min(grp) AS grp, row_number() OVER (PARTITION BY report_id ORDER BY tier) AS rn FROM
(SELECT page_id AS report_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS t FROM pages) p JOIN
(SELECT 'N' || n_nationkey AS grp, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS alias, 'group' AS tier FROM nation
 UNION ALL SELECT min('H' || ord), alias, 'software' FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS name, regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '[^a-z0-9]', '', 'g') AS alias, min(page_id) AS ord
  FROM pages GROUP BY 1) GROUP BY alias HAVING count(*) = 1) v ON contains(p.t, v.alias) AND length(v.alias) >= 5 AND NOT regexp_full_match(v.alias, '[0-9]+') GROUP BY 1, 2) WHERE rn = 1 AND n = 1""")
def report_labels(spark, sf_dir):
    """Pages labelled by the one nation, or else the one host, that their address names."""
    nation = bridge.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("grp"), F.col("n_name").alias("name"), F.lit("group").alias("tier"), F.col("n_nationkey").cast("long").alias("ord"))
    host = bridge.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("name"), "page_id")
    host = host.groupBy("name").agg(F.min("page_id").alias("ord")).select(F.concat(F.lit("H"), F.col("ord")).alias("grp"), "name", F.lit("software").alias("tier"), "ord")
    pages = bridge.table(spark, sf_dir, "pages").select(F.col("page_id").alias("report_id"), F.col("url").alias("title"))
    return protocols.label_reports(pages, protocols.alias_vocabulary(nation.unionByName(host)))


# --- events --------------------------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'all') AS day, coalesce(event_type, 'all') AS event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d'), event_type), (strftime(ts, '%Y-%m-%d')), ())""")
def daily_event_rollup(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    g = e.rollup("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.coalesce("day", F.lit("all")).alias("day"), F.coalesce("event_type", F.lit("all")).alias("event_type"), "n", "total")


@query("""SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).select("user_id", "started", "n")
