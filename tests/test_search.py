"""Search by blocks against the table of all pairs."""

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import attribution, evaluation, incidents, knowledge, protocols, search
from cairnspark.plans import catalogue
from cairnspark.sources import bridge


def _rows(df, *names):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(search, "ACTORS", 4)  # several blocks of actors


def test_worlds_searched_in_blocks(spark, sf_dir, small_blocks, monkeypatch):
    u = bridge.uses(spark, sf_dir).localCheckpoint()
    kb, profile, actors = knowledge.kb(u).localCheckpoint(), knowledge.profile_items(u), knowledge.groups(u).localCheckpoint()
    w = evaluation.worlds(u, incidents.report_incidents(u), actors, kb, profile)
    scores = evaluation.world_scores(w["cases"], w["usage"], w["deltas"], profile, kb, w["markers"]).localCheckpoint()
    found = evaluation.world_search(w, profile, kb, actors, ("cosine", "coverage", "score"), 8, 0.05)
    for by in ("score", "coverage"):
        ranked = evaluation.with_rank(scores, actors, w["cases"], by)
        top = search.tops(found, actors, by)
        assert _rows(top, "case_id", "actor_id", "rank") == _rows(ranked.where("rank <= 8"), "case_id", "actor_id", "rank")
        old, new = evaluation.simple_attribution(ranked, w["cases"], actors, by, "m"), evaluation.searched_attribution(found, w["cases"], actors, by, "m")
        assert _rows(old, "case_id", "leading", "probability", "top5") == _rows(new, "case_id", "leading", "probability", "top5")
    ranked = evaluation.with_rank(scores, actors, w["cases"], "cosine")
    old, new = protocols.rank_table(ranked, w["cases"]), protocols.searched_ranks(found, w["cases"], actors)
    names = ["case_id", F.coalesce("visible", F.lit("")), "top", "hard", F.coalesce("place", F.lit(0))]
    assert _rows(old, *names) == _rows(new, *names)
    old, new = evaluation.world_candidates(w, scores, actors), evaluation.searched_candidates(w, found, actors)
    assert _rows(old, "case_id", "actor_id", "ord") == _rows(new, "case_id", "actor_id", "ord")


def test_shortlist_needs_no_table_of_pairs(spark, sf_dir, small_blocks, monkeypatch):
    def all_pairs(*_):
        raise AssertionError("all pairs of cases and actors")

    monkeypatch.setattr(attribution, "similarity", all_pairs)
    w = catalogue.static_world(spark, sf_dir)
    got = _rows(w["candidates"], "case_id", "actor_id")
    monkeypatch.undo()
    assert got == _rows(attribution.shortlist(w["sims"], w["actors"], 8, w["markers"]), "case_id", "actor_id")
