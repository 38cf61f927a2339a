"""Small cases with hand-computed results."""

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import domain
from cairnspark.functions import ranking
from cairnspark.operators import ach, calibration, clustering, extraction, incidents, intervals, metrics, protocols, sinks
from cairnspark.sources import readers


def one(df):
    return df.collect()[0]


def test_uuid5_equals_python(spark):
    names = ["a", "indicator:ipv4:1.2.3.4", "é😀"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(domain.uuid5(sinks.NAMESPACE, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(sinks.NAMESPACE), n)) for n in names]


def test_defanged_spans(spark):
    text = "see 198[.]51.100.47 and hxxp://bad[.]example/x, mail a.b@c.org 10.0.0.1."
    rows = {r["type"]: r for r in extraction.indicators(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    ip = [r for r in extraction.indicators(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("type = 'ipv4'").orderBy("start").collect()]
    assert [r["value"] for r in ip] == ["198.51.100.47", "10.0.0.1"]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows.values())
    assert rows["url"]["value"] == "http://bad.example/x" and "domain" not in rows
    assert text[ip[0]["start"] : ip[0]["end"]] == "198[.]51.100.47"


def test_keywords_are_whole_words_and_first_in_list(spark):
    kb = spark.createDataFrame([("T1", "ttp", "x", ["shell", "power"], 0), ("S1", "tool", "y", ["Mimi"], 1)], "item_id string, item_type string, name string, keywords array<string>, ord int")
    docs = spark.createDataFrame([(1, "power Shell"), (2, "shellcode mimi"), (3, "a Mimi")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched, r.start) for r in extraction.keyword_hits(docs, kb).collect()}
    assert got == {(1, "T1", "shell", 6), (3, "S1", "Mimi", 2)}


def test_crafted_text_is_linear(spark):
    import time

    schema = "doc_id long, text string"
    extraction.indicators(spark.createDataFrame([(0, "1.2.3.4")], schema)).collect()
    begun = time.time()
    assert extraction.indicators(spark.createDataFrame([(1, "a." * 100_000)], schema)).count() >= 0
    many = " ".join(f"10.0.{i // 256}.{i % 256}" for i in range(20_000))
    assert extraction.indicators(spark.createDataFrame([(1, many)], schema)).count() == 20_000
    assert time.time() - begun < 15
    mixed = " ".join(f"u{i}@mail{i}[.]example.com hxxp://h{i}[.]example.org/x, 10.1[.]2.3" for i in range(40_000))
    got = extraction.indicators(spark.createDataFrame([(1, mixed)], schema)).groupBy("type").count().collect()
    assert {r.type: r["count"] for r in got} == {"email": 40_000, "url": 40_000, "ipv4": 40_000}
    assert time.time() - begun < 60


def _case(spark, rows):
    schema = "case_id string, evidence_id string, ord int, kind string, value string, points_to array<string>, spoofable boolean, base_weight double, is_common boolean, is_rare boolean"
    return spark.createDataFrame([("c", f"E{i}", i, k, v, p, s, 1.0, c, r) for i, (k, v, p, s, c, r) in enumerate(rows)], schema)


def test_rating_table(spark):
    ev = _case(spark, [
        ("ttp", "T1.1", [], False, False, True), ("ttp", "T1.2", [], False, False, False), ("ttp", "T9", [], False, False, False), ("ttp", "T9", [], False, True, False),
        ("tool", "S1", [], False, False, False), ("tool", "S9", [], False, True, False), ("claim", "", ["A"], True, False, False), ("infrastructure", "x", ["B"], False, False, False),
    ])
    cand = spark.createDataFrame([("c", "A", 0), ("c", "B", 1)], "case_id string, actor_id string, ord int")
    prof = spark.createDataFrame([("A", "ttp", "T1.1", "T1"), ("A", "tool", "S1", "S1"), ("B", "ttp", "T7", "T7")], "actor_id string, facet string, value string, parent string")
    got = {(r.evidence_id, r.actor_id): r.rating for r in ach.actor_cells(ev, cand, prof).collect()}
    assert [got[f"E{i}", "A"] for i in range(8)] == [2, 0, -1, 0, 2, 0, 1, -2]
    assert [got[f"E{i}", "B"] for i in range(8)] == [-1, -1, -1, 0, -1, 0, -1, 2]


def test_override_to_neutral_counts(spark):
    ev = _case(spark, [("tool", "S1", [], False, False, False), ("tool", "S2", [], False, False, False)])
    cand = spark.createDataFrame([("c", "A", 0), ("c", "B", 1)], "case_id string, actor_id string, ord int")
    prof = spark.createDataFrame([("A", "tool", "S1", "S1"), ("A", "tool", "S2", "S2")], "actor_id string, facet string, value string, parent string")
    over = spark.createDataFrame([("c", *ach.parse_override("E0:A=n"))], "case_id string, evidence_id string, hyp_id string, rating string")
    cells = ach.assess(ev, cand, prof, overrides=over)["cells"]
    assert cells.where("evidence_id = 'E0' and hyp_id = 'A'").first().rating == 0
    bad = over.withColumn("rating", F.lit("maybe"))
    with pytest.raises(Exception, match="unknown rating"):
        ach.assess(ev, cand, prof, overrides=bad)["cells"].collect()


def test_brier_ece_mcnemar_wilson(spark):
    x = spark.createDataFrame([(0.5, True)], "p double, correct boolean")
    assert one(metrics.brier(x))[0] == 0.25
    y = spark.createDataFrame([(0.9, False)] * 10, "p double, correct boolean")
    assert one(metrics.ece(y))[0] == pytest.approx(0.9)
    p = spark.range(1).select(domain.mcnemar(F.lit(2), F.lit(8)).alias("p"), domain.mcnemar(F.lit(0), F.lit(0)).alias("q"))
    assert one(p)[0] == pytest.approx(2 * sum(math.comb(10, i) for i in range(3)) / 2**10) and one(p)[1] == 1
    w = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", domain.wilson(F.lit(0), F.lit(0)), strict=True)])
    assert tuple(one(w)) == (0.0, 1.0)


def test_perfect_partition(spark):
    x = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "truth int, predicted int")
    r = one(metrics.partition_scores(x))
    assert (r.purity, r.nmi, r.ari) == (1.0, 1.0, 1.0)
    single = spark.createDataFrame([(0, 0)] * 3, "truth int, predicted int")
    assert one(metrics.partition_scores(single)).nmi == 1.0


def test_monotone_pooling(spark):
    rows = [("low", True)] * 8 + [("low", False)] * 2 + [("moderate", False)] * 4 + [("high", True)] * 4
    m = one(calibration.grade_map(spark.createDataFrame(rows, "grade string, correct boolean")))
    pooled = (9 + 1) / (12 + 6)
    assert (m.low, m.moderate) == (pytest.approx(pooled), pytest.approx(pooled)) and m.high == pytest.approx(5 / 6)


def test_seeded_bootstrap_bounds(spark):
    x = spark.createDataFrame([(f"g{i}", i, 10) for i in range(5)], "grp string, s int, c int")
    r = one(intervals.bootstrap(x, intervals.seeded_draws(spark, [f"g{i}" for i in range(5)], 200, 1), 200))
    assert r.estimate == pytest.approx(0.2) and r.low < 0.2 < r.high


def test_jaccard_prefix_filter_is_exact(spark):
    import random

    rng = random.Random(3)
    rows = [(f"e{i}", f"f{j}", rng.choice([0.5, 1.0, 2.0])) for i in range(40) for j in rng.sample(range(15), 5)]
    w = {f: v for _, f, v in rows}
    rows = [(i, f, w[f]) for i, f, _ in rows]
    sets = {}
    for i, f, v in rows:
        sets.setdefault(i, {})[f] = v
    want = set()
    for a in sets:
        for b in sets:
            if a < b:
                low = sum(v for f, v in sets[a].items() if f in sets[b])
                sim = low / (sum(sets[a].values()) + sum(sets[b].values()) - low)
                if round(sim, 9) >= 0.4:
                    want.add((a, b, round(sim, 9)))
    got = {tuple(r) for r in clustering.jaccard_pairs(spark.createDataFrame(rows, "id string, feature string, w double"), 0.4).collect()}
    assert got == want


def test_communities_find_two_groups(spark):
    e = [(f"a{i}", f"a{j}", 1.0) for i in range(4) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(4) for j in range(i)] + [("a0", "b0", 0.1)]
    e = [(min(a, b), max(a, b), s) for a, b, s in e]
    got = {r.id: r.community for r in clustering.communities(spark.createDataFrame(e, "a string, b string, sim double")).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and len(set(got.values())) == 2


def test_bundle(spark, tmp_path):
    ref = lambda i: [{"source_name": "mitre-attack", "external_id": i}]
    objects = [
        {"type": "attack-pattern", "id": "a1", "name": "Alpha", "external_references": ref("T1"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "run"}], "description": "x [l](u) (Citation: z)  y"},
        {"type": "attack-pattern", "id": "a2", "name": "Old", "revoked": True, "external_references": ref("T2")},
        {"type": "intrusion-set", "id": "g1", "name": "G", "aliases": ["G", "H"], "external_references": ref("G1")},
        {"type": "malware", "id": "s1", "name": "Tool", "x_mitre_aliases": ["Tool", "Tl"], "external_references": ref("S1")},
        {"type": "campaign", "id": "c1", "name": "C", "external_references": ref("C1")},
        {"type": "relationship", "id": "r1", "relationship_type": "uses", "source_ref": "g1", "target_ref": "a1", "external_references": [{"source_name": "R1"}], "description": "did"},
        {"type": "relationship", "id": "r2", "relationship_type": "uses", "source_ref": "g1", "target_ref": "a2"},
        {"type": "relationship", "id": "r3", "relationship_type": "attributed-to", "source_ref": "c1", "target_ref": "g1"},
    ]
    p = tmp_path / "b.json"
    p.write_text(json.dumps({"type": "bundle", "objects": objects}))
    t = readers.stix_bundle(spark, str(p))
    assert one(t["techniques"]).description == "x l y" and t["techniques"].count() == 1
    assert one(t["groups"]).aliases == ["H"]
    assert [tuple(r) for r in t["uses"].select("source", "target", "references").collect()] == [("G1", "T1", ["R1"])]
    assert tuple(one(t["attributed_to"])) == ("C1", "G1")
    assert {r.item_id: r.keywords for r in readers.kb_keywords(t, ["none"]).collect()} == {"T1": ["alpha"], "S1": ["Tool"]}
    assert readers.procedures(t).count() == 1


def test_scenario_checks(spark, tmp_path):
    known = spark.createDataFrame([("A",)], "actor_id string")
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"question": "?", "evidence": [{"id": "E1", "kind": "claim", "points_to": ["A"], "reliability": "A", "credibility": 1}]}))
    assert one(readers.scenario(spark, str(p), known)).base_weight == 1.0
    p.write_text(json.dumps({"question": "?", "evidence": [{"id": "E1", "kind": "claim", "points_to": ["Z"]}]}))
    with pytest.raises(ValueError):
        readers.scenario(spark, str(p), known)


def test_stix_closed_and_escaped(spark):
    hits = spark.createDataFrame([("d", "T1", "ttp", "n", "m", 0, 1)], "doc_id string, item_id string, item_type string, name string, matched string, start int, end int")
    iocs = spark.createDataFrame([("d", "url", "http://x/'\\", 0, 1), ("d", "cve", "CVE-2024-1234", 0, 1)], "doc_id string, type string, value string, start int, end int")
    a = spark.createDataFrame([("d", "A", "high")], "case_id string, leading string, confidence string")
    o = sinks.stix_objects(hits, iocs, a)
    assert sinks.unresolved(o).count() == 0 and o.count() == 3
    assert json.loads(o.where("type = 'indicator'").first().object)["pattern"] == "[url:value = 'http://x/\\'\\\\']"
    assert json.loads(o.where("type = 'note'").first().object)["confidence"] == 85
    assert json.loads(sinks.stix_bundles(o).first().bundle)["type"] == "bundle"


def test_cypher_escapes(spark):
    e = spark.createDataFrame([("e'1", "victim", "x\ny")], "event_id string, facet string, value string")
    lines = {r.line for r in sinks.cypher(e).collect()}
    assert "MERGE (:Event {id: 'e\\'1'});" in lines and any("x\\u000ay" in x for x in lines)
    with pytest.raises(Exception, match="unknown facet"):
        sinks.cypher(e.withColumn("facet", F.lit("other"))).collect()


def test_incident_rules(spark):
    rows = [("G1", f"T{i}", "r1") for i in range(4)] + [("G1", f"T{i}", "r2") for i in range(2, 12)] + [("G2", "T1", "r1")]
    u = spark.createDataFrame(rows, "source string, target string, reference string")
    got = {(r.grp, r.reference): (r.n_items, r.n_removed, r.n_left) for r in incidents.report_incidents(u).collect()}
    assert got == {("G1", "r1"): (4, 2, 10)}


def test_streams(spark, tmp_path, sf_dir):
    from cairnspark.streaming import reports

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("c2 at 10.1.2.3 now")
    q = reports.stream_indicators(reports.report_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["10.1.2.3"]


def test_classifier(spark):
    from cairnspark.operators.ml import Classifier, folds, tune_threshold

    texts = spark.createDataFrame([(i, "steal credential dump memory" if i % 2 else "encrypt disk ransom note") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "T1" if i % 2 else "T2") for i in range(12)], "doc_id long, label string")
    model = Classifier.fit(texts, labels)
    assert {tuple(r) for r in model.predict(texts).collect()} == {tuple(r) for r in labels.collect()}
    assert tune_threshold(model.probabilities(texts), labels, [0.3, 0.5, 0.9]).first().f1 == 1.0
    assert folds(texts, 3, 1).groupBy("fold").count().count() == 3
    s = spark.createDataFrame([(7, "dump memory credential now", 3, 29)], "doc_id long, sentence string, start int, end int")
    assert model.hits(s, 0.5).first().item_id == "T1"


@pytest.mark.parametrize("b, c", [(0, 0), (3, 9), (600, 600), (3000, 3100), (0, 2000), (5, 1)])
def test_mcnemar_of_any_size(spark, b, c):
    from fractions import Fraction

    n, k = b + c, min(b, c)
    term, total = Fraction(1), Fraction(1)
    for i in range(1, k + 1):
        term = term * (n - i + 1) / i
        total += term
    want = min(1.0, float(2 * total / 2**n)) if n else 1.0
    got = one(spark.createDataFrame([(b, c)], "b int, c int").select(domain.mcnemar(F.col("b"), F.col("c")).alias("p"))).p
    assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-300)


def test_places_over_many_ranges(spark):
    x = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = {r.k: r.rn for r in ranking.numbered(x, F.desc("k")).collect()}
    assert got == {k: 1000 - k for k in range(1000)}


def test_keywords_without_latin_letters(spark):
    kb = spark.createDataFrame([("a", "ttp", "A", ["--", "\u0442\u0430\u043d\u043a"], 0), ("b", "tool", "B", ["x\\Ey z", ""], 1), ("c", "tool", "C", None, 2)], "item_id string, item_type string, name string, keywords array<string>, ord int")
    docs = [(1, "one -- two"), (2, "\u0422\u0410\u041d\u041a!"), (3, "an x\\Ey z here"), (4, None), (5, "")]
    got = {(r.doc_id, r.item_id): (r.matched, r.start, r.end) for r in extraction.keyword_hits(spark.createDataFrame(docs, "doc_id int, text string"), kb).collect()}
    assert got == {(1, "a"): ("--", 4, 6), (2, "a"): ("\u0442\u0430\u043d\u043a", 0, 4), (3, "b"): ("x\\Ey z", 3, 9)}


def test_indicators_brute_force(spark, sf_dir):
    """Every span of the given texts against the same patterns in Python, the more specific type first."""
    import re

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect()]
    rows += [(-1, "see hxxp://a[.]b.com/x), CVE-2024-12345 a.b@c.org 1.2.3.4 " + "ab" * 32), (-2, "1[.]2[.]3[.]4 and x[.]example.")]
    want = []
    for i, t in rows:
        clean, at, j = "", [], 0
        while j < len(t):
            step = 3 if t.startswith("[.]", j) else 1
            clean, j = clean + ("." if step == 3 else t[j]), j + step
            at.append((j - step, j))
        fixed = re.sub("(?i)hxxp", "http", clean)
        taken = []
        for name, p in extraction.INDICATORS:
            for m in re.finditer(p, fixed):
                if not any(a < m.end() and b > m.start() for a, b in taken):
                    taken.append((m.start(), m.end()))
                    want.append((i, name, re.sub(r"[.,);\]]+$", "", m[0]), at[m.start()][0], at[m.end() - 1][1]))
    got = [(r.doc_id, r.type, r.value, r.start, r.end) for r in extraction.indicators(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_communities_of_cliques(spark):
    """Three cliques in a ring: found whole, and no single move raises the modularity."""
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", 0.2), ("b1", "c1", 0.2), ("c2", "a2", 0.2)]
    edges = spark.createDataFrame(rows, "a string, b string, sim double")
    got = {r.id: r.community for r in clustering.communities(edges).collect()}
    assert got == {f"{g}{i}": f"{g}0" for g in "abc" for i in range(5)}
    truth = spark.createDataFrame([(k, k[0]) for k in got], "id string, truth string")
    assert tuple(one(clustering.order_spread(edges, truth, seeds=2))) == (2, 1.0, 0.0, 1.0, 1.0)


def test_report_labels_and_citations(spark):
    names = [("G1", "Dark Fox", "group", 0), ("G2", "dark-fox", "group", 1), ("G2", "Nightowl", "group", 2), ("G1", "12345", "group", 3), ("G1", "abc", "group", 4), ("G1", "Ferret", "software", 5), ("G2", "Ferret", "software", 6), ("G1", "Weasel", "software", 7)]
    v = protocols.alias_vocabulary(spark.createDataFrame(names, "grp string, name string, tier string, ord int"))
    assert {tuple(r) for r in v.collect()} == {("darkfox", "G1", "group"), ("nightowl", "G2", "group"), ("weasel", "G1", "software")}
    titles = [(1, "The DARK FOX returns"), (2, "Dark fox and NightOwl"), (3, "weasel loader"), (4, None), (5, "nothing")]
    got = {tuple(r) for r in protocols.label_reports(spark.createDataFrame(titles, "report_id int, title string"), v).collect()}
    assert got == {(1, "G1", "group"), (3, "G1", "software")}
    reports = spark.createDataFrame([(1, "G1", ["returns", "darkfox"], 2020)], "report_id int, grp string, words array<string>, year int")
    refs = spark.createDataFrame([("G1", "Vendor Returns", ["returns"]), ("G1", "Dark Fox 2020", ["darkfox"]), ("G1", "Dark Fox", ["darkfox"]), ("G2", "x", ["returns"])], "grp string, reference string, words array<string>")
    names = spark.createDataFrame([("G1", ["darkfox"])], "grp string, names array<string>")
    assert {r.reference for r in protocols.self_citations(reports, refs, names).collect()} == {"Vendor Returns", "Dark Fox 2020"}


def test_group_folds(spark):
    x = spark.createDataFrame([("G0007",), ("G12",), ("G",), ("C:1:x",)], "g string").select(protocols.group_fold(F.col("g")).alias("f"))
    assert [r.f for r in x.collect()][:3] == [1, 0, 0]


def test_classifier_weights_are_sublinear(spark, tmp_path):
    from cairnspark.operators.ml import Classifier, Featuriser

    texts = spark.createDataFrame([(1, "alpha alpha alpha beta"), (2, "alpha beta gamma")], "doc_id long, text string")
    f = Featuriser.fit(texts, min_df=1, characters=True)
    place = {r.term: r["at"] for r in f.vocabulary.collect()}
    x = {r.doc_id: dict(zip(r["at"], r.value, strict=True)) for r in f.transform(texts).collect()}
    assert x[1][place["alpha"]] / x[1][place["beta"]] == pytest.approx(1 + math.log(3)) and x[2][place["alpha"]] == pytest.approx(x[2][place["beta"]])
    assert all(sum(v * v for v in row.values()) == pytest.approx(1.0) for row in x.values())
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, label string")
    model = Classifier.fit(texts, labels, min_examples=1, min_df=1)
    model.save(str(tmp_path / "m"))
    again = Classifier.load(spark, str(tmp_path / "m"), ["x", "y"])
    assert sorted(map(tuple, again.predict(texts).collect())) == sorted(map(tuple, model.predict(texts).collect()))
