"""Communities against a plain Louvain, and the stream that rescores cases against the batch."""

import random
from collections import defaultdict

import pytest

from cairnspark.operators import ach, clustering
from cairnspark.plans import catalogue
from cairnspark.streaming import reports


def quality(edges, label):
    m, inner, degree = sum(w for *_, w in edges), defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        degree[label[a]] += w
        degree[label[b]] += w
        inner[label[a]] += w * (label[a] == label[b])
    return sum(inner[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def louvain(edges):
    """Node by node moves and merged levels, in order of names."""
    names = {x: x for e in edges for x in e[:2]}
    links = edges
    while True:
        near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in links:
            near[a][b] += w
            near[b][a] += w * (a != b)
            degree[a] += w
            degree[b] += w
        two_m, label = sum(degree.values()), {x: x for x in degree}
        mass, moved, any_move = dict(degree), True, False
        while moved:
            moved = False
            for x in sorted(degree):
                pull = defaultdict(float)
                for y, w in near[x].items():
                    if y != x:
                        pull[label[y]] += w
                mass[label[x]] -= degree[x]
                best = max([label[x], *sorted(pull)], key=lambda c: round(pull[c] - degree[x] * mass[c] / two_m, 12))
                moved |= best != label[x]
                any_move |= best != label[x]
                label[x] = best
                mass[best] += degree[x]
        names = {n: label[c] for n, c in names.items()}
        if not any_move:
            return names
        merged = defaultdict(float)
        for a, b, w in links:
            merged[tuple(sorted((label[a], label[b])))] += w
        links = [(a, b, w) for (a, b), w in merged.items()]


def graphs():
    rng = random.Random(9)
    cliques = [(f"c{g:02d}n{i}", f"c{g:02d}n{j}", 1.0) for g in range(12) for i in range(5) for j in range(i)] + [(f"c{g:02d}n0", f"c{(g + 1) % 12:02d}n1", 1.0) for g in range(12)]
    planted = [(f"n{i:03d}", f"n{j:03d}", 1.0) for i in range(80) for j in range(i) if rng.random() < (0.35 if i % 4 == j % 4 else 0.03)]
    star = [("hub", f"leaf{i}", 1.0) for i in range(10)] + [("leaf0", "tail1", 1.0), ("tail1", "tail2", 1.0)]
    return {"cliques": cliques, "planted": planted, "star": star}


@pytest.mark.parametrize("name", ["cliques", "planted", "star"])
def test_communities_are_connected_and_near_louvain(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "a string, b string, sim double")
    member = clustering.communities(df)
    got = {r.id: r.community for r in member.collect()}
    value = clustering.modularity(df, member).first()
    assert value.modularity == pytest.approx(quality(edges, got)) and value.n_communities == len(set(got.values()))
    # Nodes move in parallel shares: where groups are told by few edges, that costs some of what one move at a time finds.
    assert value.modularity >= (0.9 if name == "planted" else 1.0) * quality(edges, louvain(edges)) - 1e-9
    for c in set(got.values()):
        reach, todo = {c}, [c]
        while todo:
            x = todo.pop()
            for a, b, _ in edges:
                for u, v in ((a, b), (b, a)):
                    if u == x and got[v] == c and v not in reach:
                        reach.add(v)
                        todo.append(v)
        assert reach == {x for x in got if got[x] == c}
    places = {r.id: r.place for r in clustering.ordered_communities(member).collect()}
    sizes = [sum(p == i for p in places.values()) for i in range(len(set(places.values())))]
    assert sizes == sorted(sizes, reverse=True)


def test_stream_of_evidence_equals_the_batch(spark, sf_dir, tmp_path):
    """Evidence in four arrivals, some late, some repeated, with a restart in between and one batch run again."""
    w = catalogue.static_world(spark, sf_dir)
    cases = [r[0] for r in w["items"].select("case_id").distinct().orderBy("case_id").limit(12).collect()]
    evidence = [r for r in w["evidence"].collect() if r.case_id in cases]
    candidates = spark.createDataFrame(w["candidates"].where(w["candidates"].case_id.isin(cases)).collect(), w["candidates"].schema).persist()
    facets = catalogue._facets(w["profile"]).persist()
    schema = w["evidence"].schema
    random.Random(3).shuffle(evidence)
    parts = [evidence[i::4] for i in range(4)]
    parts[2] += parts[0][:9]
    parts[3] += parts[3][:5] + parts[1][:5]
    state, check, inbox = (str(tmp_path / x) for x in ("state", "check", "in"))

    def arrive(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{inbox}/{name}")

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{inbox}/*")
        q = reports.stream_assessments(stream, candidates, facets, state, check)
        q.awaitTermination(300)
        assert q.exception() is None

    arrive(parts[0], "a")
    arrive(parts[1], "b")
    drain()
    arrive(parts[2], "c")
    arrive(parts[3], "d")
    drain()
    columns = ["case_id", "leading", "confidence", "n_diag", "flagged"]
    want = ach.assess(spark.createDataFrame(evidence, schema), candidates, facets)["assessments"].select(*columns).collect()
    got = reports.current_assessments(spark, state).select(*columns).collect()
    assert sorted(got) == sorted(want) and len(got) == len(cases)
