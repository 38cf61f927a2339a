"""Every case against every actor, without a table of the pairs.

Cases and actors are packed into blocks. A task holds one block of either, scores all pairs between them and keeps what is
asked for: who can be among the k best, sums of a softmax, how many stand before a given actor. Work grows with the number
of pairs that share an item; what is written grows with the cases, once for each block of actors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.domain import idf
from cairnspark.functions.ranking import numbered
from cairnspark.functions.reuse import settled

#: Actors and cases of a block.
ACTORS, CASES = 32768, 4096
#: Values closer than this may be rounded to the same nine digits.
CLOSE = 2e-9

FOUND = "case_id string, metric string, n long, m double, z double, before long, ords array<long>, vals array<double>"


def _packed_actors(t: pa.Table) -> pa.Table:
    """A block's items as posting lists of places within the block, and its norms."""
    first, ords = t["first"][0].as_py(), t["ord"].to_numpy()
    items = t["items"].combine_chunks()
    lengths, flat = np.diff(items.offsets.to_numpy()), items.flatten().to_numpy()
    place = ords - first
    at = np.repeat(place, lengths)
    order = np.lexsort((at, flat))
    known, starts = np.unique(flat[order], return_index=True)
    size = int(place.max()) + 1
    full, less = np.ones(size), np.ones(size)
    full[place], less[place] = t["full"].to_numpy(), t["less"].to_numpy()
    data = pickle.dumps((first, size, {int(i): p for i, p in zip(known, np.split(at[order], starts[1:]), strict=True)}, full, less))
    return pa.table({"data": pa.array([data], pa.binary())})


def _packed_cases(t: pa.Table) -> pa.Table:
    """A block's cases in the order of their keys, so that like cases stand together."""
    rows = sorted(t.drop_columns(["block"]).to_pylist(), key=lambda r: (r["key"], r["case_id"]))
    return pa.table({"data": pa.array([pickle.dumps(rows)], pa.binary())})


def packed_actors(profile: DataFrame, actors: DataFrame, kb: DataFrame, items: DataFrame) -> DataFrame:
    """(data): blocks of actors (actor_id, ord) with their items (item_id, item) and norms among all groups and all but one."""
    k = kb.select("item_id", "usage", "n_groups").join(items, "item_id")
    own = profile.select("actor_id", "item_id").distinct().join(k, "item_id").groupBy("actor_id").agg(
        F.collect_list("item").alias("items"), F.sum(F.pow(idf(F.col("n_groups"), F.col("usage")), 2)).alias("full"), F.sum(F.pow(idf(F.col("n_groups") - 1, F.col("usage")), 2)).alias("less"),
    )
    x = own.join(actors.select("actor_id", F.col("ord").cast("long").alias("ord")), "actor_id").withColumn("first", F.floor(F.col("ord") / ACTORS) * ACTORS)
    return settled(x.select("first", "ord", "items", "full", "less").groupBy("first").applyInArrow(_packed_actors, "data binary"))


def _sums(parts: list[np.ndarray], weights: list[float], size: int) -> np.ndarray:
    """The sum of weights at each place of a block."""
    if not parts:
        return np.zeros(size)
    return np.bincount(np.concatenate(parts), np.repeat(weights, [p.size for p in parts]), size)


def _values(case: dict, first: int, size: int, postings: dict, full: np.ndarray, less: np.ndarray, covered: bool):
    """(cosines, coverages) of a block's actors with the case in its world; 0 for those that share no item with it."""
    there = [(i, w, postings[i]) for i, w in case["items"] if i in postings]
    dot = _sums([p for _, _, p in there], [w * w for _, w, _ in there], size)
    matched = _sums([p for _, _, p in there], [w for _, w, _ in there], size) if covered else None
    norm, changed, own = less if case["open"] else full, case["changed"], case["own"]
    own = -1 if own is None else own - first
    if changed:
        some = [(now * now - was * was, postings[i]) for i, was, now in changed if i in postings]
        base, norm = norm, norm + _sums([p for _, p in some], [w for w, _ in some], size)
    if 0 <= own < size:
        if case["open"] or changed:  # the case's own group is not there, or lacks what is changed
            gone = {i for i, _, _ in changed}
            held = [] if case["open"] else [w for i, w, p in there if i not in gone and (k := np.searchsorted(p, own)) < p.size and p[k] == own]
            dot[own] = sum(w * w for w in held)
            if covered:
                matched[own] = sum(held)
        if changed and not case["open"]:
            norm[own] = base[own] - sum(was * was for _, was, _ in changed)
    seen2, seen = sum(w * w for _, w in case["items"]), sum(w for _, w in case["items"])
    return dot / (np.sqrt(seen2) * np.sqrt(np.maximum(norm, 1e-300))) if there else dot, matched / seen if covered and there else matched


def _best(v: np.ndarray, k: int) -> np.ndarray:
    """Places of all values above 0 that may be among the k highest, rounded to nine digits; of equal ones the first k."""
    least = 0.0
    if v.size > 8 * k:  # the k-th of some is not above the k-th of all
        some = v[: v.size // 8]
        least = float(np.partition(some, some.size - k)[some.size - k])
    at = np.flatnonzero((v >= least - CLOSE) & (v > 0))
    if at.size > k:
        at = at[v[at] >= np.partition(v[at], at.size - k)[at.size - k] - CLOSE]
    if at.size > k:
        at = at[np.lexsort((at, -v[at]))]
        new = np.append(True, v[at[1:]] != v[at[:-1]])
        run = np.flatnonzero(new)[np.cumsum(new) - 1]
        at = at[np.arange(at.size) - run < k]
    return at


def _before(v: np.ndarray, shown: float, target: int) -> int:
    """How many come before the target, by values rounded to nine digits, then by place."""
    near, of = np.flatnonzero(np.abs(v - shown) <= CLOSE), np.rint(shown * 1e9)
    near = near[v[near] > 0]
    rounded = np.rint(v[near] * 1e9)
    return int(np.count_nonzero(v > shown + CLOSE) + np.count_nonzero(rounded > of) + np.count_nonzero((rounded == of) & (near < target)))


def _search(metrics: tuple[str, ...], k: int, temperature: float):
    names = ("case_id", "metric", "n", "m", "z", "before", "ords", "vals")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch["cases"], batch["actors"], strict=True):
                cases, (first, size, postings, full, less) = pickle.loads(left.as_buffer()), pickle.loads(right.as_buffer())
                out, last, values = [[] for _ in names], None, None
                for case in cases:
                    case["items"], case["changed"] = [tuple(x.values()) for x in case["items"]], [tuple(x.values()) for x in case["changed"] or []]
                    like = (case["items"], case["changed"], case["open"], case["own"])
                    if like != last:
                        last, values = like, _values(case, first, size, postings, full, less, "coverage" in metrics)
                    target = size if case["target"] is None else case["target"] - first
                    mine = 0 <= target < size
                    for metric in metrics:
                        v, before = values[metric == "coverage"], 0
                        if metric == "score" and mine:
                            v = v.copy()
                            v[target] += case["boost"]
                        bare = mine and not v[target] > 0  # pointed at without a shared item
                        n = int(np.count_nonzero(v > 0)) + bare
                        if not n:
                            continue
                        if metric == "cosine" and case["shown"] is not None:
                            before = _before(v, case["shown"], target)
                        m, b, z = float(v.max()), _best(v, k), 0.0
                        if bare and b.size < k:  # last, and among equals only with others that are pointed at
                            b = np.append(b, target)
                        if temperature:
                            z = float(np.exp((v[v > 0] - m) / temperature).sum()) + bare * float(np.exp(-m / temperature))
                        for c, x in zip(out, (case["case_id"], metric, n, m, z, before, (b + first).tolist(), v[b].tolist()), strict=True):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], list(names))

    return run


def search(cases: DataFrame, actors: DataFrame, metrics: tuple[str, ...], k: int, temperature: float = 0.0) -> DataFrame:
    """(case_id, metric, n, m, z, place, best): of each case the k best actors by each of score, cosine and coverage.

    cases: case_id, key (like cases have like keys), items array of (item, idf), changed array of (item, was, now): what usage
    lacks in the case's world, open (without the own group), own, target (places of actors), boost, shown (the target's cosine);
    actors: packed_actors(). n counts the actors that share an item or are the target, m is the highest value, z the sum of
    exp((value - m) / temperature), place the target's by cosine. best: array of (rounded, ord, value), falling, ties by ord.
    """
    cases = settled(cases.select("case_id", "key", "items", "changed", "open", "own", "target", "boost", "shown"))
    blocks = max(-(-cases.count() // CASES), cases.sparkSession.sparkContext.defaultParallelism * 2)  # few cases are dealt finer
    packed = cases.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInArrow(_packed_cases, "data binary")
    pairs = settled(packed.select(F.col("data").alias("cases"))).repartition(blocks).crossJoin(actors.select(F.col("data").alias("actors")))
    found = pairs.mapInArrow(_search(metrics, k, temperature), FOUND)
    return settled(merged(found, k, temperature))


def merged(found: DataFrame, k: int, temperature: float) -> DataFrame:
    """One row a case and metric of what the blocks of actors gave."""
    parts = F.collect_list(F.struct("n", "m", "z", "before", "ords", "vals"))
    x = found.groupBy("case_id", "metric").agg(F.max("m").alias("m"), parts.alias("parts"))
    share = lambda p: p["z"] * F.exp((p["m"] - F.col("m")) / (temperature or 1.0))
    total = lambda f, zero: F.aggregate(F.transform("parts", f), zero, lambda a, b: a + b)
    none = F.lit(0).cast("long")
    one = lambda o, v: F.struct((-F.round(v, 9)).alias("rounded"), o.alias("ord"), v.alias("value"))
    ranked = F.array_sort(F.flatten(F.transform("parts", lambda p: F.zip_with(p["ords"], p["vals"], one))))
    return x.select(
        "case_id", "metric", total(lambda p: p["n"], none).alias("n"), "m", total(share, F.lit(0.0)).alias("z"), (total(lambda p: p["before"], none) + 1).alias("place"),
        F.slice(ranked, 1, k).alias("best"),
    )


def numbered_items(kb: DataFrame) -> DataFrame:
    """(item_id, item): the items of the knowledge base, numbered."""
    return settled(numbered(kb.select("item_id"), "item_id", name="item").select("item_id", (F.col("item") - 1).cast("int").alias("item")))


def tops(found: DataFrame, actors: DataFrame, metric: str) -> DataFrame:
    """(case_id, actor_id, ord, value, rank) of the best by a metric."""
    x = found.where(F.col("metric") == metric).select("case_id", F.posexplode("best").alias("rank", "b"))
    x = x.select("case_id", (F.col("rank") + 1).alias("rank"), F.col("b.ord").alias("ord"), F.col("b.value").alias("value"))
    return x.join(actors.select("actor_id", "ord"), "ord")


def case_items(seen: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, items) of observed items (case_id, item_id, idf); the order of items is the same in all cases."""
    x = seen.join(items, "item_id").groupBy("case_id")
    return x.agg(F.array_sort(F.collect_list(F.struct("item", "idf"))).alias("items"))
