"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: every w-word shingle (repeats included) votes with its XXH64; a bit is set if it is set in over half of
the votes. Search (after Qin et al., "GPH: similarity search in Hamming space"):

1. Bits that agree more often than chance are grouped into the same part, so that the parts are as independent as can
   be. Agreement is counted over all fingerprints, as one 64 x 64 table per task.
2. A pair at distance at most t must, for any thresholds with sum(t_i + 1) >= t + 1, be at distance at most t_i in
   some part i (t_i = -1 leaves the part out). For every fingerprint, dynamic programming picks the thresholds with the
   smallest estimated number of probes and candidates: from the exact sizes of heavy values and, beyond them, the
   bits' frequencies.
3. Every fingerprint is stored under its value in each part and probes the values within t_i of its own; each
   (part, value) cell compares probes to what is stored with popcounts, and returns a spanning forest of its links, so
   that a cell of n rows returns fewer than n links, however dense.
4. Links go to connected components, written round by round to the shared folder.

Equal fingerprints collapse into one row before all that, so exact copies cost nothing. Every cell above CELL rows is
salted: stored rows are dealt over the salts, probes visit every salt. A task holds the stored rows of one salt, and
probes stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import jaccard
from cairnspark.llm import kernels as K
from cairnspark.llm.shared import connected_components, sent_if_few, small_batches, written

#: Stored rows of a cell that a task holds; larger cells are salted.
CELL = 4096
#: What it costs to send one probe through a shuffle, in comparisons of two fingerprints.
PROBE = 200.0
#: Parts of keep_one_per_group's fingerprints: no two that differ in fewer bits are missed.
PARTS = 16
_ZERO = np.uint64(0)


# --- fingerprints ---------------------------------------------------------------------------------------------------


def _normal(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of the slice joined by single spaces; start, end and row of each word in that."""
    s, e, row = K.words(data, offsets)
    joined = b" ".join(data.tobytes().lower().split()) if len(offsets) == 2 else None
    if joined is None:
        raw = data.tobytes().lower()
        joined = b" ".join([b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b > a])
        joined = b" ".join(joined.split())
    n = e - s
    start = np.cumsum(n + 1) - n - 1
    return joined, start, start + n, row


def fingerprint_slice(data: np.ndarray, offsets: np.ndarray, shingle: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, shingles per row) of a slice; fingerprints has n_words columns of 64 bits."""
    joined, s, e, row = _normal(data, offsets)
    n_rows = len(offsets) - 1
    per_row = np.bincount(row, minlength=n_rows)
    first_word = np.cumsum(per_row) - per_row
    n_sh = np.where(per_row >= shingle, per_row - shingle + 1, (per_row > 0).astype(np.int64))
    sh_row = np.repeat(np.arange(n_rows), n_sh)
    first_sh = np.cumsum(n_sh) - n_sh
    at = np.arange(len(sh_row)) - first_sh[sh_row] + first_word[sh_row]
    last = np.minimum(at + shingle, first_word[sh_row] + per_row[sh_row]) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(s[at].tolist(), e[last].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, len(at))
    out = np.empty((n_rows, n_words), np.uint64)
    for j in range(n_words):
        out[:, j] = K.majority_bits(np.ascontiguousarray(h), first_sh, n_sh)
        h = K.mix(h + np.uint64(0x9E3779B97F4A7C15))
    return out, n_sh


def fingerprints(docs: DataFrame, shingle: int = 4, n_words: int = 1) -> DataFrame:
    """(doc_id, fp binary of n_words little-endian 64-bit words, size) of every document.

    Null or wordless texts have fingerprint zero and size 0; fewer than `shingle` words form one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1), 1 << 20):
                fp, size = fingerprint_slice(data, offsets, shingle, n_words)
                raw = [x.tobytes() for x in fp]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(raw, pa.binary()), pa.array(size, pa.int64())],
                    ["doc_id", "fp", "size"],
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        K.tidy(run), "doc_id long, fp binary, size long"
    )


# --- parts and thresholds ---------------------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame, n_bits: int) -> tuple[int, np.ndarray]:
    """(rows, co-set counts): a fixed n_bits x n_bits table, summed task by task over all fingerprints."""

    def run(batches):
        n, total = 0, np.zeros((n_bits, n_bits))
        for batch in batches:
            x = _matrix(batch.column(0))
            for i in range(0, len(x), 8192):
                b = np.unpackbits(x[i : i + 8192].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                total += b.T @ b
                n += len(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(n_bits + 1), pa.int32()), pa.array([[float(n)], *total.tolist()])], ["i", "c"]
        )

    parts = fps.select("fp").mapInArrow(K.tidy(run), "i int, c array<double>")
    sums = parts.groupBy("i").agg(
        *[F.sum(F.get("c", F.lit(j))).alias(f"c{j}") for j in range(n_bits)]
    )
    rows = {r[0]: r[1:] for r in sums.collect()}
    n = int(rows[0][0] or 0) if 0 in rows else 0
    return n, np.array([rows.get(i, [0] * n_bits) for i in range(1, n_bits + 1)], float)


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as rows of 64-bit words."""
    if not len(column):
        return np.zeros((0, 1), np.uint64)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(len(column), -1)


def group_bits(n: int, together: np.ndarray, n_parts: int) -> list[list[int]]:
    """Equal parts of bits, each grown by the free bit most correlated with those in it."""
    n_bits = len(together)
    p = np.clip(np.diag(together) / max(n, 1), 1e-6, 1 - 1e-6)
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(n_bits)), []
    for i in range(n_parts):
        size = n_bits // n_parts + (i < n_bits % n_parts)
        rest = sorted(free)
        part = [max(rest, key=lambda b: (corr[b, rest].max(), -b))]
        while len(part) < size:
            rest = sorted(free - set(part))
            part.append(max(rest, key=lambda b: (corr[b, part].sum(), -b)))
        free -= set(part)
        parts.append(sorted(part))
    return parts


def part_values(x: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(x), len(parts)), np.int64)
    for i, bits in enumerate(parts):
        for j, b in enumerate(bits):
            out[:, i] |= ((x[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << j
    return out


def choose_parts(n: int, n_bits: int, budget: int, probes_cost: float = PROBE) -> int:
    """The number of parts with the least expected work for n fingerprints if values were uniform."""
    best = (math.inf, budget)
    for m in range(2, budget + 1):
        width, more, left = n_bits // m, budget - m, 0.0
        # Thresholds as even as they get; each step of radius r multiplies the values to be probed.
        for i in range(m):
            r = more // m + (i < more % m)
            left += sum(math.comb(width, d) for d in range(r + 1))
        work = (left + m) * probes_cost + left * n / 2.0**width
        best = min(best, (work, m))
    return best[1]


def thresholds(x: np.ndarray, values: np.ndarray, parts, ones: np.ndarray, n: int, heavy: dict, budget: int, limit: int = 2):
    """Per fingerprint, thresholds t_i in -1..limit with sum(t_i + 1) = budget and the least estimated cost."""
    m = len(parts)
    cost = np.zeros((len(x), m, limit + 2))
    for i, bits in enumerate(parts):
        b = np.stack([(x[:, c // 64] >> np.uint64(c % 64)) & np.uint64(1) for c in bits], 1).astype(float)
        same = b * ones[bits] + (1 - b) * (1 - ones[bits])
        ratio = (1 - same) / np.maximum(same, 1e-9)
        base = np.prod(np.maximum(same, 1e-9), axis=1) * n
        at = [base, base * ratio.sum(1), base * (ratio.sum(1) ** 2 - (ratio**2).sum(1)) / 2]
        if heavy.get(i):
            keys = np.array(sorted(heavy[i]))
            sizes = np.array([heavy[i][k] for k in keys], float)
            j = np.minimum(np.searchsorted(keys, values[:, i]), len(keys) - 1)
            at[0] = np.where(keys[j] == values[:, i], sizes[j], at[0])
        total = np.zeros(len(x))
        for t in range(limit + 1):
            total = total + PROBE * math.comb(len(bits), t) * (t > 0) + at[t]
            cost[:, i, t + 1] = total
    best = np.full((len(x), budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((len(x), m, budget + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for t in range(limit + 2):
            for s in range(t, budget + 1):
                c = best[:, s - t] + cost[:, i, t]
                less = c < new[:, s]
                new[less, s], choice[less, i, s] = c[less], t
        best = new
    out, left = np.empty((len(x), m), np.int8), np.full(len(x), budget)
    every = np.arange(len(x))
    for i in range(m - 1, -1, -1):
        t = choice[every, i, left]
        out[:, i], left = t - 1, left - t
    return out


# --- cells ------------------------------------------------------------------------------------------------------------


def _rows(batch: pa.RecordBatch, parts, ones, n, heavy, budget):
    """Stored and probing rows (part, value, role) of a batch; role 1 is stored, 2 probes, 3 both."""
    x = _matrix(batch.column(1))
    v = part_values(x, parts)
    t = thresholds(x, v, parts, ones, n, heavy, budget)
    for i, bits in enumerate(parts):
        yield i, np.arange(len(x)), v[:, i], np.where(t[:, i] >= 0, 3, 1)
        masks = {1: np.int64(1) << np.arange(len(bits)), 2: np.array([(1 << a) | (1 << b) for a in range(len(bits)) for b in range(a)], np.int64)}
        for r in (1, 2):
            who = np.flatnonzero(t[:, i] >= r)
            if len(who):
                near = (v[who, i][:, None] ^ masks[r][None, :]).ravel()
                yield i, np.repeat(who, len(masks[r])), near, np.full(len(near), 2)


def _forest(x: np.ndarray, sizes: np.ndarray, role: np.ndarray, near: int, far: int, ratio: float):
    """A spanning forest, as index pairs, of the links between probing and stored rows of a cell."""
    n = len(x)
    root = np.arange(n)
    stored = np.flatnonzero(role & 1)
    edges_a, edges_b = [], []
    for i in np.flatnonzero(role & 2):
        other = stored[root[stored] != root[i]]  # what is joined already needs no further link
        if not len(other):
            continue
        d = np.bitwise_count(x[other, 0] ^ x[i, 0]).astype(np.int64)
        ok = d <= near
        if x.shape[1] > 1 and ok.any():
            other = other[ok]
            d = np.bitwise_count(x[other] ^ x[i]).sum(1)
            ok = (d <= far) & (np.minimum(sizes[other], sizes[i]) >= ratio * np.maximum(sizes[other], sizes[i]))
        hit = other[ok]
        if len(hit):
            roots, one = np.unique(root[hit], return_index=True)
            edges_a += [i] * len(one)
            edges_b += hit[one].tolist()
            root[np.isin(root, roots)] = root[i]
    return edges_a, edges_b


def _cells(near: int, far: int, ratio: float, cell: int):
    """Streams over rows sorted by cell, stored rows first; a cell that goes on keeps its stored rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = _cell_key(t)
            change = np.flatnonzero(key[1:] != key[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from _solve(t.slice(0, cut), key[:cut], near, far, ratio)
            held = t.slice(cut).combine_chunks()
            if len(held) > 4 * cell:
                yield from _solve(held, key[cut:], near, far, ratio)
                kept = held.filter(pa.array(np.asarray(held["role"]) & 1 == 1))
                done = pa.array(np.ones(len(kept), np.int32))  # they have met each other
                held = kept.set_column(kept.schema.get_field_index("role"), "role", done)
        if held is not None and len(held):
            yield from _solve(held, _cell_key(held), near, far, ratio)

    return run


def _cell_key(t: pa.Table) -> np.ndarray:
    return K.mix(
        np.asarray(t["value"]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        + np.asarray(t["part"]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        + np.asarray(t["salt"]).astype(np.uint64)
    )


def _solve(t: pa.Table, key: np.ndarray, near, far, ratio):
    x = _matrix(t["fp"].combine_chunks())
    node, role, size = (np.asarray(t[c]) for c in ("node", "role", "size"))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(at[1:], len(key))
    a, b = [], []
    worth = _may_link(x, at, ends, near, far)
    for s, e in zip(at[worth].tolist(), ends[worth].tolist(), strict=True):
        if e - s > 1:
            p, q = _forest(x[s:e], size[s:e], role[s:e], near, far, ratio)
            a += [s + i for i in p]
            b += [s + i for i in q]
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _may_link(x: np.ndarray, at: np.ndarray, ends: np.ndarray, near: int, far: int, small: int = 128) -> np.ndarray:
    """Cells worth a closer look: large ones, and small ones with any pair within the distances."""
    n = ends - at
    worth = n > small
    few = np.flatnonzero((n > 1) & ~worth)
    pairs = np.cumsum(n[few] * n[few])
    for lo in range(0, int(pairs[-1]) if len(few) else 0, 1 << 21):
        some = few[np.searchsorted(pairs, lo, "right") : np.searchsorted(pairs, lo + (1 << 21), "right")]
        if not len(some):
            continue
        m = n[some]
        cell = np.repeat(np.arange(len(some)), m * m)
        k = np.arange(len(cell)) - np.repeat(np.cumsum(m * m) - m * m, m * m)
        i, j = at[some][cell] + k // m[cell], at[some][cell] + k % m[cell]
        ahead = i < j
        i, j, cell = i[ahead], j[ahead], cell[ahead]
        ok = np.bitwise_count(x[i, 0] ^ x[j, 0]) <= near
        if x.shape[1] > 1:
            i, j, cell = i[ok], j[ok], cell[ok]
            ok = np.bitwise_count(x[i] ^ x[j]).sum(1) <= far
        worth[some[cell[ok]]] = True
    return np.flatnonzero(worth)


def links(nodes: DataFrame, budget: int, near: int, far: int, ratio: float = 0.0, n_parts: int | None = None, cell: int = CELL) -> DataFrame:
    """Links (a, b) between the rows of nodes (node, fp, size): enough of them to connect what is linked.

    Rows link if their first words differ in at most `near` bits and all their words in at most `far`; with
    budget = near + 1 and one word, no link between different components is missed. `ratio`: the least quotient of
    sizes.
    """
    n_words = len(nodes.select("fp").head(1)[0][0]) // 8 if nodes.take(1) else 1
    n, together = bit_statistics(nodes, 64 * n_words)
    m = n_parts or choose_parts(n, 64 * n_words, budget)
    parts = group_bits(n, together, m)
    ones = np.clip(np.diag(together) / max(n, 1), 1e-3, 1 - 1e-3)

    def values(batches):
        for batch in batches:
            v = part_values(_matrix(batch.column(0)), parts)
            part = np.tile(np.arange(len(parts), dtype=np.int32), len(v))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(v.ravel())], ["part", "value"])

    # Values of a thousandth of the rows or more, for the estimates: a thousand a part at most.
    sizes = written(nodes.select("fp").mapInArrow(K.tidy(values), "part int, value long").groupBy("part", "value").count(), "cell-sizes")
    heavy: dict[int, dict[int, int]] = {}
    for part, value, count in sizes.where(F.col("count") > max(cell // 4, n // 1000)).collect():
        heavy.setdefault(part, {})[value] = count
    large = written(sizes.where(F.col("count") > cell).select("part", "value", F.ceil(F.col("count") / cell).cast("int").alias("salts")), "large-cells")

    def spread(batches):
        for batch in batches:
            for piece in (batch.slice(i, 20000) for i in range(0, len(batch), 20000)):
                for i, who, value, role in _rows(piece, parts, ones, n, heavy, budget):
                    take = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(who), i, np.int32)), pa.array(value), pa.array(role.astype(np.int32)),
                            *(piece.column(c).take(take) for c in range(3)),
                        ],
                        ["part", "value", "role", "node", "fp", "size"],
                    )

    rows = nodes.select("node", "fp", "size").mapInArrow(K.tidy(spread), "part int, value long, role int, node long, fp binary, size long")
    rows = rows.join(large, ["part", "value"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("salts")).cast("int"))
    where = F.when(F.col("role") == 1, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = rows.withColumn("salt", F.explode(where)).withColumn("role", F.when(F.col("salt") == F.col("own"), F.col("role")).otherwise(2))
    rows = rows.withColumn("late", F.col("role") == 2)
    return (
        rows.select("part", "value", "salt", "late", "role", "node", "fp", "size")
        .repartition("part", "value", "salt")
        .sortWithinPartitions("part", "value", "salt", "late")
        .mapInArrow(K.tidy(_cells(near, far, ratio, cell)), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 4, n_words: int = 1, near: int = 4, far: int | None = None, budget: int | None = None,
    ratio: float = 0.0, n_parts: int | None = None,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs: the smallest doc_id that its fingerprint reaches by links.

    One row out for each row in: rows repeated or sharing a doc_id are rows of their own, with the id's texts each in
    the component of its fingerprint. Null and wordless texts have fingerprint zero. Rows whose doc_id is null keep a
    null component. An empty table gives an empty one. A text of any length is one slice in one task. Columns other than
    doc_id and text are left out, so their names cannot clash.
    """
    fps = written(fingerprints(docs, shingle, n_words), "fingerprints")
    by = ["fp"] if n_words == 1 else ["fp", "size"]
    nodes = written(
        fps.where("doc_id is not null").groupBy(*by).agg(F.min("doc_id").alias("node"), F.max("size").alias("n"))
        .select("node", "fp", F.col("n").alias("size")),
        "nodes",
    )
    found = links(nodes, budget or near + 1, near, near if far is None else far, ratio, n_parts)
    comps = connected_components(found)
    reps = nodes.join(comps, "node", "left").select(*by, F.coalesce("component", "node").alias("component_id"))
    return fps.join(reps, by, "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one_per_group(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """Documents without those whose near-duplicate group has a smaller doc_id (one of each group stays).

    Groups are connected by pairs whose sets of five-word shingles have this Jaccard similarity or more: fingerprints are
    searched by the generalised pigeonhole, pairs too far apart for it are found by shared prefixes, and all are verified
    exactly (see jaccard). Rows with a null doc_id or without words are nobody's copies and stay; a row repeated in full
    stays with its copy. All columns are kept as they are.
    """

    def search(fps: DataFrame) -> DataFrame:
        near, far = jaccard.far_bits(similarity, 64), jaccard.far_bits(similarity)
        return links(fps, PARTS, near, far, similarity - 1e-9, PARTS)

    drop = jaccard.near_copies(docs.select("doc_id", "text"), search, similarity, shingle).where("not stays").select(F.col("row").alias("__dropped"))
    drop = sent_if_few(drop)  # so that texts stay where they are
    return docs.join(drop, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")) == drop["__dropped"], "left_anti")
