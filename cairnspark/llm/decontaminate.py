"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

1. Every run of SEED benchmark tokens is a seed. A bitmap of fixed size, with a bit for each seed's hash, goes to every
   task; documents are scanned and keep the seeds whose bit is set.
2. An item can only be covered as asked if it shares some number of its seeds, so that a document must share one of the
   others once that many less one are put aside; put aside are the seeds that most items have. These rarest seeds join
   documents with items, and pairs that share enough seeds in all go on: no pair is lost, and common phrases join nothing.
3. Each pair is tiled: the longest unmarked common run is marked, again and again, with rolling hashes whose length
   falls until it is SEED. The share of the item's tokens under tiles is its coverage, so that reordered passages count
   in full.

Tokens are runs of letters and digits (and non-ASCII bytes), lower-cased in A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import small_batches, table, written

SEED = 5
COVERAGE = 0.5
#: log2 of the bits of the bitmap of seeds (8 MB).
BITMAP = 26
_CLASS = np.zeros(256, bool)
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token of a slice."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | edge[:-1]))
    end = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | edge[1:])) + 1
    return K.word_hashes(_LOWER[data], start, end), np.searchsorted(offsets, start, "right") - 1


def seeds(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of k tokens within a row, and where they start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return K.spans(K.prefix_sums(h), at, at + k), at


def benchmark_seeds(benchmark: DataFrame, k: int) -> DataFrame:
    """(item_id, tokens, seeds): distinct seeds; items of fewer than k tokens have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                h, row = tokens(data, offsets)
                ids, toks, found = batch.column(0).slice(a, b - a), [], []
                for i in range(b - a):
                    own = h[row == i]
                    s, _ = seeds(own, np.zeros(len(own), np.int64), k)
                    toks.append(own.tobytes())
                    found.append(np.unique(s).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(toks, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["item_id", "tokens", "seeds"]
                )

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        K.tidy(run), "item_id long, tokens binary, seeds array<long>"
    )


def seed_bitmap(items: DataFrame) -> np.ndarray:
    """The bits of all seeds, as 64-bit words: at most 2 ** BITMAP / 64 rows come to the driver."""
    bit = F.pmod(F.col("seed"), F.lit(1 << BITMAP))
    words = (
        items.select(F.explode("seeds").alias("seed")).select(F.floor(bit / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(seed, 64) AS INT))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    out = np.zeros((1 << BITMAP) // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def document_hits(docs: DataFrame, bitmap: np.ndarray, k: int) -> DataFrame:
    """(row, doc_id, tokens, seeds) of documents with a seed whose bit is set, and these seeds; row is the hash of id and text."""
    box = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                h, row = tokens(data, offsets)
                s, at = seeds(h, row, k)
                bit = s & np.uint64((1 << BITMAP) - 1)
                hit = np.flatnonzero((box.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                s, at = s[hit], at[hit]
                own = row[at]
                ids, toks, found = [], [], []
                first = np.searchsorted(row, np.arange(b - a + 1))
                for i in np.unique(own).tolist():
                    ids.append(a + i)
                    toks.append(h[first[i] : first[i + 1]].tobytes())
                    found.append(np.unique(s[own == i]).view(np.int64))
                if ids:
                    take = pa.array(ids)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(2).take(take), batch.column(0).take(take), pa.array(toks, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                        ["row", "doc_id", "tokens", "seeds"],
                    )

    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row")
    )
    return rows.mapInArrow(K.tidy(run), "row long, doc_id long, tokens binary, seeds array<long>")


def tile(text: np.ndarray, item: np.ndarray, least: int) -> int:
    """Tokens of item covered by greedy string tiling of item with text, tiles of at least `least` tokens.

    Running Karp-Rabin: the search length starts long and halves; at each length all common unmarked runs are found by
    their rolling hashes, extended, and marked from the longest on.
    """
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    length = max(least, min(len(text), len(item)))
    while True:
        found = _matches(text, item, free_t, free_i, length)
        longest = found[0][0] if found else 0
        if longest > 2 * length:
            length = longest
            continue
        for n, t, i in found:
            if free_t[t : t + n].all() and free_i[i : i + n].all():
                free_t[t : t + n] = False
                free_i[i : i + n] = False
            elif n - 1 >= length:
                # Part of it is taken; what is left is found again at this length.
                found = None
                break
        if found is None:
            continue
        if length == least:
            return int((~free_i).sum())
        length = max(least, length // 2)


def _matches(text, item, free_t, free_i, length) -> list[tuple[int, int, int]]:
    """Maximal unmarked common runs of at least `length` tokens as (n, place in text, place in item), longest first."""
    if min(len(text), len(item)) < length:
        return []
    blocked_t, blocked_i = np.cumsum(np.append(0, ~free_t)), np.cumsum(np.append(0, ~free_i))
    at_t = np.flatnonzero(blocked_t[length:] == blocked_t[: len(text) - length + 1])
    at_i = np.flatnonzero(blocked_i[length:] == blocked_i[: len(item) - length + 1])
    if not len(at_t) or not len(at_i):
        return []
    ht = K.spans(K.prefix_sums(text), at_t, at_t + length)
    hi = K.spans(K.prefix_sums(item), at_i, at_i + length)
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], ht, "left"), np.searchsorted(hi[order], ht, "right")
    out = []
    for t, a, b in zip(at_t[up > lo].tolist(), lo[up > lo].tolist(), up[up > lo].tolist(), strict=True):
        for i in at_i[order[a:b]].tolist():
            if t and i and free_t[t - 1] and free_i[i - 1] and text[t - 1] == item[i - 1]:
                continue  # not maximal: it starts earlier
            n = length
            while t + n < len(text) and i + n < len(item) and free_t[t + n] and free_i[i + n] and text[t + n] == item[i + n]:
                n += 1
            out.append((n, t, i))
    return sorted(out, key=lambda m: (-m[0], m[1], m[2]))


def tiled_pairs(docs: DataFrame, benchmark: DataFrame, k: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(row, doc_id, item_id, n_tokens, covered) of texts and items covered to `coverage` or more; row is the hash of id and text.

    Null and empty texts, items of fewer than k tokens (too short to tell), and empty tables match nothing. Texts of
    any length are tiled whole. Columns other than ids and texts are left out, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    items = written(benchmark_seeds(benchmark.where("item_id is not null"), k).where(F.size("seeds") > 0), "benchmark-seeds")
    items = items.withColumn("item", F.xxhash64("item_id", "tokens")).withColumn("n_tokens", (F.length("tokens") / 8).cast("long"))
    hits = written(document_hits(docs, seed_bitmap(items), k), "benchmark-hits")
    # Tiles of n >= k tokens hold n - k + 1 distinct places, so covering c tokens takes at least c / k shared seeds
    # unless seeds repeat within the item: then one will do.
    least = F.when(F.size("seeds") + k - 1 < F.col("n_tokens"), 1).otherwise(F.ceil(F.ceil(F.col("n_tokens") * coverage) / k))
    items = items.withColumn("least", F.greatest(least, F.lit(1)))
    flat = items.select("item", F.explode("seeds").alias("seed"), (F.size("seeds") - F.col("least") + 1).alias("probes"))
    flat = flat.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("seed")))
    flat = flat.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy("df", "seed"))).where("place <= probes")
    pairs = hits.select("row", F.explode("seeds").alias("seed")).join(flat.select("item", "seed"), "seed").select("row", "item").distinct()
    todo = (
        pairs.join(hits.dropDuplicates(["row"]).select("row", "doc_id", F.col("tokens").alias("text"), F.col("seeds").alias("own")), "row")
        .join(items.dropDuplicates(["item"]).select("item", "item_id", F.col("tokens").alias("wanted"), "seeds", "least"), "item")
        .where(F.size(F.array_intersect("own", "seeds")) >= F.col("least"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c = [], []
            for text, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                t, i = np.frombuffer(text, np.uint64), np.frombuffer(item, np.uint64)
                n.append(len(i))
                c.append(tile(t, i, k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                ["row", "doc_id", "item_id", "n_tokens", "covered"],
            )

    return todo.select("row", "doc_id", "item_id", "text", "wanted").mapInArrow(
        K.tidy(run), "row long, doc_id long, item_id long, n_tokens long, covered long"
    ).where(F.col("covered") >= F.col("n_tokens") * coverage)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tokens, covered, coverage) of tiled_pairs: a pair once, with its best coverage over the id's texts.

    Copies of an item under other ids are reported one by one.
    """
    best = tiled_pairs(docs, benchmark, k, coverage).groupBy("doc_id", "item_id", "n_tokens").agg(F.max("covered").alias("covered"))
    return best.withColumn("coverage", F.col("covered") / F.col("n_tokens"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, k: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows whose own text covers an item; rows with a null doc_id stay."""
    found = tiled_pairs(docs, benchmark, k, coverage).select("row").distinct()
    return docs.join(found, F.xxhash64("doc_id", "text") == found["row"], "left_anti")


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, n_tokens, covered, coverage."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
