"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut by content into blocks: a block holds the passages around one anchor (see
passages). Only documents that hold a block's anchor can share a window with it, so each document is parsed against
every block that could give it a factor as long as a window.

- Where all content around an anchor stands in the block too, that content is one factor.
- Other passages of a block are parsed greedily against the block's rest, whose windows are indexed by fingerprint: a
  factor starts at the first window that the index has, and goes on in the sources that still agree until none does.
- A factor's end is checked: parsing goes on with the first window that the factor does not hold, which reaches back into
  it, so that windows across two factors are found from other sources too. Factors have a window's length at least and
  become duplicate spans.

So every window that stands twice is in a factor: the result is exact up to 64-bit fingerprints of 35-word content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.passages import OCCURRENCE, classify, edge_groups, keyed, per_row
from cairnspark.llm.shared import small_batches, table

WINDOW = 35
ANCHOR = 8
#: Passages of a block that a task parses at once (some hundred bytes each); the windows of larger blocks are counted one
#: by one by Spark.
BLOCK = 65536
#: Sources that a factor is followed in. More would make factors longer, but cover the same words: where the sources end,
#: the next factor starts at the next window.
SOURCES = 64


def index(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """The anchors of every document, in words. Rows with a null text have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in K.slices(batch.column(1), 1 << 20):
                s, e, row = K.words(data, offsets)
                base = np.searchsorted(row, np.arange(len(offsets) - 1))
                r, first, last, anchor, gram, whole = K.anchors(K.word_hashes(data, s, e), row, window, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(r + a)),
                        *(pa.array((x - base[r]).astype(np.int32)) for x in (first, last, anchor)),
                    ],
                    ["gram", "whole", "row", "first", "last", "anchor"],
                )

    return docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(K.tidy(run), OCCURRENCE)


def window_prints(texts: DataFrame, edges: DataFrame, window: int = WINDOW, single: bool = False) -> DataFrame:
    """(gram, row, first, prints): fingerprints of the windows of every passage to be parsed.

    With `single`, every window as an occurrence of its own, for blocks too large for one task.
    """
    wanted = edges.groupBy("row").agg(F.collect_set(F.struct("gram", "first", "last")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1), 1 << 20):
                s, e, row = K.words(data, offsets)
                sums = K.prefix_sums(K.word_hashes(data, s, e))
                base = np.searchsorted(row, np.arange(b - a))
                lists = batch.column(2).slice(a, b - a)
                flat = lists.flatten()
                doc = np.repeat(np.arange(b - a), np.asarray(lists.value_lengths()))
                gram, first, last = (np.asarray(flat.field(i)) for i in range(3))
                n = last - first + 1
                ends = np.cumsum(n)
                at = np.repeat(base[doc] + first, n) + np.arange(n.sum()) - np.repeat(ends - n, n)
                prints = K.spans(sums, at, at + window)
                if single:
                    owner = np.repeat(doc, n)
                    print_, place = pa.array(prints.view(np.int64)), pa.array((at - base[owner]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [print_, print_, batch.column(0).take(pa.array(owner + a)), place, place, place],
                        ["gram", "whole", "row", "first", "last", "anchor"],
                    )
                    continue
                raw = [prints[p:q].tobytes() for p, q in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), batch.column(0).take(pa.array(doc + a)), pa.array(first.astype(np.int32)), pa.array(raw, pa.binary())],
                    ["gram", "row", "first", "prints"],
                )

    return texts.join(wanted, "row").select("row", "text", "edges", "doc_id").mapInArrow(
        K.tidy(run), OCCURRENCE if single else "gram long, row long, first int, prints binary"
    )


def parse(prints: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Greedy factors (passage, first window, last window) of each passage relative to the others of its blocks.

    Also to itself, as far as the same windows stand elsewhere in it. Passages of several blocks may stand side by side:
    equal windows have equal anchors, so that no factor reaches over to another block.
    """
    size = np.array([len(p) for p in prints])
    h = np.concatenate(prints)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group_of = np.empty(len(h), np.int64)
    group_of[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(h)))
    known = counts[group_of] > 1
    out, i, n = [], 0, len(h)
    hits = np.flatnonzero(known)
    while True:
        j = np.searchsorted(hits, i)
        if j == len(hits):
            return out
        i = int(hits[j])
        g = group_of[i]
        sources = order[starts[g] : starts[g] + min(int(counts[g]), SOURCES + 1)]
        sources = sources[sources != i]
        end = i
        while end + 1 < n and owner[end + 1] == owner[i] and known[end + 1]:
            step = sources + (end + 1 - i)
            step = step[step < n]
            agree = step[(group_of[step] == group_of[end + 1]) & (owner[step] == owner[step - (end + 1 - i)])]
            if not len(agree):
                break
            sources, end = agree - (end + 1 - i), end + 1
        out.append((int(owner[i]), int(at[i]), int(at[end])))
        i = end + 1


def parse_blocks(rows: DataFrame) -> DataFrame:
    """(row, first, last): the factors of the passages (gram, row, first, prints), as ranges of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = np.asarray(held["gram"])
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(change):
                cut = int(change[-1]) + 1
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from solve(held)

    def solve(t: pa.Table):
        found = parse([np.frombuffer(p, np.uint64) for p in t["prints"].to_pylist()])
        if found:
            who, first, last = np.array(found).T
            base = np.asarray(t["first"])[who]
            yield pa.RecordBatch.from_arrays(
                [t["row"].combine_chunks().take(pa.array(who)), pa.array((base + first).astype(np.int32)), pa.array((base + last).astype(np.int32))],
                ["row", "first", "last"],
            )

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(K.tidy(run), "row long, first int, last int")


def duplicate_windows(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(row, first, last): runs of word windows whose words also start anywhere else."""
    small_batches(docs.sparkSession)
    factors, open_ = classify(index(docs, window, k))
    edges = open_.join(edge_groups(open_), "gram").select("gram", "row", "first", "last", "n_edge")
    texts = keyed(docs)
    large = edges.where(F.col("n_edge") > BLOCK)
    if large.limit(1).count():
        more, _ = classify(window_prints(texts, large, window, single=True))  # a window's content is its anchor: none stays open
        factors = factors.unionByName(more)
    return factors.unionByName(parse_blocks(window_prints(texts, edges.where(F.col("n_edge") <= BLOCK), window)))


def covered(n: int, firsts: np.ndarray, lasts: np.ndarray, window: int) -> np.ndarray:
    """Which of n places lie in a window that starts in one of the ranges first..last."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, firsts, 1)
    np.add.at(step, lasts + window, -1)
    return np.cumsum(step[:n]) > 0


def remove_duplicates(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row: words in no repeated window, joined by one space.

    Words are what stands between spaces and tab to carriage return. Null and empty texts have none; an empty table
    gives an empty one. Repeated rows, and rows of one doc_id (null too), are rows of their own: they repeat each
    other's windows, so texts of a window or more go in every copy. A text of any length is one slice in one task.
    Columns other than doc_id and text are left out, so their names cannot clash.
    """
    ranges = per_row(duplicate_windows(docs, window, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            for a, b, data, offsets in K.slices(batch.column(1)):
                s, e, row = K.words(data, offsets)
                n = np.bincount(row, minlength=b - a)
                base = np.cumsum(n) - n
                raw, gone, kept = data.tobytes(), [], []
                for i in range(b - a):
                    p, q = int(base[i]), int(base[i] + n[i])
                    if found[a + i].is_valid:
                        own = found[a + i].values
                        out = covered(q - p, np.asarray(own.field(0)), np.asarray(own.field(1)), window)
                        stay = np.flatnonzero(~out) + p
                    else:
                        stay = np.arange(p, q)
                    gone.append(q - p - len(stay))
                    if not gone[-1]:
                        kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                    else:
                        kept.append(b" ".join([raw[x:y] for x, y in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                        pa.array([x.decode() for x in kept] if with_text else [None] * len(kept), pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(
        K.tidy(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def op1_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return remove_duplicates(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
