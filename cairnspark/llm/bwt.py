"""Suffix-array dedup: the Burrows-Wheeler transform of many strings, built column by column.

Strings that can share a 400-byte window are brought together by content (see passages): a collection holds the bytes
around the occurrences of some anchors, and all strings of an anchor are in one collection, aligned at the anchor.

Within a task a collection's transform and its longest common prefixes are built from the last column to the first
(after Bauer, Cox, Rosone and Sciortino): each round inserts one symbol of every string in front of the suffixes sorted
so far, which a stable counting sort by that symbol puts in order; a suffix's common prefix with its predecessor is one
more than the smallest common prefix that lay between the two in the round before. As the strings are aligned, a round
only has to compare suffixes of its own column. Columns are read from one external file in sequence, and order,
symbols and common prefixes are appended to another; memory holds a single column. A last sequential pass over that
file reports each window whose common prefix with a neighbour reaches 400 bytes.

Equal strings are told by their fingerprints before any of that: all windows they own repeat, and one of them is sorted
for all. Collections that are still too large are divided into ever shorter runs of windows, keyed by the bytes that
all windows of a run share, and equal runs are again told first; single windows end the division, so that no
collection, however many documents share a passage, outgrows a task.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.passages import OCCURRENCE, classify, edge_groups, keyed, per_row
from cairnspark.llm.rlz import covered
from cairnspark.llm.shared import small_batches, table

WINDOW = 400
ANCHOR = 16
#: Strings of an anchor that one collection takes; beyond it they are divided into runs of windows of these lengths.
GROUP = 8192
STRIDES = (32, 1)
#: Strings sorted at once in a task (whole anchors).
COLLECTION = 8192


def index(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """The anchors of every document, in bytes. Rows with a null text have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1), 1 << 20):
                row = np.repeat(np.arange(b - a), np.diff(offsets))
                r, first, last, anchor, gram, whole = K.anchors(K.byte_codes(data), row, window, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(r + a)),
                        *(pa.array((x - offsets[r]).astype(np.int32)) for x in (first, last, anchor)),
                    ],
                    ["gram", "whole", "row", "first", "last", "anchor"],
                )

    return docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(K.tidy(run), OCCURRENCE)


def _with_edges(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, text, edges) of the texts that have edges (gram, row, first, last, anchor)."""
    wanted = edges.groupBy("row").agg(F.collect_set(F.struct("gram", "first", "last", "anchor")).alias("edges"))
    return texts.join(wanted, "row").select("row", "text", "edges", "doc_id")


def _edge_slices(batch: pa.RecordBatch):
    """Per slice of texts: first row, bytes, offsets, and for each edge its text's place in the slice and its columns."""
    for a, b, data, offsets in K.slices(batch.column(1)):
        lists = batch.column(2).slice(a, b - a)
        flat = lists.flatten()
        doc = np.repeat(np.arange(b - a), np.asarray(lists.value_lengths()))
        yield a, data, offsets, doc, *(np.asarray(flat.field(i)).astype(np.int64) for i in range(4))


def strings(texts: DataFrame, edges: DataFrame, window: int = WINDOW) -> DataFrame:
    """(grp, row, first, last, lead, bytes): the strings to be sorted.

    first..last are the windows owned, lead is the distance from first to the anchor, bytes what the windows cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data, offsets, doc, gram, first, last, anchor in _edge_slices(batch):
                raw = data.tobytes()
                begin = offsets[doc] + first
                end = offsets[doc] + last + window
                for p in range(0, len(doc), 4096):
                    q = slice(p, p + 4096)
                    pieces = [raw[x:y] for x, y in zip(begin[q].tolist(), end[q].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram[q]), batch.column(0).take(pa.array(doc[q] + a)),
                            *(pa.array(v[q].astype(np.int32)) for v in (first, last, anchor - first)),
                            pa.array(pieces, pa.binary()),
                        ],
                        ["grp", "row", "first", "last", "lead", "bytes"],
                    )

    return _with_edges(texts, edges).mapInArrow(K.tidy(run), "grp long, row long, first int, last int, lead int, bytes binary")


def divided(texts: DataFrame, edges: DataFrame, stride: int, window: int = WINDOW) -> DataFrame:
    """The owned windows of edges in runs of `stride` by distance to the anchor, as occurrences keyed by their core.

    The core is what all windows of a whole run share, so that equal windows are in runs of equal cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data, offsets, doc, gram, first, last, anchor in _edge_slices(batch):
                sums = K.prefix_sums(K.byte_codes(data))
                for d in range(0, window, stride):  # distances d .. d + stride - 1 from window start to anchor
                    lo, hi = np.maximum(first, anchor - d - stride + 1), np.minimum(last, anchor - d)
                    ok = np.flatnonzero(lo <= hi)
                    base = offsets[doc[ok]]
                    core = K.spans(sums, base + anchor[ok] - d, base + anchor[ok] - d - stride + 1 + window)
                    key = K.mix(core + gram[ok].view(np.uint64) + np.uint64(d))
                    whole = K.mix(K.spans(sums, base + lo[ok], base + hi[ok] + window) + (anchor[ok] - lo[ok]).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(doc[ok] + a)),
                            *(pa.array(x.astype(np.int32)) for x in (lo[ok], hi[ok], anchor[ok])),
                        ],
                        ["gram", "whole", "row", "first", "last", "anchor"],
                    )

    return _with_edges(texts, edges).mapInArrow(K.tidy(run), OCCURRENCE)


def repeated(groups: np.ndarray, lead: np.ndarray, owned: np.ndarray, texts: list[bytes], window: int):
    """(string, window) pairs, windows counted from the string's first, that stand in two strings of a group.

    The column-wise construction described above.
    """
    n = len(texts)
    before = int(lead.max())
    size = np.array([len(x) for x in texts])
    width = before + int((size - lead).max())
    start = before - lead
    grp = np.unique(groups, return_inverse=True)[1].astype(np.uint16 if n < 65536 else np.int64)
    found_s, found_w = [], []
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as sorted_:
        step = 64  # columns per stripe when the strings are turned into columns
        flat = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum(size) - size
        for c in range(0, width, step):
            col = np.arange(c, min(c + step, width))[:, None]
            inside = (col >= start) & (col < start + size)
            at = np.where(inside, base + col - start, 0)
            symbol = np.where(inside, flat[at].astype(np.int16), -1)
            columns.write(symbol.astype("<i2").tobytes())
        # Initially: the empty suffix of every string, by group.
        order = np.argsort(grp, kind="stable")
        lcp = np.zeros(n, np.int32)
        bounds = np.concatenate([[True], grp[order][1:] != grp[order][:-1]])
        lcp[bounds] = -1  # nothing in common across groups
        first_window = start.min()
        for c in range(width - 1, first_window - 1, -1):
            columns.seek(c * n * 2)
            symbol = np.frombuffer(columns.read(n * 2), "<i2")[order]
            by_symbol = np.argsort((symbol + 1).astype(np.uint16), kind="stable")
            perm = by_symbol[np.argsort(grp[order][by_symbol], kind="stable")]
            s = symbol[perm]
            g = grp[order][perm]
            new = np.zeros(n, np.int32)
            new[0] = -1
            new[1:][g[1:] != g[:-1]] = -1
            same = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] >= 0) & (g[1:] == g[:-1])) + 1
            if len(same):
                # The smallest common prefix between the two in the round before: over lcp[a + 1 .. b].
                a, b = perm[same - 1], perm[same]
                near = b == a + 1
                least = lcp[b].copy()
                if not near.all():
                    pairs = np.stack([a[~near] + 1, b[~near] + 1], 1).ravel()
                    least[~near] = np.minimum.reduceat(np.append(lcp, 0), pairs)[::2]
                new[same] = least + 1
            order, lcp = order[perm], new
            reach = np.flatnonzero(lcp >= window)
            sorted_.write(np.array([c, len(reach)], "<i4").tobytes())
            sorted_.write(np.concatenate([order[reach - 1], order[reach]]).astype("<i4").tobytes())
        sorted_.seek(0)
        while head := sorted_.read(8):
            c, m = np.frombuffer(head, "<i4").tolist()
            who = np.unique(np.frombuffer(sorted_.read(8 * m), "<i4"))
            w = c - start[who]
            ok = (w >= 0) & (w < owned[who])
            found_s.append(who[ok])
            found_w.append(w[ok])
    return np.concatenate(found_s), np.concatenate(found_w)


def sort_collections(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, first, last): runs of owned windows that stand in another string of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for p in range(0, len(batch), 2048):
                held.append(batch.slice(p, 2048))
                if sum(map(len, held)) < COLLECTION:
                    continue
                t = pa.Table.from_batches(held)
                key = np.asarray(t["grp"])
                change = np.flatnonzero(key[1:] != key[:-1])
                if len(change):
                    cut = int(change[-1]) + 1
                    yield from solve(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    def solve(t: pa.Table):
        key = np.asarray(t["grp"])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        t = t.filter(pa.array(count[inverse] > 1))
        if not len(t):
            return
        doc, first, last, lead = (np.asarray(t[c]) for c in ("row", "first", "last", "lead"))
        who, w = repeated(np.asarray(t["grp"]), lead, last - first + 1, t["bytes"].to_pylist(), window)
        if not len(who):
            return
        order = np.lexsort((w, who))
        who, at = who[order], first[who[order]] + w[order]
        new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)]))
        end = np.append(new[1:], len(at)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[who[new]]), pa.array(at[new].astype(np.int32)), pa.array(at[end].astype(np.int32))],
            ["row", "first", "last"],
        )

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(K.tidy(run), "row long, first int, last int")


def duplicate_windows(
    docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, group: int = GROUP, strides: tuple[int, ...] = STRIDES
) -> DataFrame:
    """(row, first, last): runs of byte windows that also start anywhere else. The last stride is 1."""
    small_batches(docs.sparkSession)
    texts = keyed(docs)
    known, open_ = classify(index(docs, window, k))
    columns = ["gram", "row", "first", "last", "anchor"]
    edges = open_.join(edge_groups(open_), "gram").select(*columns, "n_edge")
    small = edges.where(F.col("n_edge") <= group).select(*columns)
    for stride in strides:
        large = edges.where(F.col("n_edge") > group).select(*columns)
        if not large.limit(1).count():
            break
        more, open_ = classify(divided(texts, large, stride, window))
        known = known.unionByName(more)
        edges = open_.join(edge_groups(open_), "gram").select(*columns, "n_edge")
        small = small.unionByName(edges.where(F.col("n_edge") <= group).select(*columns))
    return known.unionByName(sort_collections(strings(texts, small, window), window))


def remove_duplicates(
    docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, with_text: bool = True, group: int = GROUP, strides: tuple[int, ...] = STRIDES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row: bytes in no repeated window.

    Null texts count as empty; an empty table gives an empty one. Repeated rows, and rows of one doc_id (null too), are
    rows of their own: they repeat each other's windows, so texts of a window or more go in every copy. A text of any
    length is one slice in one task. Columns other than doc_id and text are left out, so their names cannot clash.
    kept is binary: a cut may fall inside a character.
    """
    ranges = per_row(duplicate_windows(docs, window, k, group, strides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            for a, b, data, offsets in K.slices(batch.column(1)):
                gone, spans, kept = [], [], []
                for i in range(b - a):
                    own = data[offsets[i] : offsets[i + 1]]
                    out = np.zeros(len(own), bool)
                    if found[a + i].is_valid:
                        at = found[a + i].values
                        out = covered(len(own), np.asarray(at.field(0)), np.asarray(at.field(1)), window)
                    gone.append(int(out.sum()))
                    spans.append(int((out[1:] & ~out[:-1]).sum() + (out[0] if len(out) else 0)))
                    kept.append(own[~out].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                        pa.array(kept if with_text else [None] * len(kept), pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(
        K.tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def op10_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_duplicates(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
