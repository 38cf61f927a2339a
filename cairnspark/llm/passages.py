"""Where fixed-length windows of content stand twice: the index both substring operators search.

Every window of a text is owned by one anchor, the smallest k-gram inside it, so that equal windows are owned by equal
anchors at equal distance. An occurrence of an anchor stands for all windows it owns there.

Texts are told apart by a row key, the hash of doc_id and text: rows of one doc_id with different texts stay different
rows, and rows repeated in full share a key and what is found for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import written

#: row, first..last: windows owned, as offsets in the text; anchor: the anchor's offset; gram and whole: fingerprints
#: of the anchor and of all content the owned windows cover (with the anchor's place in it).
OCCURRENCE = "gram long, whole long, row long, first int, last int, anchor int"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row), dealt by row: the same exchange serves every join with texts."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).repartition("row")


def classify(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factors, open_) of the occurrences whose anchor stands elsewhere too.

    - factors: the same content stands elsewhere over all owned windows, so each of them does;
    - open_, with `edge`: one row per content of anchors that have several contents. Edges (true) stand here only, but
      single windows may still repeat; the others are one representative of a factor, for edges to be compared with.

    Anchors that stand once own windows that stand once; they drop out. Hot anchors meet partial aggregates, one
    equi-join between written tables, which adaptive execution can split, and an anti-join on single occurrences.
    """
    live = written(
        occurrences.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
        .where("n > 1")
        .select("gram", (F.col("lo") == F.col("hi")).alias("uniform")),
        "live-anchors",
    )
    hits = written(occurrences.join(live, "gram"), "live-occurrences")
    cells = (
        hits.where("not uniform")
        .groupBy("gram", "whole")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last", "anchor")).alias("one"))
    )
    open_ = written(cells.select("gram", "whole", "one.*", (F.col("n") == 1).alias("edge")), "open-passages")
    key = ["row", "first", "gram", "whole"]
    alone = open_.where("edge").select(*key)
    return hits.join(alone, key, "left_anti").select("row", "first", "last"), open_


def edge_groups(open_: DataFrame) -> DataFrame:
    """(gram, n_edge): how many edges and representatives each anchor with edges has; written, so that joins with it split."""
    return written(
        open_.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n_edge"), F.count_if("edge").alias("edges"))
        .where("edges > 0 and n_edge > 1")
        .select("gram", "n_edge"),
        "edge-groups",
    )


def per_row(ranges: DataFrame) -> DataFrame:
    """(row, ranges) of the ranges (row, first, last): each distinct range of a row once."""
    return ranges.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
