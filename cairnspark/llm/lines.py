"""Line dedup by distinct-site spread, in DataFrame operations alone.

Every line's hash gets a HyperLogLog sketch of the sites it stands on; partial sketches are merged by aggregation, so
that a line of any frequency costs one sketch per task. Lines whose estimate is clear of the threshold are decided by
it; lines near the threshold get an exact distinct count. Lines on `min_sites` sites or more are boilerplate and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import aside, table, written

#: log2 of the registers of a sketch; the standard error is about 1.04 / sqrt(2 ** LG_K) = 3.25 %.
LG_K = 10
#: Estimates within this share of the threshold count as near it: over seven standard errors.
MARGIN = 0.25


def line_hashes(docs: DataFrame, site: str) -> DataFrame:
    """(row, pos, line, site) of every line that is not empty, as a 128-bit hash pair; row is the hash of doc_id and text.

    A line is what stands between line feeds, without spaces around it.
    """
    cut = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x))
    # The hash is taken below the lines, or it would be taken anew for every line of a text.
    texts = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("row"), F.col(site).alias("site"), "text")
    rows = texts.select("row", "site", F.posexplode(cut).alias("pos", "line"))
    return rows.where(F.length("line") > 0).select(
        "row", "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("line"), "site"
    )


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, n_sites, exact) of lines on min_sites distinct non-null sites or more.

    n_sites is the sketch's estimate where that decided, else the exact count.
    """
    spread = lines.where("site is not null").groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about")
    )
    likely = spread.where(F.col("about") >= F.lit(min_sites * (1 - MARGIN)))
    near = F.col("about") < F.lit(min_sites * (1 + MARGIN))
    likely = written(likely, "line-spread")
    exact = (
        lines.where("site is not null")
        .join(likely.where(near).select("line"), "line", "left_semi")
        .select("line", "site")
        .distinct()
        .groupBy("line")
        .count()
        .where(F.col("count") >= min_sites)
        .select("line", F.col("count").alias("n_sites"), F.lit(True).alias("exact"))
    )
    return likely.where(~near).select("line", F.col("about").alias("n_sites"), F.lit(False).alias("exact")).unionByName(exact)


def removed_lines(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """(row, gone): positions, from 0, of the boilerplate lines of each text that has any."""
    lines = line_hashes(docs, site)
    common = boilerplate(lines, min_sites).select("line")
    return lines.join(common, "line", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("gone"))


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """docs with boilerplate lines taken out of text; adds n_lines and n_removed.

    Null texts stay null with n_lines 0; empty lines stay. Documents with no boilerplate keep their text byte for byte.
    Rows with a null site keep a say in nothing but lose boilerplate too. Repeated rows, and rows of one doc_id with
    different texts, are rows of their own. An empty table gives an empty one; a text of any length is split within its
    row. A column of the caller named n_lines or n_removed is kept as n_lines_in or n_removed_in.
    """
    found = removed_lines(docs, site, min_sites)
    docs = aside(docs, "n_lines", "n_removed", "__row", "__gone", "__cut")
    gone = found.withColumnRenamed("row", "__row").withColumnRenamed("gone", "__gone")
    # Kept places by one hash set, lines by place: linear in a text. The lines are a column of their own, as a lambda
    # would split the text anew for every place.
    places = F.array_except(F.sequence(F.lit(0), F.size("__cut") - 1), "__gone")
    kept = F.array_join(F.transform(places, lambda i: F.get("__cut", i)), "\n")
    none = F.lit(0).cast("long")
    return (
        docs.join(gone, F.xxhash64("doc_id", "text") == F.col("__row"), "left")
        .withColumn("__cut", F.explode(F.array(F.split("text", "\n", -1))))
        .withColumn("n_lines", F.when(F.col("text").isNull(), none).otherwise(F.size("__cut").cast("long")))
        .withColumn("n_removed", F.when(F.col("__gone").isNull(), none).otherwise(F.size("__gone").cast("long")))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
        .drop("__row", "__gone", "__cut")
    )


def op6_line_spread(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, boilerplate lines removed, digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    )


OP6_SQL = """
WITH cut AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, source, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM cut
), common AS (
  SELECT trim(raw, ' ') AS line FROM lines WHERE length(trim(raw, ' ')) > 0
  GROUP BY 1 HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.raw, c.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN common c ON trim(l.raw, ' ') = c.line
)
SELECT d.doc_id, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(m.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""
