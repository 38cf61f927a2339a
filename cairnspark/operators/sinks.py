"""Exports as DataFrames of JSON or text lines: STIX, Navigator, Cypher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.domain import STIX_CONFIDENCE, cypher_literal, lookup, stix_pattern, uuid5

#: Namespace of deterministic identifiers.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
FACET_LABELS = {"capability": "Capability", "infrastructure": "Infrastructure", "victim": "Victim", "adversary": "Adversary"}
STAMP = "1970-01-01T00:00:00.000Z"


def stix_id(kind: str | Column, key: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit("--"), uuid5(NAMESPACE, F.concat(k, F.lit(":"), key)))


def stix_objects(hits: DataFrame, indicators: DataFrame, assessments: DataFrame | None = None, stamp: str = STAMP) -> DataFrame:
    """(doc_id, id, type, object JSON): attack patterns per hit, indicators with a pattern, a note per assessment."""
    common = lambda kind, key: [
        F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), stix_id(kind, key).alias("id"),
        F.lit(stamp).alias("created"), F.lit(stamp).alias("modified"),
    ]
    h = hits.select("doc_id", "item_id", "name").distinct().select(
        "doc_id",
        F.struct(
            *common("attack-pattern", F.col("item_id")), "name",
            F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("item_id").alias("external_id"))).alias("external_references"),
        ).alias("o"),
    )
    i = indicators.withColumn("pattern", stix_pattern(F.col("type"), F.col("value"))).where("pattern is not null")
    i = i.select("doc_id", F.col("type").alias("t"), "value", "pattern").distinct().select(
        "doc_id",
        F.struct(
            *common("indicator", F.concat_ws(":", "t", "value")), F.col("value").alias("name"), "pattern",
            F.lit("stix").alias("pattern_type"), F.lit(stamp).alias("valid_from"),
        ).alias("o"),
    )
    out = h.select("doc_id", F.col("o.id").alias("id"), F.col("o.type").alias("type"), F.to_json("o").alias("object")).unionByName(
        i.select("doc_id", F.col("o.id").alias("id"), F.col("o.type").alias("type"), F.to_json("o").alias("object"))
    )
    if assessments is not None:
        refs = out.groupBy("doc_id").agg(F.sort_array(F.collect_set("id")).alias("refs"))
        n = assessments.withColumnRenamed("case_id", "doc_id").join(refs, "doc_id", "left")
        target = F.when(F.size(F.coalesce("refs", F.array())) > 0, F.col("refs")).otherwise(F.array(stix_id("report", F.col("doc_id").cast("string"))))
        n = n.select(
            "doc_id",
            F.struct(
                *common("note", F.col("doc_id").cast("string")), F.concat(F.lit("Leading: "), F.col("leading")).alias("content"),
                lookup(STIX_CONFIDENCE, F.col("confidence")).alias("confidence"), target.alias("object_refs"),
            ).alias("o"),
        )
        out = out.unionByName(n.select("doc_id", F.col("o.id").alias("id"), F.col("o.type").alias("type"), F.to_json("o").alias("object")))
    return out


def unresolved(objects: DataFrame) -> DataFrame:
    """References of objects that no object of the same document resolves: empty if the bundle is closed."""
    refs = objects.select("doc_id", F.explode(F.from_json("object", "object_refs array<string>")["object_refs"]).alias("id"))
    return refs.join(objects.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def stix_bundles(objects: DataFrame) -> DataFrame:
    """(doc_id, bundle): one bundle per document."""
    o = objects.groupBy("doc_id").agg(F.sort_array(F.collect_list("object")).alias("o"))
    bid = stix_id("bundle", F.col("doc_id").cast("string"))
    return o.select("doc_id", F.concat(F.lit('{"type":"bundle","id":"'), bid, F.lit('","objects":['), F.array_join("o", ","), F.lit("]}")).alias("bundle"))


def navigator(hits: DataFrame, name: str = "layer") -> DataFrame:
    """(doc_id, layer): a Navigator layer with an entry per technique hit."""
    t = hits.where("item_type = 'ttp'").select(
        "doc_id", F.struct(F.col("item_id").alias("techniqueID"), F.lit(1).alias("score"), F.concat_ws(":", "matched", "start", "end").alias("comment")).alias("t")
    )
    t = t.groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("techniques"))
    return t.select(
        "doc_id",
        F.to_json(F.struct(F.lit(name).alias("name"), F.struct(F.lit("4.5").alias("layer")).alias("versions"), F.lit("enterprise-attack").alias("domain"), "techniques")).alias("layer"),
    )


def cypher(events: DataFrame, campaigns: DataFrame | None = None) -> DataFrame:
    """(line): MERGE statements, without repeats; an unknown facet fails the job."""
    label = F.coalesce(lookup(FACET_LABELS, F.col("facet")), F.raise_error(F.concat(F.lit("unknown facet: "), "facet")))
    nodes = events.select(F.concat(F.lit("MERGE (:Event {id: "), cypher_literal(F.col("event_id")), F.lit("});")).alias("line"))
    rel = events.select(
        F.concat(
            F.lit("MERGE (e:Event {id: "), cypher_literal(F.col("event_id")), F.lit("}) MERGE (f:"), label, F.lit(" {value: "),
            cypher_literal(F.col("value")), F.lit("}) MERGE (e)-[:HAS]->(f);"),
        ).alias("line")
    )
    out = nodes.union(rel)
    if campaigns is not None:
        c = campaigns.select("campaign", F.explode(F.split("members", ",")).alias("id"))
        out = out.union(
            c.select(F.concat(F.lit("MERGE (e:Event {id: "), cypher_literal(F.col("id")), F.lit("}) MERGE (c:Campaign {id: "), cypher_literal(F.col("campaign")), F.lit("}) MERGE (e)-[:PART_OF]->(c);")))
        )
    return out.distinct()


def newest(published: DataFrame, n: int = 500) -> DataFrame:
    """The newest n published objects by arrival (ts, id): a collection's window."""
    return published.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def compact_kb(kb: DataFrame) -> DataFrame:
    """(item_id, line): a knowledge base as JSON lines of id, kind, parent, usage and the common and rare flags."""
    return kb.select(
        "item_id", F.to_json(F.struct(F.col("item_id").alias("id"), "kind", "parent", "usage", F.col("is_common").alias("common"), F.col("is_rare").alias("rare"))).alias("line")
    )


def dump(rows: DataFrame, *names: str, digits: int = 3) -> DataFrame:
    """(line): each row as a JSON object of these columns (all, if none are named), numbers with `digits` decimals; nulls are left out."""
    kinds = dict(rows.dtypes)
    shown = [F.round(n, digits).alias(n) if kinds[n] in ("double", "float") else F.col(n) for n in names or rows.columns]
    return rows.select(F.to_json(F.struct(*shown)).alias("line"))
