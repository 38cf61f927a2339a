"""Spans of regular expression matches, in code points, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,value:string>>"


def regexp_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches, leftmost and without overlap.

    The gaps between matches (split) and the matches themselves are laid end to end; a running length gives offsets.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Zipped, as a lambda would split the text anew for every match; the last gap has no match.
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["gap"])
        b = a + F.length(pair["m"])
        one = F.struct(a.alias("start"), b.alias("end"), pair["m"].alias("value"))
        return F.when(pair["m"].isNull(), acc).otherwise(F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    return F.when(text.isNotNull(), F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(SPANS))
