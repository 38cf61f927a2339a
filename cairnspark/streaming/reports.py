"""The same operators over streams: extraction of arriving reports, windowed counts of arriving events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.operators import ach
from cairnspark.operators.extraction import indicators


def report_stream(spark: SparkSession, path: str) -> DataFrame:
    """Text files as they arrive: (doc_id, text)."""
    raw = spark.readStream.format("text").option("wholetext", True).load(path)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), F.col("value").alias("text"))


def stream_indicators(reports: DataFrame, out: str, checkpoint: str):
    """Writes indicators of arriving reports as Parquet; stateless, so each batch stands alone."""
    return indicators(reports).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per tumbling window with a watermark; ts is cast, as watermarks need instants."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("started"), "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


_KEY = ["case_id", "evidence_id"]


def _until(spark: SparkSession, path: str, batch: int, schema) -> DataFrame:
    """The rows that batches before this one have left."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path).where(F.col("batch") < batch).drop("batch")
    except AnalysisException:  # the first batch finds no folder
        return spark.createDataFrame([], schema)


def stream_assessments(evidence: DataFrame, candidates: DataFrame, profile: DataFrame, state: str, checkpoint: str, config: ach.Config = ach.DEFAULT):
    """Rescores cases as their evidence arrives; see current_assessments().

    evidence: a stream of rows as evidence_from_items() makes them. The state is a table of distinct evidence by case and
    evidence_id, in a folder a batch under `state`, so that a batch that runs again after a failure writes the same folder
    again. A batch adds what it brings that is new, and assesses the cases it touches on all they have so far: rows that
    come late or again change nothing else. candidates and profile as for ach.assess().
    """

    def step(arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        known = _until(spark, f"{state}/evidence", batch, arrived.schema)
        new = arrived.dropDuplicates(_KEY).join(known.select(*_KEY), _KEY, "left_anti").select(arrived.columns)
        new.write.mode("overwrite").parquet(f"{state}/evidence/batch={batch}")
        new = spark.read.schema(arrived.schema).parquet(f"{state}/evidence/batch={batch}")
        touched = new.select("case_id").distinct()
        whole = known.join(touched, "case_id", "left_semi").unionByName(new)
        found = ach.assess(whole, candidates.join(touched, "case_id", "left_semi"), profile, config=config)["assessments"]
        found.write.mode("overwrite").parquet(f"{state}/assessments/batch={batch}")

    return evidence.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_assessments(spark: SparkSession, state: str) -> DataFrame:
    """The newest assessment of every case that the stream has seen."""
    x = spark.read.parquet(f"{state}/assessments")
    newest = x.groupBy("case_id").agg(F.max("batch").alias("batch"))
    return x.join(newest, ["case_id", "batch"], "left_semi").drop("batch")
