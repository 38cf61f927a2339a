"""What the corpus operators share: the common folder, input checks, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions.reuse import shared_dir

#: Paths that written() has made in this process and nobody has deleted yet.
_MADE: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage, survives lost executors.

    The table stays until sweep() takes it, as results that read it are computed later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many written tables there are: a mark for sweep()."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since a mark, but for those that `keep` reads."""
    kept = [f for f in keep.inputFiles()] if keep is not None else []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _MADE[since:]:
        if any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in kept):
            continue
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.remove(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows per Arrow batch: texts are long, and a batch stands in memory on both sides of the worker's pipe."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def aside(df: DataFrame, *names: str) -> DataFrame:
    """df with columns of these names renamed to NAME_in, so that an operator can add its own of the names."""
    taken = set(df.columns)
    for name in names:
        if name in taken:
            new = f"{name}_in"
            while new in taken:
                new += "_in"
            df = df.withColumnRenamed(name, new)
            taken.add(new)
    return df


#: Rows of one 64-bit key that are sent to every task, 32 MB or so; larger tables are joined by exchange.
SENT_ROWS = 1_000_000


def sent_if_few(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked to be sent to every task where it has SENT_ROWS rows or fewer."""
    return F.broadcast(keys) if keys.limit(SENT_ROWS + 1).count() <= SENT_ROWS else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., "Connected components in MapReduce and beyond"): both keep
    connectivity and end in stars around the smallest node after O(log^2 n) rounds. Each round is written to the
    shared folder. Rows shrink or stay; hot nodes only meet partial aggregates (min) and equi-joins on the node, which
    adaptive execution splits. Self links are allowed and give components of one.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges = edges.where("u <> v")
    for i in range(max_rounds):
        mark = made()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # Large star: each larger neighbour of u goes to the smallest of u and its neighbours.
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # Small star: u and its smaller neighbours go to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = written(small, "stars")
        if i:
            sweep(links.sparkSession, mark - 1, new)  # the round before
        # Stars: every node hangs on one centre and no centre hangs on another.
        state = (
            new.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        )
        loose = state.where("n > 1").limit(1).count() or new.select(F.col("v").alias("u")).join(
            new.select("u"), "u", "left_semi"
        ).limit(1).count()
        edges = new
        if not loose:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
