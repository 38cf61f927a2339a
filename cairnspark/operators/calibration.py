"""Calibration: grade maps with monotone pooling, cross-fitted histograms, abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRADES = ["low", "moderate", "high"]


def grade_map(x: DataFrame, *by: str, strength: float = 2.0, mean: float = 0.5, monotone: bool = True) -> DataFrame:
    """(by..., low, moderate, high): smoothed accuracy per grade of (grade, correct), pooled to be non-decreasing."""
    cols = []
    for g in GRADES:
        here = F.col("grade") == g
        cols += [F.count_if(here & F.col("correct")).alias(f"h_{g}"), F.count_if(here).alias(f"n_{g}")]
    c = x.groupBy(*by).agg(*cols)
    w = {g: F.col(f"n_{g}") + strength for g in GRADES}
    p = {g: (F.col(f"h_{g}") + strength * mean) / w[g] for g in GRADES}
    c = c.select(*by, *[p[g].alias(f"p{i}") for i, g in enumerate(GRADES)], *[w[g].alias(f"w{i}") for i, g in enumerate(GRADES)])
    if not monotone:
        return c.select(*by, *[F.col(f"p{i}").alias(g) for i, g in enumerate(GRADES)])
    # Three points: isotonic values by max over starts of min over ends of the weighted means.
    mean_of = lambda a, b: (
        sum((F.col(f"p{i}") * F.col(f"w{i}") for i in range(a, b + 1)), F.lit(0.0)) / sum((F.col(f"w{i}") for i in range(a, b + 1)), F.lit(0.0))
    )
    value = lambda i: (
        F.greatest(*[_least([mean_of(a, b) for b in range(i, 3)]) for a in range(i + 1)]) if i else _least([mean_of(0, b) for b in range(3)])
    )
    return c.select(*by, *[value(i).alias(g) for i, g in enumerate(GRADES)])


def _least(cols):
    return F.least(*cols) if len(cols) > 1 else cols[0]


def grade_crossfit(x: DataFrame) -> DataFrame:
    """x with p_cal: the probability of its grade in the map fitted on the other fold."""
    m = grade_map(x, "fold").select((1 - F.col("fold")).alias("fold"), *GRADES)
    p = F.when(F.col("grade") == "high", F.col("high")).when(F.col("grade") == "moderate", F.col("moderate")).otherwise(F.col("low"))
    return x.join(F.broadcast(m), "fold", "left").withColumn("p_cal", F.coalesce(p, F.lit(0.5))).drop(*GRADES)


def histogram_crossfit(x: DataFrame, bins: int = 10, prior: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """x with p_cal: smoothed accuracy of its bin in the other fold, apart for each value of `by`."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    x = x.withColumn("bin", b)
    base = x.groupBy(*by, "fold").agg(((F.count_if("correct") + 1) / (F.count(F.lit(1)) + 2)).alias("base"))
    cell = x.groupBy(*by, "fold", "bin").agg(F.count_if("correct").alias("hits"), F.count(F.lit(1)).alias("m"))
    flip = lambda t: t.withColumn("fold", 1 - F.col("fold"))
    y = x.join(flip(base), [*by, "fold"], "left").join(flip(cell), [*by, "fold", "bin"], "left")
    p = (F.coalesce("hits", F.lit(0)) + prior * F.coalesce("base", F.lit(0.5))) / (F.coalesce("m", F.lit(0)) + prior)
    return y.withColumn("p_cal", p).drop("base", "hits", "m")


def abstention(x: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, answered, accuracy): what is answered at each threshold of the score p, and how much of it is right.

    The grid is a parameter, so the cross join multiplies rows by a fixed number; partial sums are taken before a shuffle.
    """
    grid = x.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(taus)], "i int, tau double")
    y = x.crossJoin(F.broadcast(grid)).withColumn("kept", F.col("p") >= F.col("tau"))
    return y.groupBy("i", "tau").agg(
        F.avg(F.when(F.col("kept"), 1.0).otherwise(0.0)).alias("answered"),
        F.try_divide(F.count_if(F.col("kept") & F.col("correct")), F.count_if("kept")).alias("accuracy"),
        (F.count_if(F.col("kept") & F.col("correct")) / F.count(F.lit(1))).alias("right"),
    )


def crossfit_threshold(x: DataFrame, taus: list[float]) -> DataFrame:
    """(fold, tau, right): per fold, the threshold that was best on the other fold and how it does here."""
    grid = x.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(taus)], "i int, tau double")
    y = x.crossJoin(F.broadcast(grid))
    # Worth of a decision: 1 if right, 0 if declined, -1 if wrong.
    worth = F.when(F.col("p") < F.col("tau"), 0).when(F.col("correct"), 1).otherwise(-1)
    s = y.groupBy("fold", "i", "tau").agg(F.sum(worth).alias("worth"), F.count(F.lit(1)).alias("n"))
    best = s.groupBy("fold").agg(F.max_by("i", F.struct("worth", -F.col("i"))).alias("i")).withColumn("fold", 1 - F.col("fold"))
    return s.join(F.broadcast(best), ["fold", "i"]).select("fold", "tau", (F.col("worth") / F.col("n")).alias("worth"))


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """(grade, prob) of a calibration file; exactly the three grades, probabilities within 0..1."""
    schema = "probs map<string,double>, counts map<string,array<int>>, prior_strength double, prior_mean double, monotone boolean"
    x = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("probs").alias("grade", "prob"))
    rows = x.collect()  # three rows
    if {r[0] for r in rows} != set(GRADES) or not all(r[1] is not None and 0 <= r[1] <= 1 for r in rows):
        raise ValueError("a calibration map needs low, moderate and high with probabilities in 0..1")
    return x


def save_map(x: DataFrame, path: str) -> None:
    x.select(F.struct(*GRADES).alias("probs")).write.json(path)
