"""Quality measures as aggregates: label sets, probabilities, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _prf(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> tuple[Column, Column, Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    b = beta * beta
    return p, r, F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))


def label_counts(gold: DataFrame, pred: DataFrame, *by: str) -> DataFrame:
    """(by..., tp, fp, fn) of (doc_id, label) sets."""
    g = gold.select("doc_id", "label").distinct().withColumn("g", F.lit(1))
    x = g.join(pred.select("doc_id", "label").distinct().withColumn("p", F.lit(1)), ["doc_id", "label"], "full_outer")
    return x.groupBy(*by).agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
    )


def micro_macro(gold: DataFrame, pred: DataFrame, beta: float = 1.0, all_labels: bool = False) -> DataFrame:
    """(average, precision, recall, f): micro over all pairs; macro over labels of gold (or over all labels)."""
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"), beta)
    micro = label_counts(gold, pred).select(F.lit("micro").alias("average"), p.alias("precision"), r.alias("recall"), f.alias("f"))
    per = label_counts(gold, pred, "label")
    per = per if all_labels else per.where("tp + fn > 0")
    macro = per.select(p.alias("p"), r.alias("r"), f.alias("f")).agg(
        F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f")
    ).select(F.lit("macro").alias("average"), "precision", "recall", "f")
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f")]
    return micro.unionByName(macro).select("average", *rounded)


def per_label_f1(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, support, f1) of labels in gold."""
    _, _, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return label_counts(gold, pred, "label").where("tp + fn > 0").select("label", (F.col("tp") + F.col("fn")).alias("support"), F.round(f, 9).alias("f1"))


def brier(x: DataFrame, p: str = "p", correct: str = "correct") -> DataFrame:
    y = F.when(F.col(correct), 1.0).otherwise(0.0)
    return x.agg(F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"))


def reliability(x: DataFrame, bins: int = 10, p: str = "p", correct: str = "correct") -> DataFrame:
    """(bin, mean_p, accuracy, n) of the bins that hold anything; p = 1 is in the last."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    y = F.when(F.col(correct), 1.0).otherwise(0.0)
    return x.groupBy(b).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def ece(x: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error."""
    r = reliability(x, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def contingency(x: DataFrame, *by: str) -> DataFrame:
    """(by..., truth, predicted, n, n_truth, n_predicted, n_all)."""
    c = x.groupBy(*by, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(*by, "truth").agg(F.sum("n").alias("n_truth"))
    q = c.groupBy(*by, "predicted").agg(F.sum("n").alias("n_predicted"))
    a = c.groupBy(*by).agg(F.sum("n").alias("n_all"))
    c = c.join(t, [*by, "truth"]).join(q, [*by, "predicted"])
    return c.join(a, list(by)) if by else c.crossJoin(F.broadcast(a))


def adjusted(same: Column, truth: Column, predicted: Column, n: Column) -> Column:
    """The adjusted Rand index of numbers of pairs: alike in both, in truth, in prediction; 1 where there is no spread."""
    expected = F.try_divide(truth * predicted, n * (n - 1) / 2.0)
    spread = (truth + predicted) / 2 - expected
    return F.when(F.coalesce(F.round(spread, 9), F.lit(0.0)) == 0, 1.0).otherwise((same - expected) / spread)


def partition_scores(x: DataFrame, *by: str) -> DataFrame:
    """(by..., purity, nmi, ari, n_clusters) of (truth, predicted): arithmetic NMI; degenerate cases count as 1."""
    c = contingency(x, *by)
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2.0
    share = lambda n: F.col(n) / F.col("n_all")
    cell = c.groupBy(*by).agg(
        F.sum(share("n") * F.log(share("n") / (share("n_truth") * share("n_predicted")))).alias("mi"),
        F.sum(pairs("n")).alias("same"), F.max("n_all").alias("n_all"),
    )
    best = c.groupBy(*by, "predicted").agg(F.max("n").alias("m"), F.max("n_all").alias("a")).groupBy(*by).agg(
        (F.sum("m") / F.max("a")).alias("purity"), F.count(F.lit(1)).alias("n_clusters")
    )
    side = lambda col, name: (
        c.select(*by, col, f"n_{col}", "n_all").distinct().groupBy(*by).agg(
            F.sum(-share(f"n_{col}") * F.log(share(f"n_{col}"))).alias(f"h_{name}"), F.sum(pairs(f"n_{col}")).alias(f"p_{name}")
        )
    )
    x = cell
    for other in (best, side("truth", "t"), side("predicted", "p")):
        x = x.join(other, list(by)) if by else x.crossJoin(F.broadcast(other))
    mean_h = (F.col("h_t") + F.col("h_p")) / 2
    return x.select(
        *by, F.round("purity", 9).alias("purity"),
        F.round(F.when(F.round(mean_h, 12) == 0, 1.0).otherwise(F.col("mi") / mean_h), 9).alias("nmi"),
        F.round(adjusted(F.col("same"), F.col("p_t"), F.col("p_p"), F.col("n_all")), 9).alias("ari"), "n_clusters",
    )
