"""Score evaluation from one cumulative curve, plus threshold metrics and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.operators.ordering import row_at, running_sums
from riskloom.operators.quantile_cut import exact_quantiles


def score_curve(df: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """Per distinct score, highest first: rows and positives of the group and of all above it.

    Rows are grouped by score before anything is ordered, so tied scores -- however many -- are one
    row; the groups are then prefix-summed over range partitions.
    """
    groups = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label).cast("boolean")).alias("pos"))
    return running_sums(groups, [F.col("score").desc()], {"cum_n": F.col("n"), "cum_pos": F.col("pos")})


def _ranking_metrics() -> dict:
    """Aggregates over the curve; totals are the maxima of the running sums."""
    negatives = F.col("n") - F.col("pos")
    return {
        "rows": F.max("cum_n"), "positives": F.max("cum_pos"),
        "precision_weight": F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")),
        "pair_wins": F.sum(negatives * (F.col("cum_pos") - F.col("pos") / 2)),
    }


def ranking_summary(curve: DataFrame) -> DataFrame:
    """Average precision (step sum) and tie-aware ROC-AUC."""
    totals = curve.agg(*[m.alias(n) for n, m in _ranking_metrics().items()])
    return totals.select(
        "rows", "positives",
        F.try_divide("precision_weight", "positives").alias("pr_auc"),
        F.try_divide(F.col("pair_wins"), F.col("positives") * (F.col("rows") - F.col("positives"))).alias("roc_auc"))


def recall_at_fixed_fpr(curve: DataFrame, target_fpr: float = 0.01) -> DataFrame:
    """The curve's last point with FPR at most the target (full curve; recall 0 if there is none)."""
    totals = curve.agg(F.max("cum_n").alias("rows"), F.max("cum_pos").alias("positives"))
    points = curve.crossJoin(F.broadcast(totals)).select(
        "score", "cum_n", F.try_divide(F.col("cum_n") - F.col("cum_pos"), F.col("rows") - F.col("positives")).alias("fpr"),
        F.try_divide("cum_pos", "positives").alias("recall"))
    inside = F.col("fpr") <= target_fpr
    return points.agg(
        F.lit(target_fpr).alias("target_fpr"),
        F.coalesce(F.max_by(F.when(inside, F.col("fpr")), F.when(inside, F.col("cum_n"))), F.lit(0.0)).alias("actual_fpr"),
        F.coalesce(F.max_by(F.when(inside, F.col("recall")), F.when(inside, F.col("cum_n"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.min(F.when(inside, F.col("score"))), F.lit(float("inf"))).alias("threshold"))


def top_k_threshold(curve: DataFrame, k_frac: float = 0.02) -> float:
    """The k-th largest score, k = max(1, floor(rows * k_frac))."""
    rows = curve.agg(F.max("cum_n")).first()[0]
    k = max(1, int(rows * k_frac))
    return curve.filter(F.col("cum_n") >= k).agg(F.max("score")).first()[0]


def precision_recall_at_top_k(
    df: DataFrame, curve: DataFrame, k_frac: float = 0.02, score: str = "score", label: str = "is_fraud",
    tie: str = "transaction_id",
) -> DataFrame:
    """Exactly k rows count; inside the score group that straddles k the lowest ids come first."""
    totals = curve.agg(F.max("cum_n").alias("n"), F.max("cum_pos").alias("p")).first()
    k = max(1, int(totals["n"] * k_frac))
    edge = curve.filter(F.col("cum_n") >= k).orderBy(F.col("score").desc()).limit(1).first()
    room = k - (edge["cum_n"] - edge["n"])
    is_edge, positive = F.col(score).cast("double") == edge["score"], F.col(label).cast("boolean")
    taken = F.col(score).cast("double") > edge["score"]
    if room == edge["n"]:
        taken = taken | is_edge
    else:
        _, cut = row_at(df.filter(is_edge).select(F.lit(0).cast("long").alias("ts_us"), tie), room, tie=tie)
        taken = taken | (is_edge & (F.col(tie) < cut))
    return df.agg(F.count_if(taken & positive).alias("caught")).select(
        F.lit(float(k_frac)).alias("k_frac"), F.lit(k).cast("long").alias("k"),
        (F.col("caught") / k).alias("precision"),
        (F.col("caught") / totals["p"] if totals["p"] else F.lit(0.0)).alias("recall"))


def metrics_at_threshold(df: DataFrame, threshold: float, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """Confusion counts with precision, recall and F1 (0 where undefined)."""
    flagged, positive = F.col(score) >= threshold, F.col(label).cast("boolean")
    counts = df.agg(
        F.count_if(~flagged & ~positive).alias("tn"), F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"), F.count_if(flagged & positive).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        F.lit(float(threshold)).alias("threshold"), "tn", "fp", "fn", "tp",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]  # fixed values


def score_distribution(df: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """Per class: count, mean, sample deviation, minimum, five quantiles, maximum."""
    moments = df.groupBy(F.col(label).cast("boolean").alias("is_fraud")).agg(
        F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"))
    per_class = []
    for value in (False, True):
        cuts = exact_quantiles(df.filter(F.col(label).cast("boolean") == value), [score], QUANTILES)[score]
        per_class.append((value, *(cuts or [None] * len(QUANTILES))))
    names = ", ".join(f"p{int(q * 100)} double" for q in QUANTILES)
    quantiles = df.sparkSession.createDataFrame(per_class, f"is_fraud boolean, {names}")
    return moments.join(F.broadcast(quantiles), "is_fraud")


def score_histogram(df: DataFrame, score: str = "score", label: str = "is_fraud", bins: int = 40,
                    low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts per class and equal-width bin; the top edge belongs to the last bin."""
    bin_no = F.least(F.width_bucket(F.col(score), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    return df.groupBy(F.col(label).cast("boolean").alias("is_fraud"), bin_no.cast("long").alias("bin")).agg(
        F.count("*").alias("n"))


def full_evaluation(df: DataFrame, threshold: float, k_frac: float = 0.02, target_fpr: float = 0.01,
                    score: str = "score", label: str = "is_fraud") -> DataFrame:
    """All headline metrics of one score in one row; the curve is built once."""
    curve = score_curve(df, score, label)
    top = precision_recall_at_top_k(df, curve, k_frac, score, label)
    fpr = recall_at_fixed_fpr(curve, target_fpr)
    return (
        ranking_summary(curve)
        .crossJoin(metrics_at_threshold(df, threshold, score, label))
        .crossJoin(top.select("k", F.col("precision").alias("precision_at_k"), F.col("recall").alias("recall_at_k")))
        .crossJoin(fpr.select("actual_fpr", F.col("recall").alias("recall_at_fpr"),
                              F.col("threshold").alias("threshold_at_fpr")))
    )


def unsupervised_evaluation(df: DataFrame, score: str, label: str = "is_fraud") -> DataFrame:
    """AUC and precision/recall in the top 2 %; an unknown score counts as 0."""
    filled = df.withColumn("score", F.coalesce(score, F.lit(0.0)))
    curve = score_curve(filled, "score", label)
    top = precision_recall_at_top_k(filled, curve, 0.02, "score", label)
    return ranking_summary(curve).crossJoin(top).select(
        F.lit(score).alias("score_name"), F.round("roc_auc", 4).alias("auc"),
        F.round("precision", 4).alias("precision_at_top2pct"), F.round("recall", 4).alias("recall_at_top2pct"))


def error_analysis(df: DataFrame, threshold: float, segments: list[str], score: str = "score",
                   label: str = "is_fraud") -> DataFrame:
    """Outcome counts overall and per value of each segment column, in one pass.

    Grouping sets: () and one set per segment. ``segment`` names the column ('ALL' for overall).
    """
    flagged, positive = F.col(score) >= threshold, F.col(label).cast("boolean")
    counted = df.groupingSets(
        [[], *[[F.col(s)] for s in segments]], *[F.col(s) for s in segments]
    ).agg(
        F.count_if(positive & flagged).alias("tp"), F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(~positive & flagged).alias("fp"), F.count_if(~positive & ~flagged).alias("tn"),
        *[F.grouping(s).alias(f"_no_{s}") for s in segments])
    name, value = F.lit("ALL"), F.lit(None).cast("string")
    for s in segments:
        here = F.col(f"_no_{s}") == 0
        name, value = F.when(here, s).otherwise(name), F.when(here, F.col(s).cast("string")).otherwise(value)
    return counted.select(
        name.alias("segment"), value.alias("value"), "tp", "fn", "fp", "tn",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tp")).alias("fp_rate_of_flagged"),
    ).filter("segment = 'ALL' or value is not null")


def segment_performance(df: DataFrame, segment: str, threshold: float, score: str = "score",
                        label: str = "is_fraud") -> DataFrame:
    flagged, positive = F.col(score) >= threshold, F.col(label).cast("boolean")
    return df.groupBy(segment).agg(
        F.count("*").alias("n"), F.count_if(positive).alias("fraud_count"),
        F.avg(F.when(positive, flagged.cast("int"))).alias("recall"),
        F.avg(F.when(flagged, positive.cast("int"))).alias("precision"))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, time range and share of each split."""
    parts = df.groupBy("split").agg(
        F.count("*").alias("rows"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    total = parts.agg(F.sum("rows").alias("total_rows"))
    return parts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("rows") / F.col("total_rows"), 4))
