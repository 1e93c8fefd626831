"""How a model's score holds up from period to period, against the population it was frozen on.

Bins are quantiles of a reference population and stay fixed. Everything else comes from one grouped pass: rows and positives per
period and score. Histograms are sums of it and may be merged over periods; the curves are its running sums over (period, score), in
range partitions, less what earlier periods hold. So a period may have any share of the rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.operators.ordering import running_sums
from riskloom.operators.quantile_cut import exact_quantiles
from riskloom.session import cut_lineage

BINS = 10
#: An empty bin counts as this share, so that the index stays finite.
LEAST_SHARE = 1e-4


@dataclass(frozen=True)
class FrozenBins:
    """Cuts between the bins and the reference's share of each bin. A score at a cut belongs to the bin above it."""

    cuts: list[float]
    shares: list[float]

    @classmethod
    def of(cls, reference: DataFrame, score: str, bins: int = BINS) -> FrozenBins:
        found = exact_quantiles(reference, [score], [i / bins for i in range(1, bins)])[score]
        cuts = sorted({c for c in found if c is not None})
        own = cls(cuts, [0.0] * (len(cuts) + 1))
        counts = dict(reference.filter(F.col(score).isNotNull()).groupBy(own.number(F.col(score))).count().collect())
        total = sum(counts.values())
        return cls(cuts, [counts.get(i, 0) / total if total else 0.0 for i in range(len(cuts) + 1)])

    def number(self, score: Column) -> Column:
        """Number of the bin, by halving the list of cuts."""
        def part(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(score >= self.cuts[middle], part(middle + 1, high)).otherwise(part(low, middle))

        return part(0, len(self.cuts))

    def number_of(self, score: float) -> int:
        return bisect_right(self.cuts, score)


def score_groups(df: DataFrame, period: Column, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """Rows and positives per period and score; rows without a score count nowhere."""
    return df.filter(F.col(score).isNotNull()).groupBy(period.alias("period_start"), F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label).cast("boolean")).alias("pos"))


def histograms(groups: DataFrame, bins: FrozenBins) -> DataFrame:
    """period_start, bin, n, pos. Sums of these rows over periods are the histogram of the longer period."""
    return groups.groupBy("period_start", bins.number(F.col("score")).cast("long").alias("bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def stability_index(found: DataFrame, bins: FrozenBins) -> DataFrame:
    """Population stability index of each period: sum over bins of (share - reference) * ln(share / reference)."""
    of_bin = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).alias(f"b{i}") for i in range(len(bins.shares))]
    wide = found.groupBy("period_start").agg(F.sum("n").alias("rows"), *of_bin)
    total = F.lit(0.0)
    for i, share in enumerate(bins.shares):
        reference = max(share, LEAST_SHARE)
        own = F.greatest(F.col(f"b{i}") / F.col("rows"), F.lit(LEAST_SHARE))
        total = total + (own - reference) * (F.log(own) - math.log(reference))
    return wide.select("period_start", total.alias("psi_score"))


def monitor(df: DataFrame, bins: FrozenBins, period: Column, period_end: Column, model_name: str, model_version: str,
            score: str = "score", label: str = "is_fraud", tie: str = "transaction_id", k_frac: float = 0.02,
            target_fpr: float = 0.01) -> DataFrame:
    """One row per period: precision in the top ``k_frac``, recall at ``target_fpr``, average precision, stability index, fraud rate.

    ``period`` is an expression of a row, ``period_end`` one of ``period_start``. Of tied scores at the edge of the top
    the lowest ids count. A ratio without a denominator is null.
    """
    groups = cut_lineage(score_groups(df, period, score, label))
    by_period = groups.groupBy("period_start").agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    before = W.orderBy("period_start").rowsBetween(W.unboundedPreceding, -1)  # one row per period
    totals = cut_lineage(by_period.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("rows", "positives")]))
    curve = running_sums(groups, [F.col("period_start").asc(), F.col("score").desc()], {"all_n": F.col("n"), "all_pos": F.col("pos")})
    curve = curve.join(totals, "period_start").withColumns({
        "cum_n": F.col("all_n") - F.col("before_rows"), "cum_pos": F.col("all_pos") - F.col("before_positives"),
        "k": F.greatest(F.lit(1), F.floor(F.col("rows") * k_frac)).cast("long")})
    false_rate = F.try_divide(F.col("cum_n") - F.col("cum_pos"), F.col("rows") - F.col("positives"))
    edge = (F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k"))
    told = cut_lineage(curve.groupBy("period_start").agg(
        F.max("rows").alias("rows"), F.max("positives").alias("positives"), F.max("k").alias("k"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("weight"),
        F.max(F.when(false_rate <= target_fpr, F.col("cum_pos"))).alias("caught"),
        F.max(F.when(edge, F.struct("score", "n", (F.col("cum_pos") - F.col("pos")).alias("above"),
                                    (F.col("k") - F.col("cum_n") + F.col("n")).alias("room")))).alias("edge")))
    taken = _first_of_edge(df, told, period, score, label, tie)
    return (told.join(taken, "period_start", "left").join(stability_index(histograms(groups, bins), bins), "period_start").select(
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"), "period_start",
        period_end.alias("period_end"),
        ((F.col("edge.above") + F.coalesce("taken", F.lit(0))) / F.col("k")).alias("precision_at_k"),
        F.try_divide(F.coalesce("caught", F.lit(0)), "positives").alias("recall_at_fpr"),
        F.try_divide("weight", "positives").alias("pr_auc"), "psi_score", (F.col("positives") / F.col("rows")).alias("fraud_rate")))


def _first_of_edge(df: DataFrame, told: DataFrame, period: Column, score: str, label: str, tie: str) -> DataFrame:
    """period_start, taken: positives among the first ids of the tied group in which the top of a period ends."""
    order = W.orderBy("period_start").rowsBetween(W.unboundedPreceding, -1)  # one row per period
    edges = told.select("period_start", F.col("edge.score").alias("score"), F.col("edge.room").alias("room"),
                        F.coalesce(F.sum("edge.n").over(order), F.lit(0)).alias("earlier"))
    rows = df.select(period.alias("period_start"), F.col(score).cast("double").alias("score"), F.col(tie).alias("tie"),
                     F.col(label).cast("boolean").alias("positive")).join(edges, ["period_start", "score"])
    ranked = running_sums(rows, [F.col("period_start").asc(), F.col("tie").asc()], {"at": F.lit(1).cast("long")})
    return ranked.filter(F.col("at") - F.col("earlier") <= F.col("room")).groupBy("period_start").agg(F.count_if("positive").alias("taken"))
