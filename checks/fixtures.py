"""Score, case and action-log fixtures derived from the driver tables without any model.

They give the scoring and case operators inputs whose values SQL can restate.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.ordering import chronological_split
from riskloom.plans.alerts import generate_alerts, generate_cases
from riskloom.plans.anomaly import AnomalySlices
from riskloom.plans.features import transaction_features
from riskloom.plans.matrix import feature_matrix
from riskloom.plans.models import fit_boosted, fit_logistic, prepare
from riskloom.plans.rules import apply_rules
from riskloom.plans.scoring import ScoringConstants, score_transactions
from riskloom.session import cut_lineage, ensure_checkpoint_dir, kept, size_tasks, tune
from riskloom.sources import Star, star_from_driver_tables
from riskloom.sources.driver_view import transactions_of
from riskloom.sources.star import labelled

#: Rows of an arriving file, at least, where a step of time has several.
ARRIVAL_ROWS = 500_000
_BENCHES: dict[tuple[str, str], Workbench] = {}


def workbench(spark: SparkSession, sf_dir: str) -> Workbench:
    """One per application and data folder: queries share its written intermediate tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BENCHES:
        _BENCHES[key] = Workbench(spark, sf_dir)
    return _BENCHES[key]


class Workbench:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self.star: Star = star_from_driver_tables(spark, sf_dir)
        size_tasks(spark, self.star.txn.count())

    @cached_property
    def labelled(self) -> DataFrame:
        return labelled(self.star.txn, self.star.labels)

    @cached_property
    def slices(self) -> AnomalySlices:
        return AnomalySlices.plan(self.star)

    @cached_property
    def features(self) -> DataFrame:
        return kept(transaction_features(self.star, slicing=self.slices.customer_days))

    @cached_property
    def firings(self) -> DataFrame:
        return kept(apply_rules(self.features))

    @cached_property
    def matrix(self) -> DataFrame:
        """Stored once: the split is an expression over the stored rows."""
        return chronological_split(kept(feature_matrix(self.star, slices=self.slices)))

    @cached_property
    def _scoring(self) -> tuple[DataFrame, ScoringConstants]:
        ml = F.least(F.lit(1.0), F.col("amount") / 500)
        forest = (F.col("transaction_id") % 100) / 100.0
        return score_transactions(self.matrix, ml, forest)  # expressions over the stored matrix, not stored again

    @property
    def scored(self) -> DataFrame:
        return self._scoring[0]

    @property
    def constants(self) -> ScoringConstants:
        return self._scoring[1]

    @cached_property
    def alerts(self) -> DataFrame:
        return cut_lineage(generate_alerts(self.scored, self.star.txn, self.slices.customer_days))

    @cached_property
    def opened(self) -> DataFrame:
        """Cases as created, before anybody worked on them."""
        return generate_cases(self.alerts)

    @cached_property
    def now(self):
        return self.star.txn.agg(F.max("transaction_ts")).first()[0]

    @cached_property
    def cases(self) -> DataFrame:
        """Cases after (deterministic) work: seven of eight closed."""
        flags = self.alerts.join(self.star.labels.select("transaction_id", "is_fraud"), "transaction_id", "left").select(
            "alert_id", F.coalesce("is_fraud", F.lit(False)).alias("_fraud"))
        i, closed = F.col("alert_id"), F.col("alert_id") % 8 != 0
        verdict = F.when(F.col("_fraud") != (i % 10 == 0), "CONFIRMED_FRAUD").otherwise("FALSE_POSITIVE")
        return self.opened.join(flags, "alert_id").select(
            "case_id", "alert_id", "customer_id",
            F.when(closed, "CLOSED").when(F.col("risk_tier") == "CRITICAL", "ESCALATED").otherwise("IN_REVIEW").alias("status"),
            F.concat(F.lit("inv_"), (i % 6).cast("string")).alias("assigned_investigator"),
            "sla_deadline", F.when(closed, verdict).alias("resolution"), "created_at",
            F.when(closed, F.col("created_at") + F.make_interval(hours=(i % 30).cast("int"))).alias("resolved_at"),
            "risk_tier")

    @cached_property
    def log(self) -> DataFrame:
        """The action log behind ``cases``, plus one invalid action on every 17th case."""
        critical, closed = F.col("risk_tier") == "CRITICAL", F.col("status") == "CLOSED"

        def act(seq: int, action, when=None):
            body = F.struct(F.lit(seq).cast("long").alias("seq"), (F.lit(action) if isinstance(action, str) else action).alias("action_type"))
            return body if when is None else F.when(when, body)

        verdict = F.when(F.col("resolution") == "CONFIRMED_FRAUD", "CONFIRM_FRAUD").otherwise("MARK_FALSE_POSITIVE")
        steps = F.array_compact(F.array(
            act(1, "ASSIGN"), act(2, "INVESTIGATE"), act(3, "ESCALATE", critical), act(4, verdict, closed),
            act(5, "CLOSE", closed),
            act(6, F.when(closed, "ESCALATE").otherwise("REOPEN"), F.col("case_id") % 17 == 0)))
        who = F.col("assigned_investigator")
        return self.cases.select("*", F.inline(steps)).select(
            "case_id", "seq", "action_type",
            F.when(F.col("action_type") == "ASSIGN", "system").otherwise(who).alias("performed_by"),
            F.when(F.col("action_type") == "ASSIGN", who).alias("investigator"),
            F.concat_ws(" ", F.lit("step"), "seq").alias("notes"),
            F.when(F.col("action_type") == "CLOSE", F.col("resolved_at")).otherwise(
                F.col("created_at") + F.make_interval(mins=F.col("seq").cast("int"))).alias("performed_at"))

    @cached_property
    def prepared(self):
        return prepare(self.matrix)

    @cached_property
    def logistic(self):
        return fit_logistic(self.prepared.part("train"))

    @cached_property
    def boosted(self):
        return fit_boosted(self.prepared.part("train"), self.prepared.part("validation"))

    # ---- streaming: the events file as a file source, results written to the shared folder
    @cached_property
    def _arrivals(self) -> tuple[str, int]:
        """The events in four steps of time, so that a stream takes four micro-batches and carries state over.

        The folder, and how many files a step has: one, or as many as the rows of the smallest step are enough for.
        """
        folder = self.run_folder("arrivals")
        events = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        first, last = events.agg(F.min("ts"), F.max("ts")).first()
        part = F.least(F.lit(3), F.floor(4 * (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")))
                                         / F.greatest(F.lit(1), F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")))))
        sizes = events.agg(*[F.count_if(part == quarter) for quarter in range(4)]).first()
        files = max(1, min(sizes) // ARRIVAL_ROWS)
        for quarter in range(4):
            rows = events.filter(part == quarter)
            (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(folder)
        return folder, files

    @property
    def arriving(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        folder, files = self._arrivals
        return transactions_of(self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder))

    def run_folder(self, name: str) -> str:
        """A new folder per run beside the checkpoints, which every executor can reach."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:8]}"

    def finish(self, streaming: DataFrame, name: str) -> DataFrame:
        """Runs the stream over all available input and returns what it wrote."""
        run = self.run_folder(name)
        query = (streaming.writeStream.format("parquet").option("path", f"{run}/out")
                 .option("checkpointLocation", f"{run}/progress").trigger(availableNow=True).start())
        query.awaitTermination()
        return self.spark.read.schema(streaming.schema).parquet(f"{run}/out")
