"""Fitted models kept in a folder: score a new day, or explain given rows, without training again."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.plans.attribution import top_contributors, tree_contributions
from riskloom.plans.forest import Forest
from riskloom.plans.models import Prepared, with_probability
from riskloom.plans.preprocess import Preprocessor
from riskloom.plans.scoring import ScoringConstants, risk_scores, with_components, with_tiers


@dataclass(frozen=True)
class FittedModels:
    """Everything that scoring learns from data. All of it is bounded by the models' own parameters."""

    forest: Forest
    preprocessor: Preprocessor
    boosted: GBTClassificationModel
    constants: ScoringConstants

    @staticmethod
    def of(prepared: Prepared, boosted: GBTClassificationModel, constants: ScoringConstants) -> FittedModels:
        return FittedModels(prepared.forest, prepared.preprocessor, boosted, constants)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Parquet for the constants and the forest's nodes, MLlib's writer for the trees."""
        forest, nodes = asdict(self.forest), self.forest.nodes
        del forest["nodes"]
        constants = {"forest": forest, "roots": nodes["roots"].tolist(), "depth": int(nodes["depth"]),
                     "preprocessor": asdict(self.preprocessor),
                     "scoring": {"exposure_cap": self.constants.exposure_cap, "tier_cutpoints": dict(self.constants.tier_cutpoints)}}
        spark.createDataFrame([(json.dumps(constants),)], "constants string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/constants")
        arrays = {k: v for k, v in nodes.items() if k not in ("roots", "depth")}
        table = pd.DataFrame({"node": np.arange(len(arrays["path"])), **arrays})
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{folder}/forest")
        self.boosted.write().overwrite().save(f"{folder}/boosted")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> FittedModels:
        stored = json.loads(spark.read.parquet(f"{folder}/constants").first()[0])
        table = spark.read.parquet(f"{folder}/forest").toPandas().sort_values("node")
        nodes = {c: table[c].to_numpy() for c in table.columns if c != "node"}
        nodes.update(roots=np.array(stored["roots"]), depth=np.array(stored["depth"]))
        return FittedModels(
            Forest(nodes=nodes, **stored["forest"]), Preprocessor(**stored["preprocessor"]),
            GBTClassificationModel.load(f"{folder}/boosted"), ScoringConstants(**stored["scoring"]))

    def encoded(self, matrix: DataFrame) -> DataFrame:
        """``matrix`` with the forest's score and the model's input."""
        return self.preprocessor.transform(self.forest.score(matrix), False, "plain")

    def score(self, matrix: DataFrame) -> DataFrame:
        """Risk scores of the rows of a feature matrix; no row needs a split."""
        rows = with_probability(self.encoded(matrix), self.boosted, "ml_probability")
        parts = with_components(rows, self.constants.exposure_cap, F.col("ml_probability"), F.col("isolation_forest_score"))
        return risk_scores(with_tiers(parts, self.constants.tier_cutpoints))

    def explain(self, matrix: DataFrame, ids: DataFrame, top_n: int = 6) -> DataFrame:
        """Largest contributions, with the features' values, of the rows whose transaction_id is in ``ids``."""
        chosen = matrix.join(ids.select("transaction_id").distinct(), "transaction_id", "left_semi")
        if "split" not in chosen.columns:
            chosen = chosen.withColumn("split", F.lit(None).cast("string"))
        return top_contributors(tree_contributions(self.encoded(chosen), self.boosted), self.preprocessor.names, top_n)
