"""Scoring (M1-M4): a fitted ``ScoringModel`` = category levels + scaler statistics + Spark ML pipeline.

Scoring is one narrow plan (one-hot with the *training* levels, zero backfill of absent levels, fixed feature
order, scaling with the *saved* statistics, model transform, class index -> name); it runs unchanged on a batch
DataFrame or on a stream (M5). Re-fitting the scaler on the scored batch (the reference's web scorer) is an
explicit option because it makes a row's score depend on the rest of the batch.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.scalar import class_name
from riskframe.operators import encode, quality, scaling


@dataclass
class ScoringModel:
    id_col: str
    categorical: list[str]
    levels: dict[str, list]
    features: list[str]
    scaled: list[str]
    scaler: scaling.ScalerModel
    model: PipelineModel
    class_names: list[str]
    fill: dict | None = None      # training means of the numeric features (missing values at scoring time)

    # ---- fit ------------------------------------------------------------------------------------------------
    @classmethod
    def fit(cls, train: DataFrame, id_col: str, categorical: Sequence[str], numeric: Sequence[str], label: str,
            estimator, class_names: Sequence[str], scaled: Sequence[str] = ()) -> "ScoringModel":
        levels = encode.fit_levels(train, categorical)
        from riskframe.operators.stats import agg_row
        fill = agg_row(train, {c: F.avg(F.col(c).cast("double")) for c in numeric})
        enc, _ = encode.one_hot(train, categorical, levels=levels)
        enc = enc.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()
                               if v is not None})
        features = [*numeric, *[c for c in enc.columns if any(c.startswith(f"{k}_") for k in categorical)]]
        scaler = scaling.fit_standard(enc, list(scaled)) if scaled else scaling.ScalerModel("standard", {})
        data = scaler.transform(enc)
        pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                                estimator]).fit(data.withColumn("label", F.col(label).cast("double")))
        return cls(id_col, list(categorical), levels, features, list(scaled), scaler, pipe, list(class_names), fill)

    # ---- apply ----------------------------------------------------------------------------------------------
    def prepare(self, batch: DataFrame, refit_scaler: bool = False) -> DataFrame:
        enc, _ = encode.one_hot(batch, self.categorical, levels=self.levels)
        enc = quality.backfill_columns(enc, self.features, fill=0.0, keep=[self.id_col])
        if self.fill:   # a missing numeric value is scored at the training mean (F1 with fitted statistics)
            enc = enc.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.fill.items()
                                   if v is not None and c in enc.columns})
        if refit_scaler and self.scaled:
            return scaling.fit_standard(enc, self.scaled).transform(enc)
        return self.scaler.transform(enc)

    def score(self, batch: DataFrame, refit_scaler: bool = False) -> DataFrame:
        """M1: (id, prediction index, risk label, probability of the predicted class)."""
        from pyspark.ml.functions import vector_to_array
        out = self.model.transform(self.prepare(batch, refit_scaler))
        prob = vector_to_array("probability")
        return out.select(self.id_col, F.col("prediction").cast("int").alias("prediction"),
                          class_name("prediction", self.class_names).alias("risk"),
                          F.array_max(prob).alias("confidence"))

    # ---- persistence (A7) -----------------------------------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/pipeline")
        self.scaler.save(spark, f"{path}/scaler")
        meta = {"id_col": self.id_col, "categorical": self.categorical, "levels": self.levels,
                "features": self.features, "scaled": self.scaled, "class_names": self.class_names,
                "fill": self.fill}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ScoringModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(meta["id_col"], meta["categorical"], meta["levels"], meta["features"], meta["scaled"],
                   scaling.ScalerModel.load(spark, f"{path}/scaler"), PipelineModel.load(f"{path}/pipeline"),
                   meta["class_names"], meta.get("fill"))


def payload(scored: DataFrame, id_col: str, label_col: str = "risk", max_rows: int = 100000) -> str:
    """The reference's JSON response ``{"risk": {row: label}}`` for a bounded batch (checked size)."""
    rows = scored.select(id_col, label_col).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("batch too large for an inline payload; write the scored table instead")
    return json.dumps({"risk": {str(r[0]): r[1] for r in rows}})


# single-record contract: request field -> table column (fixed names of the request schema)
REQUEST_FIELDS = {"id": "PatientId", "age": "PatientAge", "sex": "PatientGender", "weight": "bmdtest_weight",
                  "height": "bmdtest_height", "parentbreak": "parentbreak", "alcohol": "alcohol",
                  "obreak": "obreak", "arthritis": "arthritis", "diabetes": "diabetes", "oralster": "oralster",
                  "smoke": "smoke"}


def record_frame(spark: SparkSession, record: Mapping, schema: str) -> DataFrame:
    """M2: one request record -> a 1-row DataFrame with table column names."""
    row = {REQUEST_FIELDS.get(k, k): v for k, v in record.items()}
    names = [f.split()[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], schema)

