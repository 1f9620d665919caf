"""The classification job: what its passes read."""

from pyspark.sql import functions as F

from riskframe.operators import explain, models as M
from riskframe.plans import training


def test_rebalanced_rows_are_made_once_and_copies_stay_in_their_task(spark, monkeypatch):
    h = lambda s, m: F.pmod(F.xxhash64("PatientId", F.lit(s)), F.lit(m))
    df = spark.range(400).select(F.col("id").alias("PatientId"), (h("a", 40) + 50).cast("double").alias("PatientAge"),
                                 (h("b", 150) / 10 + 18).alias("bmi"), h("s", 2).cast("int").alias("smoke"))
    df = df.withColumn("band", F.when(F.col("PatientAge") + h("n", 20) > 85, 2).otherwise(0))
    fitted, plain = [], M.pipeline

    def recorded(feats, est):
        pipe = plain(feats, est)
        fit = pipe.fit
        pipe.fit = lambda train: (fitted.append(train._jdf.queryExecution().executedPlan().toString()), fit(train))[1]
        return pipe
    monkeypatch.setattr(M, "pipeline", recorded)
    monkeypatch.setattr(explain, "_donor_copies", None)
    rows = training.classification_pipeline(df, ["PatientAge", "bmi", "smoke"], "band", n_iter=1, folds=2, repeats=2).collect()
    assert len(fitted) == 1 and "Join" not in fitted[0] and "Exchange" not in fitted[0]      # written rows
    found = {r.metric: r.value for r in rows}
    assert {f"perm_increase_{f}" for f in ("PatientAge", "bmi", "smoke")} <= set(found) and found["rows_after_rebalance"] % 2 == 0
