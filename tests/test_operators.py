"""Operators on small hand-written frames: dedupe order, label filter, modes, imputers, encoding, splits."""

import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import encode, gram as G, impute, models as M, quality, sampling


def test_dedupe_keeps_first_in_file_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b"), (1, 2, "x")], "PatientId int, row_seq int, v string")
    got = sorted((r.PatientId, r.v) for r in quality.dedupe_first(df).collect())
    assert got == [(1, "a"), (2, "b")]


def test_drop_label_zero_keeps_null(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (2,)], "l int")
    assert sorted(r.l for r in quality.drop_label_value(df, "l").collect() if r.l is not None) == [1, 2]
    assert quality.drop_label_value(df, "l").count() == 3


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (None,), (2,)], "x int")
    out, stats = impute.ModeFill(["x"]).fit_apply(df)
    assert stats["mode__x"] == 1
    assert out.filter(F.col("x").isNull()).count() == 0


def test_group_mean_fill_skips_null_group(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 0.0), (1, None), (2, 4.0), (None, None)], "g int, v double")
    out, _ = impute.GroupMeanFill(["v"], "g", (1, 2)).fit_apply(df)
    vals = [(r.g, r.v) for r in out.collect()]
    assert (1, 5.0) in vals and vals.count((1, 5.0)) == 2      # mean of {10, 0} includes the zero
    assert (None, None) in vals


def test_two_step_bmi_fill(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (40.0,), (None,)], "bmi double")
    out, _ = impute.TwoStepMeanFill("bmi").fit_apply(df)
    got = sorted(r.bmi for r in out.collect())
    m1 = 20.0
    m2 = (m1 + 20.0 + 40.0) / 3
    assert got == sorted([m1, 20.0, 40.0, m2])


def test_one_hot_levels_absent_and_new(spark):
    train = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, c int")
    levels = encode.fit_levels(train, ["c"])
    batch = spark.createDataFrame([(4, 0), (5, 7), (6, None)], "id int, c int")
    out, _ = encode.one_hot(batch, ["c"], levels=levels)
    assert sorted(out.columns) == ["c_0", "c_1", "c_2", "id"]
    rows = {r.id: (r.c_0, r.c_1, r.c_2) for r in out.collect()}
    assert rows[4] == (1, 0, 0) and rows[5] == (0, 0, 0) and rows[6] == (0, 0, 0)


def test_dense_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = quality.dense_row_numbers(df, "k", "rn", num_partitions=5)
    got = sorted((r.k, r.rn) for r in out.collect())
    assert got == [(k, k) for k in range(1000)]


def test_hash_split_deterministic(spark):
    df = spark.range(2000).withColumnRenamed("id", "PatientId")
    a = sampling.with_split(df, "PatientId", 20, 2).filter("split = 'test'").count()
    b = sampling.with_split(df, "PatientId", 20, 2).filter("split = 'test'").count()
    assert a == b and 300 < a < 500


def test_gram_ols_matches_spark_ml(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + 3.0 + rng.normal(scale=0.1, size=500)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)],
                               "a double, b double, c double, label double")
    s = G.gram(df, ["a", "b", "c"], "label")[None]
    fit = M.ols(s, ["a", "b", "c"])
    ml = M.pipeline(["a", "b", "c"], M.linear_regression()).fit(df).stages[-1]
    assert np.allclose(fit.coef, ml.coefficients.toArray(), atol=1e-8)
    assert abs(fit.intercept - ml.intercept) < 1e-8
    assert np.allclose(M.ridge(s, ["a", "b", "c"], 1e-12).coef, fit.coef, atol=1e-6)


def test_sigma_filter_zero_variance_removes_all(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "h double")
    out, _ = quality.sigma_filter(df, ["h"])
    assert out.count() == 0


def test_smote_reaches_parity(spark):
    from riskframe.operators.smote import smote_nc
    rows = [(i, 0, float(i % 17), float(i % 5), i % 2) for i in range(60)] + \
           [(100 + i, 1, float(i), float(i % 3), 1) for i in range(13)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, g int")
    out = smote_nc(df, "y", "id", ["a", "b"], ["g"])
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 60, 1: 60}
    syn = out.filter("synthetic > 0")
    lo, hi = syn.agg(F.min("a"), F.max("a")).first()
    assert 0.0 <= lo and hi <= 12.0


def test_exact_quantiles(spark):
    from riskframe.operators import profile
    vals = [float((i * 37) % 101) / 3.0 for i in range(997)] + [None] * 5
    df = spark.createDataFrame([(v, None if v is None else v * 2) for v in vals], "a double, b double")
    want = np.percentile(np.array([v for v in vals if v is not None]), [25, 50, 75])
    got = profile._quantiles_from_freq(profile.frequency_table(df, ["a", "b"]), (0.25, 0.5, 0.75))
    assert np.allclose(got["a"], want) and np.allclose(got["b"], want * 2)


def test_dedupe_keeps_the_first_row_without_a_key(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), (1, 3, "c"), (1, 4, "d")],
                               "PatientId int, row_seq int, v string")
    assert sorted(r.v for r in quality.dedupe_first(df).collect()) == ["a", "c"]
    kept = quality.keep_max_per_key(df.withColumn("f", F.col("row_seq") % 3), "PatientId", "f", "v")
    assert sorted(r.v for r in kept.collect()) == ["b", "d"]


def test_open_group_fill_leaves_rows_without_group_or_mean(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 0.0), (None, 0.0), (None, None), (2, None), (3, 4.0)], "g int, v double")
    got = sorted([(r.g, r.v) for r in impute.group_mean_fill_any(df, ["v"], "g").collect()], key=str)
    assert got == sorted([(1, 10.0), (1, 5.0), (None, 0.0), (None, None), (2, None), (3, 4.0)], key=str)


def test_every_row_is_in_one_part_of_a_split(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "PatientId int")
    train, test = sampling.hash_split(df, "PatientId", 50)
    assert train.count() + test.count() == 3
    sample = sampling.fraction_sample(df, "PatientId", 0.5)
    from riskframe.operators.joins import complement
    assert sample.count() + complement(df, sample, "PatientId").count() == 3


def test_levels_have_an_exact_bound_and_codes_none(spark):
    df = spark.range(50).select(F.col("id").alias("c"), F.lit(None).cast("string").alias("d"))
    assert encode.fit_levels(df, ["c", "d"], 50) == {"c": list(range(50)), "d": []}
    import pytest
    with pytest.raises(encode.TooManyLevelsError):
        encode.fit_levels(df, ["c"], 49)
    big = spark.range(3000).select((F.col("id") * 7 % 3000).cast("string").alias("c"))
    coded, codes = encode.label_encode(big, "c", out="code")
    order = {v: i for i, v in enumerate(sorted(str(i) for i in range(3000)))}
    assert {r.c: r.code for r in coded.collect()} == order and codes.count() == 3000


def test_gram_keeps_digits_at_a_large_offset(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    y = 2.001 * x + rng.normal(scale=0.1, size=5000)
    rows = [(float(a) + 1e7, float(b) - 3e6, i % 3) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, fold int")
    want = float(np.cov(x, y)[0, 1] / x.var(ddof=1))
    s = G.gram(df, ["x"], "y")[None]
    fit = M.ols(s, ["x"])
    assert abs(fit.coef[0] - want) < 1e-6
    assert abs(M.sse_on(s, fit) - float(((y - y.mean() - want * (x - x.mean())) ** 2).sum())) < 1e-3
    per = G.gram(df, ["x"], "y", group="fold")
    total = G.combine(list(per.values()))
    part = M.ols(G.minus(total, per["0"]), ["x"])
    keep = np.arange(5000) % 3 != 0
    assert abs(part.coef[0] - np.cov(x[keep], y[keep])[0, 1] / x[keep].var(ddof=1)) < 1e-6


def test_class_weights_skip_rows_without_a_label(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "l string")
    got = {(r.l, r.weight) for r in sampling.class_weights(df, "l").collect()}
    assert got == {("a", 4 / 6), ("b", 2.0), (None, None)}


def test_a_cluster_must_name_its_shared_folder():
    import pytest
    from riskframe import session

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
    assert session.is_local("local[4]") and not session.is_local("local-cluster[3,2,1000]")


def test_smote_reaches_parity_whatever_the_partitions(spark, monkeypatch):
    from riskframe.operators import neighbours, smote
    monkeypatch.setattr(neighbours.k_nearest, "__defaults__", (5, 16))
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 5 == 0), float(rng.normal() * (3 if i % 5 else 1)), float(rng.normal() * 10), int(rng.integers(3)))
            for i in range(400)] + [(400, None, 1.0, 1.0, 0)]
    base = spark.createDataFrame(rows, "id int, y int, a double, b double, c int")
    seen = []
    for parts in (1, 4, 16):
        out = smote.smote_nc(base.repartition(parts), "y", "id", ["a", "b"], ["c"], seed=3)
        assert {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 320, 1: 320, None: 1}
        seen.append(sorted(tuple(r) for r in out.filter("synthetic > 0").collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 240
    mine = np.array([[r[2], r[3]] for r in rows if r[1] == 1])
    made = np.array([[r[2], r[3]] for r in seen[0]])
    assert (made >= mine.min(0) - 1e-9).all() and (made <= mine.max(0) + 1e-9).all()
    assert {r[4] for r in seen[0]} <= {0, 1, 2}


def test_smote_neighbours_match_brute_force(spark):
    """The only neighbour of each row is one of the two next to it."""
    from riskframe.operators.smote import smote_nc
    rows = [(i, 1, float(i), 0) for i in range(6)] + [(100 + i, 0, float(-i), 1) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, y int, a double, c int")
    made = smote_nc(df, "y", "id", ["a"], ["c"], k=1).filter("synthetic > 0").collect()
    assert len(made) == 6 and all(r.c == 0 and abs(r.a - r.id) <= 1.0 for r in made)
