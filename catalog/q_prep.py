"""G (encoding / reshaping), H (sampling / splits), I (scaling), N (feature switches), T (joins) queries + oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import q, rnd
from catalog.sqlparts import cte, frax_sql, height_sql, rd, weight_sql
from riskframe.fixtures import patients, read_table
from riskframe.functions import rules, scalar, units
from riskframe.operators import encode, joins, quality, sampling, scaling
from riskframe.plans.cleaning import clean_caroc
from riskframe.session import scratch_path
from riskframe.streaming import scorer

P = cte()


def _caroc():
    from catalog.oracles import _CAROC
    return _CAROC


def _union(parts):
    return " UNION ALL ".join(parts)


# ---- G ---------------------------------------------------------------------------------------------------------
# fixed categorical feature lists of the classification and regression preparation steps
CLASSIFIER_CATEGORICAL = ["parentbreak", "alcohol", "arthritis", "cancer", "diabetes", "heartdisease", "oralster",
                          "smoke", "respdisease", "ptunsteady", "wasfractdue2fall", "ptfall", "bmdtest_10yr_caroc"]
REGRESSOR_CATEGORICAL = ["parentbreak", "alcohol", "ptunsteady", "wasfractdue2fall", "ptfall", "ankle", "clavicle",
                         "shoulder", "elbow", "femur", "wrist", "tibfib"]
# levels of the cleaned fixture (the oracle states them; Spark fits them)
_LEVELS = {c: [0, 1] for c in CLASSIFIER_CATEGORICAL + REGRESSOR_CATEGORICAL}
_LEVELS.update({"ptunsteady": [0, 1, 2], "bmdtest_10yr_caroc": [1, 2]})   # oralster 2 never survives cleaning


def _onehot_sql(cols, prefix="", drop_first=False, src="caroc", keep="PatientId"):
    parts = []
    for c in cols:
        lv = _LEVELS[c][1:] if drop_first else _LEVELS[c]
        for v in lv:
            parts.append(f'CASE WHEN {c} = {v} THEN 1 ELSE 0 END AS "{prefix}{c}_{float(v)}"')
    return f"SELECT {keep}, " + ", ".join(parts) + f" FROM {src}"


@q("g1_one_hot", _caroc() + _onehot_sql(CLASSIFIER_CATEGORICAL))
def g1_one_hot(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *CLASSIFIER_CATEGORICAL)
    out, _ = encode.one_hot(c, CLASSIFIER_CATEGORICAL, float_names=True)
    return out


@q("g2_one_hot_drop_first", _caroc() + _onehot_sql(REGRESSOR_CATEGORICAL, "pt_response_", True))
def g2_one_hot_drop_first(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *REGRESSOR_CATEGORICAL)
    out, _ = encode.one_hot(c, REGRESSOR_CATEGORICAL, drop_first=True, prefix="pt_response_", float_names=True)
    return out


_G3 = ["oralster", "ptunsteady", "alcohol"]


@q("g3_reference_levels", P + _onehot_sql(_G3, src="patients", keep="row_seq"))
def g3_reference_levels(spark, sf):
    """Levels fitted on the cleaned reference table, applied to the raw table (NULLs -> all zeros)."""
    ref = clean_caroc(patients(spark, sf))
    levels = encode.fit_levels(ref, _G3)
    out, _ = encode.one_hot(patients(spark, sf).select("row_seq", *_G3), _G3, levels=levels, float_names=True)
    return out


@q("g4_label_encode", P + f"SELECT row_seq, CASE {frax_sql('CalcFraxNoBMD')} WHEN '' THEN 0 WHEN 'High' THEN 1 "
                          "WHEN 'Low' THEN 2 WHEN 'Moderate' THEN 3 END AS band_code FROM patients")
def g4_label_encode(spark, sf):
    p = patients(spark, sf).select("row_seq", rules.frax_band("CalcFraxNoBMD").alias("band"))
    out, _ = encode.label_encode(p, "band", out="band_code")
    return out.select("row_seq", "band_code")


_FRACTURES = ["ankle", "clavicle", "elbow", "femur", "wrist", "tibfib"]


@q("g5_melt", P + _union(f"SELECT PatientId, row_seq, '{c}' AS fracture_type, {c} AS fractured FROM patients"
                         for c in _FRACTURES))
def g5_melt(spark, sf):
    p = patients(spark, sf).select("PatientId", "row_seq", *_FRACTURES)
    return encode.melt(p, ["PatientId", "row_seq"], _FRACTURES, "fracture_type", "fractured")


@q("g6_append_columns", P + f"SELECT row_seq, {rd('bmdtest_height')} AS bmdtest_height, {rd(height_sql())} AS height_cm, "
                            f"{rd('bmdtest_weight')} AS bmdtest_weight, {rd(weight_sql())} AS weight_kg FROM patients")
def g6_append_columns(spark, sf):
    p = patients(spark, sf).select("row_seq", "bmdtest_height", "bmdtest_weight")
    return rnd(encode.append_columns(p, {"height_cm": units.height_to_cm("bmdtest_height"),
                                         "weight_kg": units.weight_to_kg("bmdtest_height", "bmdtest_weight")}))


@q("g7_sort_desc", _caroc() + f"SELECT PatientId, {rd('bmdtest_tscore_fn')} AS bmdtest_tscore_fn FROM caroc "
                              "ORDER BY bmdtest_tscore_fn DESC, PatientId")
def g7_sort_desc(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", "bmdtest_tscore_fn")
    return rnd(encode.sort_desc(c, "bmdtest_tscore_fn", ["PatientId"]))


@q("g8_pivot_wide", _caroc() + "SELECT PatientGender, count(*) FILTER (WHERE bmdtest_10yr_caroc = 1) AS \"1\", "
                               "count(*) FILTER (WHERE bmdtest_10yr_caroc = 2) AS \"2\" FROM caroc GROUP BY PatientGender")
def g8_pivot_wide(spark, sf):
    c = clean_caroc(patients(spark, sf))
    long = c.groupBy("PatientGender", "bmdtest_10yr_caroc").agg(F.count(F.lit(1)).alias("n"))
    wide = encode.pivot_wide(long, "PatientGender", "bmdtest_10yr_caroc", "n", [1, 2])
    return wide.select("PatientGender", *[F.coalesce(F.col(f"`{v}`"), F.lit(0).cast("long")).alias(v)
                                          for v in ("1", "2")])


_FEATS = ["PatientAge", "PatientGender", "bmi", "alcohol", "smoke", "arthritis", "diabetes"]


@q("g9_feature_target", _caroc() + "SELECT PatientId, " + ", ".join(rd(c) + f" AS {c}" if c in ("PatientAge", "bmi")
                                                                     else c for c in _FEATS) +
   f", {rd('CAST(bmdtest_tscore_fn AS DOUBLE)')} AS label FROM caroc")
def g9_feature_target(spark, sf):
    c = clean_caroc(patients(spark, sf))
    return rnd(encode.feature_target(c, _FEATS, "bmdtest_tscore_fn", keep=["PatientId"]).withColumn(
        "label", F.col("label")))


@q("g10_binary_target", _caroc() + "SELECT PatientId, CAST(bmdtest_10yr_caroc = 2 AS DOUBLE) AS high_risk FROM caroc")
def g10_binary_target(spark, sf):
    c = clean_caroc(patients(spark, sf))
    return c.select("PatientId", encode.binary_target("bmdtest_10yr_caroc", 2).alias("high_risk"))


# ---- H ---------------------------------------------------------------------------------------------------------
def hb(seed, buckets=100, col="PatientId"):
    return f"(('0x' || substr(md5(coalesce(CAST({col} AS VARCHAR), '') || ':' || '{seed}'), 1, 8))::BIGINT % {buckets})"


@q("h1_hash_split", _caroc() + f"SELECT PatientId, CASE WHEN {hb(2)} < 20 THEN 'test' ELSE 'train' END AS split FROM caroc")
def h1_hash_split(spark, sf):
    c = clean_caroc(patients(spark, sf))
    return sampling.with_split(c, "PatientId", 20, seed=2).select("PatientId", "split")


@q("h2_three_way_split", _caroc() + f"SELECT PatientId, CASE WHEN {hb(2)} < 20 THEN 'test' WHEN {hb(3)} < 20 "
                                    "THEN 'validation' ELSE 'train' END AS split FROM caroc")
def h2_three_way_split(spark, sf):
    c = clean_caroc(patients(spark, sf))
    return sampling.three_way_split(c, "PatientId").select("PatientId", "split")


@q("h3_fraction_sample", _caroc() + f"SELECT PatientId FROM caroc WHERE {hb(786, 10000)} < 9000")
def h3_fraction_sample(spark, sf):
    return sampling.fraction_sample(clean_caroc(patients(spark, sf)), "PatientId", 0.9, 786).select("PatientId")


@q("h4_fixed_size_sample", _caroc() + "SELECT PatientId FROM caroc ORDER BY md5(coalesce(CAST(PatientId AS VARCHAR), '') || ':0'), "
                                      "PatientId LIMIT 100")
def h4_fixed_size_sample(spark, sf):
    return sampling.fixed_size_sample(clean_caroc(patients(spark, sf)), "PatientId", 100, 0).select("PatientId")


@q("h5_kfold", _caroc() + f"SELECT PatientId, CAST({hb(0, 10)} AS INT) AS fold FROM caroc")
def h5_kfold(spark, sf):
    return sampling.kfold(clean_caroc(patients(spark, sf)), "PatientId", 10, 0).select("PatientId", "fold")


@q("h7_class_weights", _caroc() + f"SELECT PatientId, bmdtest_10yr_caroc, {rd('CAST(count(bmdtest_10yr_caroc) OVER () AS DOUBLE) / ((SELECT count(DISTINCT bmdtest_10yr_caroc) FROM caroc) * nullif(count(bmdtest_10yr_caroc) OVER (PARTITION BY bmdtest_10yr_caroc), 0))')} AS weight FROM caroc")
def h7_class_weights(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", "bmdtest_10yr_caroc")
    return rnd(sampling.class_weights(c, "bmdtest_10yr_caroc"))


@q("h8_ordered_validation", _caroc() + "SELECT PatientId, row_number() OVER (ORDER BY PatientId NULLS FIRST) > "
                                       "CAST(floor(CAST((SELECT count(*) FROM caroc) AS DOUBLE) * "
                                       "(CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE))) AS BIGINT) AS is_validation FROM caroc")
def h8_ordered_validation(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId")
    return sampling.ordered_validation(c, "PatientId", 0.2)


# ---- I ---------------------------------------------------------------------------------------------------------
_SC = ["PatientAge", "bmi"]


def _z_sql(cols, src="caroc", stats_src=None, keep="PatientId", pop=True):
    sd = "stddev_pop" if pop else "stddev_samp"
    st = ", ".join(f"avg({c}) AS m_{c}, {sd}({c}) AS s_{c}" for c in cols)
    ex = ", ".join(rd(f"({c} - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 ELSE s_{c} END)") + f" AS {c}"
                   for c in cols)
    return f", zs AS (SELECT {st} FROM {stats_src or src}) SELECT {keep}, {ex} FROM {src}, zs"


@q("i1_zscore", _caroc() + _z_sql(_SC))
def i1_zscore(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_SC)
    out, _ = scaling.scale(c, _SC, "standard")
    return rnd(out)


_MM = ["PatientAge", "bmi", "howbreak"]


@q("i2_minmax", _caroc() + ", mm AS (SELECT " + ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in _MM) +
   " FROM caroc) SELECT PatientId, " + ", ".join(rd(f"(CAST({c} AS DOUBLE) - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END)") + f" AS {c}" for c in _MM) +
   " FROM caroc, mm")
def i2_minmax(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_MM)
    out, _ = scaling.scale(c, _MM, "minmax")
    return rnd(out)


@q("n5_minmax_normalise", _caroc() + ", mm AS (SELECT " + ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in _MM) +
   " FROM caroc) SELECT PatientId, " + ", ".join(rd(f"(CAST({c} AS DOUBLE) - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END)") + f" AS {c}" for c in _MM) +
   " FROM caroc, mm")
def n5_minmax_normalise(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_MM)
    return rnd(scaling.fit_minmax(c, _MM).transform(c))


@q("i3_inverse_transform", _caroc() + f"SELECT PatientId, {rd('PatientAge')} AS PatientAge, {rd('bmi')} AS bmi FROM caroc")
def i3_inverse_transform(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_SC)
    z, model = scaling.scale(c, _SC, "standard")
    return rnd(model.inverse(z))


_ALLF = ["PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn", "bmi", "PatientGender", "alcohol",
         "smoke", "arthritis", "diabetes", "howbreak"]


@q("i4_normalize_all", _caroc() + _z_sql(_ALLF))
def i4_normalize_all(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_ALLF)
    out, _ = scaling.scale(c, _ALLF, "standard")
    return rnd(out)


@q("i5_saved_statistics", _caroc() + f", tr AS (SELECT * FROM caroc WHERE {hb(2)} >= 20), te AS (SELECT * FROM caroc WHERE {hb(2)} < 20)" +
   _z_sql(_SC, src="te", stats_src="tr"))
def i5_saved_statistics(spark, sf):
    """Fit on the training split, persist the statistics as a table, reload, transform the test split only."""
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_SC)
    train, test = sampling.hash_split(c, "PatientId", 20, seed=2)
    model = scaling.fit_standard(train, _SC)
    path = scratch_path(spark, "scaler")
    model.save(spark, path)
    loaded = scaling.ScalerModel.load(spark, path)
    out, _ = scaling.scale(test, _SC, model=loaded)
    return rnd(out)


@q("i6_refit_per_batch", _caroc() + f", te AS (SELECT * FROM caroc WHERE {hb(2)} < 20)" + _z_sql(_SC, src="te"))
def i6_refit_per_batch(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_SC)
    _, test = sampling.hash_split(c, "PatientId", 20, seed=2)
    out, _ = scaling.scale(test, _SC, refit=True, model=scaling.ScalerModel("standard", {}))
    return rnd(out)


def _i6_stream_sql():
    z = lambda c: rd(f"({c} - avg({c}) OVER w) / coalesce(nullif(stddev_pop({c}) OVER w, 0), 1)")
    return _caroc() + (", te AS (SELECT * FROM caroc WHERE PatientId IS NOT NULL) SELECT PatientId, "
                       + ", ".join(f"{z(c)} AS {c}" for c in _SC) + " FROM te WINDOW w AS (PARTITION BY PatientId % 3)")


@q("i6_stream_refit", _i6_stream_sql())
def i6_stream_refit(spark, sf):
    """Files that arrive one by one, scaled by their own batch's statistics, each batch written once."""
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_SC).where("PatientId IS NOT NULL")
    source, sink, held = (scratch_path(spark, f"i6-{x}") for x in ("in", "out", "checkpoint"))
    for part in range(3):
        c.where(F.col("PatientId") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    scorer.process_batches(spark, lambda batch: scaling.scale(batch, _SC, refit=True)[0], source, c.schema, sink, held, files_per_batch=1)
    return rnd(scorer.batch_results(spark, sink).drop("batch"))


# ---- N ---------------------------------------------------------------------------------------------------------
_N1 = ["PatientAge", "bmi", "bmdtest_weight"]


@q("n1_interactions_ratios", _caroc() + "SELECT PatientId, " + ", ".join(
    [rd(f"{a} * {b}") + f' AS "{a}*{b}"' for i, a in enumerate(_N1) for b in _N1[i + 1:]] +
    [rd(f"CASE WHEN {b} = 0 THEN NULL ELSE {a} / {b} END") + f' AS "{a}/{b}"' for i, a in enumerate(_N1) for b in _N1[i + 1:]]) +
   " FROM caroc")
def n1_interactions_ratios(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_N1)
    return rnd(c.select("PatientId", *[e.alias(n) for n, e in {**scalar.interactions(_N1), **scalar.ratios(_N1)}.items()]))


_N3 = ["PatientAge", "bmi"]


@q("n3_bin_numeric", _caroc() + ", mm AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _N3) +
   " FROM caroc) SELECT PatientId, " + ", ".join(
       f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE least(CAST(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 10)) AS BIGINT), 9) END AS {c}_bin"
       for c in _N3) + " FROM caroc, mm")
def n3_bin_numeric(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", *_N3)
    return encode.bin_numeric(c, _N3, 10).select("PatientId", *[f"{x}_bin" for x in _N3])


_N4 = ["PatientAge", "bmi", "howbreak", "parentbreak", "obreak", "hbp"]


@q("n4_low_variance", _caroc() + _union(f"SELECT '{c}' AS feature FROM caroc HAVING coalesce(var_samp(CAST({c} AS DOUBLE)), 0) <= 0"
                                         for c in _N4))
def n4_low_variance(spark, sf):
    c = clean_caroc(patients(spark, sf))
    return spark.createDataFrame([(x,) for x in encode.low_variance_columns(c, _N4)], "feature string")


_N6 = ["PatientAge", "bmdtest_height", "bmdtest_weight", "bmi", "PatientGender"]


def _n6_sql(threshold=0.8, target="bmdtest_tscore_fn"):
    """The pairs in order, each a step that may add one of its members to the list of dropped columns."""
    r = lambda a, b: f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    pairs = [(a, b) for a in sorted(_N6) for b in sorted(_N6) if a < b]
    cols = [f"abs({r(c, target)}) AS t_{c}" for c in _N6] + [f"abs({r(a, b)}) AS r_{a}_{b}" for a, b in pairs]
    steps = [f"r AS (SELECT {', '.join(cols)} FROM caroc)", "d0 AS (SELECT *, CAST([] AS VARCHAR[]) AS d FROM r)"]
    for i, (a, b) in enumerate(pairs, 1):
        steps.append(f"d{i} AS (SELECT * REPLACE (CASE WHEN list_contains(d, '{a}') OR list_contains(d, '{b}') THEN d "
                     f"WHEN r_{a}_{b} > {threshold} THEN list_append(d, CASE WHEN t_{a} >= t_{b} THEN '{b}' ELSE '{a}' END) "
                     f"ELSE d END AS d) FROM d{i - 1})")
    return _caroc() + ", " + ", ".join(steps) + f" SELECT unnest(d) AS feature FROM d{len(pairs)}"


@q("n6_collinear_drops", _n6_sql())
def n6_collinear_drops(spark, sf):
    from riskframe.operators import profile
    c = clean_caroc(patients(spark, sf))
    cols = _N6
    m = [(r["feature_a"], r["feature_b"], r["corr"]) for r in profile.correlation_matrix(c, cols).collect()]
    t = {r["feature"]: r["corr"] for r in profile.correlation_with(c, "bmdtest_tscore_fn", cols).collect()}
    return spark.createDataFrame([(x,) for x in encode.collinear_drops(m, t, 0.8)], "feature string")


def _n7_sql():
    from riskframe.spec import CAROC
    roles = {"alcohol": "'categorical'", "smoke": "'categorical'", "PatientAge": "'numeric'", "bmi": "'numeric'"}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {roles.get(c, 'NULL')})" for c in [*CAROC.columns, "bmi"]) + ") t(feature, role)"


@q("n7_declared_roles", _n7_sql())
def n7_declared_roles(spark, sf):
    c = encode.with_roles(clean_caroc(patients(spark, sf)), categorical=["alcohol", "smoke"], numeric=["PatientAge", "bmi"])
    return spark.createDataFrame([(f.name, f.metadata.get("role")) for f in c.schema.fields],
                                 "feature string, role string")


# ---- T ---------------------------------------------------------------------------------------------------------
@q("t1_complement_anti_join", _caroc() + f"SELECT PatientId FROM caroc WHERE {hb(786, 10000)} >= 9000")
def t1_complement_anti_join(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId")
    sample = sampling.fraction_sample(c, "PatientId", 0.9, 786)
    return joins.complement(c, sample, "PatientId")


@q("t2_left_join_features", P + ", lf AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS total_qty FROM "
                                "lineitem GROUP BY l_orderkey) SELECT row_seq, n_lines, " + rd("total_qty") +
   " AS total_qty FROM patients LEFT JOIN lf ON patients.row_seq = lf.l_orderkey")
def t2_left_join_features(spark, sf):
    li = read_table(spark, sf, "lineitem")
    feats = li.groupBy(F.col("l_orderkey").alias("row_seq")).agg(F.count(F.lit(1)).alias("n_lines"),
                                                                 F.sum("l_quantity").alias("total_qty"))
    return rnd(joins.left_join_features(patients(spark, sf).select("row_seq"), feats, "row_seq"))


@q("t4_union_by_name", P + f"SELECT row_seq, wrist, {rd('PatientAge')} AS PatientAge, NULL::INT AS shoulder, "
                           "NULL::DOUBLE AS bmdtest_weight FROM patients WHERE wrist = 1 UNION ALL "
                           f"SELECT row_seq, NULL::INT, NULL::DOUBLE, shoulder, {rd('bmdtest_weight')} FROM patients "
                           "WHERE shoulder = 1")
def t4_union_by_name(spark, sf):
    p = patients(spark, sf)
    a = quality.cohort_filter(p, "wrist", 1).select("row_seq", "wrist", "PatientAge")
    b = quality.cohort_filter(p, "shoulder", 1).select("row_seq", "shoulder", "bmdtest_weight")
    return rnd(joins.union_by_name([a, b]))


@q("t5_top_n", _caroc() + f"SELECT PatientId, {rd('bmdtest_tscore_fn')} AS bmdtest_tscore_fn FROM caroc "
                          "ORDER BY bmdtest_tscore_fn DESC, PatientId LIMIT 10")
def t5_top_n(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", "bmdtest_tscore_fn")
    return rnd(joins.top_n(c, "bmdtest_tscore_fn", 10, ["PatientId"]))
