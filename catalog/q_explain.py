"""K16-K18 (explanations) and L1-L3 / P13 (importance aggregation) queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from catalog.common import q, rnd
from catalog.q_basic import _RULE_T, rule_tscore
from catalog.sqlparts import rd
from riskframe.fixtures import patients
from riskframe.operators import attribution, explain, gram as G, models as M, sampling
from riskframe.operators.stats import agg_row
from riskframe.plans.cleaning import clean_caroc
from riskframe.session import materialize, scratch_path
from riskframe.sources import contract, io


def _caroc():
    from catalog.oracles import _CAROC
    return _CAROC


RULE_COEFS = {"PatientAge": -0.04, "bmi": 0.01}     # the linear rule predictor's slopes
K16_FEATURES = ["PatientAge", "bmi"]
REPEATS, BUCKETS, SEED = 50, 16, 0


def _rule_predict(df):
    return df.withColumn("prediction", rule_tscore())


def _k16_frame(spark, sf):
    return clean_caroc(patients(spark, sf)).filter(F.col("bmdtest_tscore_fn").isNotNull()) \
        .select("PatientId", "PatientAge", "bmi", "bmdtest_tscore_fn")


def _k16_sql(scorer="mse"):
    pred = _RULE_T
    pp = pred.replace("PatientAge", "pa").replace("bmi", "pb")
    rows = _caroc() + f""", b AS (SELECT PatientId, PatientAge, bmi, bmdtest_tscore_fn AS y,
   CASE WHEN bmdtest_tscore_fn < -1.5 THEN 1 ELSE 0 END AS high,
   CAST(('0x' || substr(md5(CAST(PatientId AS VARCHAR) || ':bucket'), 1, 8))::BIGINT % {BUCKETS} AS INT) AS bucket
   FROM caroc WHERE bmdtest_tscore_fn IS NOT NULL),
rep AS (SELECT b.*, f.perm_feature, f.fidx, r.range AS repeat FROM b,
   (VALUES ('PatientAge', 0), ('bmi', 1)) f(perm_feature, fidx), range({REPEATS}) r),
rk AS (SELECT *, CASE fidx WHEN 0 THEN PatientAge ELSE bmi END AS fval FROM rep),
dn AS (SELECT *, coalesce(lead(fval) OVER w, first_value(fval) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS donor
   FROM rk WINDOW w AS (PARTITION BY perm_feature, repeat, bucket ORDER BY
      md5(concat_ws(':', CAST(PatientId AS VARCHAR), perm_feature, CAST(repeat AS VARCHAR), '{SEED}')), PatientId)),
sw AS (SELECT perm_feature, repeat, y, high,
   CASE WHEN fidx = 0 THEN donor ELSE PatientAge END AS pa, CASE WHEN fidx = 1 THEN donor ELSE bmi END AS pb FROM dn)"""
    if scorer == "roc_auc":  # the score of the high class is the negated predicted T-score; ties count half
        area = "(sum(tp * (cum - fp / 2.0)) / (sum(tp) * sum(fp)))"
        per = (f"SELECT {{keys}} round(-({{pred}}) * 1000000) AS s, sum(high) AS tp, sum(1 - high) AS fp FROM {{src}} "
               "WHERE ({pred}) IS NOT NULL GROUP BY ALL")
        return rows + f""", s0 AS ({per.format(keys='', pred=pred, src='b')}),
bm AS (SELECT {area} AS m FROM (SELECT *, sum(fp) OVER (ORDER BY s) AS cum FROM s0)),
s1 AS ({per.format(keys='perm_feature, repeat,', pred=pp, src='sw')}),
pm AS (SELECT perm_feature, repeat, {area} AS metric
   FROM (SELECT *, sum(fp) OVER (PARTITION BY perm_feature, repeat ORDER BY s) AS cum FROM s1) GROUP BY 1, 2)
SELECT perm_feature AS feature, repeat, {rd('m - metric')} AS importance, {rd('metric - m')} AS increase FROM pm, bm"""
    metric = "avg(pow({p} - y, 2))" if scorer == "mse" else "1 - avg(pow({p} - y, 2)) / v"
    return rows + f""", vy AS (SELECT var_pop(y) AS v FROM b),
bm AS (SELECT {metric.format(p=pred)} AS m FROM b, vy GROUP BY v),
pm AS (SELECT perm_feature, repeat, {metric.format(p=pp)} AS metric FROM sw, vy GROUP BY 1, 2, v)
SELECT perm_feature AS feature, repeat, {rd('m - metric')} AS importance, {rd('metric - m')} AS increase FROM pm, bm"""


def _k16(spark, sf, scorer):
    frame = _k16_frame(spark, sf)
    label, predict, same = "bmdtest_tscore_fn", _rule_predict, None
    if scorer == "roc_auc":
        frame = frame.withColumn("high", (F.col(label) < -1.5).cast("int"))
        label, predict = "high", lambda d: d.withColumn("prediction", F.round(-rule_tscore() * 1000000))
        same = explain.Rule(tuple(K16_FEATURES), (-0.04, 0.01), (60.0, 25.0), -1.5, factor=-1e6)
    res = explain.permutation_importance(frame, "PatientId", K16_FEATURES, label, predict, repeats=REPEATS, seed=SEED,
                                         scorer=scorer, same=same)
    return rnd(res.withColumn("repeat", F.col("repeat").cast("long")))


@q("k16_permutation_importance", _k16_sql())
def k16_permutation_importance(spark, sf):
    """MSE-scorer permutation importance of the rule predictor (bucketed permutation, 50 repeats)."""
    return _k16(spark, sf, "mse")


@q("k16_permutation_importance_r2", _k16_sql("r2"))
def k16_permutation_importance_r2(spark, sf):
    return _k16(spark, sf, "r2")


@q("k16_permutation_importance_auc", _k16_sql("roc_auc"))
def k16_permutation_importance_auc(spark, sf):
    """The same for the AUC of telling T-scores below -1.5 by the rule's score (in steps of a millionth)."""
    return _k16(spark, sf, "roc_auc")


@q("k16_permutation_importance_model")
def k16_permutation_importance_model(spark, sf):
    """The same for a fitted forest (Spark ML transform as the predictor)."""
    from catalog.q_models import REG_FEATURES, training_frame
    t = training_frame(spark, sf)
    model = M.pipeline(REG_FEATURES, M.random_forest_regressor(trees=20, depth=5)).fit(t)
    return explain.permutation_importance(t.select("PatientId", "label", *REG_FEATURES), "PatientId", REG_FEATURES,
                                          "label", lambda d: model.transform(d), order_hash="xxhash64",
                                          same=explain.Trees(attribution.from_model(model.stages[-1])))


@q("k17_attribution_summary", _caroc() + ", m AS (SELECT avg(PatientAge) AS ma, avg(bmi) AS mb FROM caroc) "
   f"SELECT 'PatientAge' AS feature, {rd('avg(abs(-0.04 * (PatientAge - ma)))')} AS mean_abs_phi FROM caroc, m "
   f"UNION ALL SELECT 'bmi', {rd('avg(abs(0.01 * (bmi - mb)))')} FROM caroc, m")
def k17_attribution_summary(spark, sf):
    return rnd(explain.attribution_summary(clean_caroc(patients(spark, sf)), RULE_COEFS))


@q("k18_waterfalls", _caroc() + """, m AS (SELECT avg(PatientAge) AS ma, avg(bmi) AS mb FROM caroc),
f AS (SELECT PatientId, PatientGender, -0.04 * (PatientAge - ma) AS phi_a, 0.01 * (bmi - mb) AS phi_b FROM caroc, m
      QUALIFY row_number() OVER (PARTITION BY PatientGender ORDER BY PatientId NULLS FIRST) <= 11),
l AS (SELECT PatientId, PatientGender, 'PatientAge' AS feature, phi_a AS phi FROM f UNION ALL
      SELECT PatientId, PatientGender, 'bmi', phi_b FROM f)
SELECT PatientId, PatientGender, feature, """ + rd("phi") + """ AS phi,
  row_number() OVER (PARTITION BY PatientId ORDER BY abs(phi) DESC, feature) AS rank FROM l""")
def k18_waterfalls(spark, sf):
    w = explain.waterfalls(clean_caroc(patients(spark, sf)), RULE_COEFS, "PatientId", "PatientGender", 11)
    return rnd(w.withColumn("rank", F.col("rank").cast("long")))


# A tree by hand: two splits on age and BMI, covers counted in the table. With two features the Shapley values have a
# closed form.
_T_AGE, _T_BMI, _T_LEAVES = 65.0, 25.0, (-0.8, -1.4, -2.3)


def _rule_tree(df):
    young = F.col("PatientAge") <= _T_AGE
    n = agg_row(df, {"all": F.count(F.lit(1)), "young": F.sum(young.cast("long")), "thin": F.sum((young & (F.col("bmi") <= _T_BMI)).cast("long"))})
    covers = [n["all"], n["young"], n["thin"], n["young"] - n["thin"], n["all"] - n["young"]]
    tree = attribution.Tree(np.array([0, 1, -1, -1, -1]), np.array([_T_AGE, _T_BMI, 0, 0, 0]), np.array([1, 2, -1, -1, -1]),
                            np.array([4, 3, -1, -1, -1]), np.array(covers, float), np.array([0, 0, *_T_LEAVES]))
    return attribution.Ensemble([tree], [1.0])


def _rule_tree_sql():
    a, b, c = _T_LEAVES
    return _caroc() + f""", d AS (SELECT * FROM caroc WHERE PatientAge IS NOT NULL AND bmi IS NOT NULL),
s AS (SELECT avg(CAST(PatientAge <= {_T_AGE} AS INT)) AS young, sum(CAST(PatientAge <= {_T_AGE} AND bmi <= {_T_BMI} AS INT))
      / CAST(sum(CAST(PatientAge <= {_T_AGE} AS INT)) AS DOUBLE) AS thin FROM d),
v AS (SELECT PatientId, PatientGender, young * (thin * {a} + (1 - thin) * {b}) + (1 - young) * {c} AS v0,
      CASE WHEN PatientAge <= {_T_AGE} THEN thin * {a} + (1 - thin) * {b} ELSE {c} END AS v_age,
      young * CASE WHEN bmi <= {_T_BMI} THEN {a} ELSE {b} END + (1 - young) * {c} AS v_bmi,
      CASE WHEN PatientAge > {_T_AGE} THEN {c} WHEN bmi <= {_T_BMI} THEN {a} ELSE {b} END AS v2 FROM d, s),
p AS (SELECT *, (v_age - v0 + v2 - v_bmi) / 2 AS phi_age, (v_bmi - v0 + v2 - v_age) / 2 AS phi_bmi FROM v)
"""


def _tree_rows(spark, sf):
    return clean_caroc(patients(spark, sf)).dropna(subset=["PatientAge", "bmi"])


@q("k17_tree_summary", _rule_tree_sql() + f"SELECT 'PatientAge' AS feature, {rd('avg(abs(phi_age))')} AS mean_abs_phi FROM p "
   f"UNION ALL SELECT 'bmi', {rd('avg(abs(phi_bmi))')} FROM p")
def k17_tree_summary(spark, sf):
    """Exact attributions of a tree, with the covers of the table itself."""
    c = _tree_rows(spark, sf)
    return rnd(attribution.summary(attribution.tree_attributions(c, ["PatientAge", "bmi"], _rule_tree(c)), ["PatientAge", "bmi"]))


@q("k18_tree_waterfalls", _rule_tree_sql() + """, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY PatientGender
  ORDER BY PatientId NULLS FIRST) <= 11),
l AS (SELECT PatientId, PatientGender, 'PatientAge' AS feature, phi_age AS phi, v0 FROM f UNION ALL
      SELECT PatientId, PatientGender, 'bmi', phi_bmi, v0 FROM f),
r AS (SELECT *, row_number() OVER w AS rank, v0 + sum(phi) OVER w AS stop FROM l
      WINDOW w AS (PARTITION BY PatientId, PatientGender ORDER BY abs(phi) DESC, feature ROWS UNBOUNDED PRECEDING))
SELECT PatientId, PatientGender, feature, """ + f"{rd('phi')} AS phi, rank, {rd('stop - phi')} AS \"from\", {rd('stop')} AS \"to\" FROM r")
def k18_tree_waterfalls(spark, sf):
    c = _tree_rows(spark, sf)
    done = attribution.tree_attributions(c, ["PatientAge", "bmi"], _rule_tree(c), ["PatientId", "PatientGender"])
    # sizes that differ by rounding only must rank as equal
    done = done.withColumn("phi", F.transform("phi", lambda x: F.round(x * 1e12) / 1e12))
    w = attribution.waterfalls(done, ["PatientAge", "bmi"], "PatientId", "PatientGender")
    return rnd(w.withColumn("rank", F.col("rank").cast("long")))


@q("k17_forest_attributions")
def k17_forest_attributions(spark, sf):
    """Exact attributions of a fitted forest for every row: mean size per feature, and how far they are from adding up
    to the predictions (rounding only)."""
    from catalog.q_models import REG_FEATURES, training_frame
    t = training_frame(spark, sf)
    model = M.pipeline(REG_FEATURES, M.random_forest_regressor(trees=20, depth=6)).fit(t)
    done = attribution.tree_attributions(t, REG_FEATURES, attribution.from_model(model.stages[-1]), ["PatientId"])
    done = materialize(done, "attributions")
    off = F.abs(F.aggregate("phi", F.lit(0.0), lambda a, x: a + x) - (F.col("prediction") - F.col("base")))
    gap = agg_row(done, {"gap": F.max(off)})["gap"]
    return attribution.summary(done, REG_FEATURES).withColumn("largest_gap", F.lit(gap).cast("double"))


_BACKGROUND = 25


@q("k17_sampled_attributions", _caroc() + f""", d AS (SELECT * FROM caroc WHERE PatientId IS NOT NULL AND PatientAge IS NOT NULL AND bmi IS NOT NULL),
b AS (SELECT avg(PatientAge) AS ma, avg(bmi) AS mb FROM (SELECT * FROM d ORDER BY md5(CAST(PatientId AS VARCHAR) || ':0'), PatientId LIMIT {_BACKGROUND}))
SELECT PatientId, {rd("-0.04 * (PatientAge - ma)")} AS phi_age, {rd("0.01 * (bmi - mb)")} AS phi_bmi FROM d, b""")
def k17_sampled_attributions(spark, sf):
    """Sampled attributions of the rule predictor against a fixed-size background sample (H4): as many draws as the
    background has rows meet each of them once, so a linear rule's values are exact."""
    c = clean_caroc(patients(spark, sf)).dropna(subset=["PatientId", "PatientAge", "bmi"])
    features = list(RULE_COEFS)
    background = sampling.fixed_size_sample(c, "PatientId", _BACKGROUND, 0)
    rule = sum((F.col(f) * b for f, b in RULE_COEFS.items()), F.lit(0.0))
    done = attribution.sampled_attributions(c, "PatientId", features, lambda d: d.withColumn("prediction", rule), background,
                                            draws=_BACKGROUND)
    return rnd(done.select("PatientId", *[F.get("phi", F.lit(features.index(f))).alias(n)
                                          for f, n in (("PatientAge", "phi_age"), ("bmi", "phi_bmi"))]))


# ---- L1-L3 / P13 ------------------------------------------------------------------------------------------------
# column-name vocabularies of the two model families (harmonised by L1); fixed values
SCI_RENAME = {"pt_response_parentbreak_1.0": "parentbreak", "pt_response_alcohol_1.0": "alcohol",
              "Age*Gender": "age_gender", "Age*bmi": "age_bmi", "Gender*bmi": "gender_bmi",
              "PatientAge": "age", "PatientGender": "gender", "bmi": "bmi"}
DNN_RENAME = {"age": "age", "sex": "gender", "weight": "weight", "height": "height", "shoulder": "shoulder",
              "wrist": "wrist"}


def _importance_matrices(spark, sf):
    """Per model, its (repeat x feature) permutation-importance matrix written as a CSV with a row index
    (A5), under the family's own column names."""
    from catalog.q_models import REG_FEATURES, training_frame
    t = training_frame(spark, sf)
    t = t.withColumns({"pt_response_parentbreak_1.0": F.col("parentbreak").cast("double"),
                       "pt_response_alcohol_1.0": F.col("alcohol").cast("double"),
                       "age": F.col("PatientAge"), "sex": F.col("PatientGender").cast("double"),
                       "weight": F.col("bmdtest_weight"), "height": F.col("bmdtest_height"),
                       "shoulder_f": F.col("shoulder").cast("double"), "wrist_f": F.col("wrist").cast("double")})
    t = t.withColumnsRenamed({"shoulder_f": "shoulder_x", "wrist_f": "wrist_x"})
    sci_feats = ["PatientAge", "PatientGender", "bmi", "Age*Gender", "Age*bmi", "Gender*bmi",
                 "pt_response_parentbreak_1.0", "pt_response_alcohol_1.0"]
    dnn_feats = ["age", "sex", "weight", "height", "shoulder_x", "wrist_x"]
    base = scratch_path(spark, "importances")
    s_all = G.gram(t, sci_feats, "label")[None]
    d_all = G.gram(t, dnn_feats, "label")[None]
    models = {"sci_ols": (sci_feats, M.ols(s_all, sci_feats)), "sci_ridge": (sci_feats, M.ridge(s_all, sci_feats, 10.0)),
              "sci_bayes": (sci_feats, M.bayesian_ridge(s_all, sci_feats)),
              "dnn_ols": (dnn_feats, M.ols(d_all, dnn_feats)), "dnn_ridge": (dnn_feats, M.ridge(d_all, dnn_feats, 100.0))}
    paths = {}
    for family, feats in (("sci", sci_feats), ("dnn", dnn_feats)):
        fam = {name: fit for name, (f, fit) in models.items() if name.startswith(family)}
        data = t.select("PatientId", "label", *[F.col(f"`{c}`").alias(c) for c in feats])
        pi = explain.permutation_importance_many(data, "PatientId", feats, "label",
                                                 {name: fit.predict_expr() for name, fit in fam.items()}, repeats=5)
        pi = materialize(pi, f"importances-{family}")
        for name in fam:
            wide = (pi.filter(F.col("model") == name).groupBy("repeat").pivot("feature", feats)
                    .agg(F.first("importance")).withColumnRenamed("repeat", "index"))
            wide = wide.withColumnsRenamed({"shoulder_x": "shoulder", "wrist_x": "wrist"})
            paths[name] = io.write_csv(wide, f"{base}/{name}", index_col="index", single_file=True)
    return paths


def importance_long(spark, sf):
    """L1: read a family's matrices in one scan, harmonise the names, stack by name, tag model and family (from the
    file path), and go long (feature, importance)."""
    paths = _importance_matrices(spark, sf)
    frames = []
    for family, rename in (("sci", SCI_RENAME), ("dnn", DNN_RENAME)):
        mine = [p for name, p in paths.items() if name.startswith(family)]
        columns = dict.fromkeys(c for header in contract.file_headers(spark, mine) for c in header)
        df = io.read_csv(spark, mine, ", ".join(f"`{c}` {'long' if c == 'index' else 'double'}" for c in columns), with_source=True)
        df = df.withColumn("model", F.regexp_extract("source_file", r"/(sci_[a-z]+|dnn_[a-z]+)/", 1)).drop("source_file")
        frames.append(explain.harmonise(df, rename))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    feats = [c for c in stacked.columns if c not in ("index", "model")]
    long = stacked.unpivot(["index", "model"], feats, "feature", "importance").filter(F.col("importance").isNotNull())
    return long.withColumn("family", F.split("model", "_").getItem(0))


@q("l1_stack_importances")
def l1_stack_importances(spark, sf):
    return importance_long(spark, sf).groupBy("family", "model").agg(F.count(F.lit(1)).alias("values"),
                                                                     F.count_distinct("feature").alias("features"))


@q("p13_importance_aggregation")
def p13_importance_aggregation(spark, sf):
    """P13 = L1 + L3 (drop cohort-only features) + L2 (mean, sqrt|.|, rank per family)."""
    return explain.aggregate_importances(importance_long(spark, sf), drop=["shoulder", "wrist"])


# ---- L1-L3 on rule predictors: the whole chain in SQL -----------------------------------------------------------
RULES = {"sci_ruleA": (-0.04, 0.01), "sci_ruleB": (-0.02, 0.05), "dnn_ruleC": (-0.01, 0.03)}
RULE_NAMES = {"sci": {"PatientAge": "age", "bmi": "bmi"}, "dnn": {"years": "age", "bmi_raw": "bmi"}}


def _rule_sql(a, b, x="PatientAge", y="bmi"):
    return (f"(CAST(-1.5 AS DOUBLE) + CAST({a} AS DOUBLE) * ({x} - CAST(60 AS DOUBLE)) + CAST({b} AS DOUBLE) * "
            f"({y} - CAST(25 AS DOUBLE)))")


def _l_sql(final):
    rows = _k16_sql().split(", vy AS (")[0]
    each = []
    for name, (a, b) in RULES.items():
        base = f"(SELECT avg(pow({_rule_sql(a, b)} - y, 2)) FROM b)"
        each.append(f"SELECT '{name}' AS model, CASE perm_feature WHEN 'PatientAge' THEN 'age' ELSE 'bmi' END AS feature, "
                    f"repeat, {base} - avg(pow({_rule_sql(a, b, 'pa', 'pb')} - y, 2)) AS importance FROM sw "
                    "GROUP BY perm_feature, repeat")
    return rows + f", long AS (SELECT *, split_part(model, '_', 1) AS family FROM ({' UNION ALL '.join(each)})) " + final


def _rule_matrices(spark, sf):
    """A (repeat x feature) matrix per rule, written as CSV with a row index under the family's own names."""
    frame, base = _k16_frame(spark, sf), scratch_path(spark, "rule-importances")
    rules = {name: explain.Rule(tuple(K16_FEATURES), ab, (60.0, 25.0), -1.5) for name, ab in RULES.items()}
    found = materialize(explain.permutation_importance_many(frame, "PatientId", K16_FEATURES, "bmdtest_tscore_fn", rules,
                                                            seed=SEED, order_hash="md5"), "rule-importances")
    for name in RULES:
        pi = found.filter(F.col("model") == name)
        wide = pi.groupBy("repeat").pivot("feature", K16_FEATURES).agg(F.first("importance"))
        own = ["PatientAge", "bmi"] if name.startswith("sci") else ["years", "bmi_raw"]
        io.write_csv(wide.toDF("index", *own), f"{base}/{name}", index_col="index")
    return base


def _rule_long(spark, sf):
    base = _rule_matrices(spark, sf)
    frames = []
    for family, names in RULE_NAMES.items():
        schema = "index long, " + ", ".join(f"{c} double" for c in names)
        df = io.read_csv(spark, f"{base}/{family}_*", schema).withColumn(
            "model", F.regexp_extract(F.col("_metadata.file_path"), r"/([a-z]+_rule[A-Z])/", 1))
        frames.append(explain.harmonise(df, names))
    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).unpivot(
        ["index", "model"], ["age", "bmi"], "feature", "importance")
    return long.withColumn("family", F.split("model", "_").getItem(0))


@q("l1_stack_rule_importances", _l_sql(f"SELECT family, model, feature, repeat AS index, {rd('importance')} AS importance FROM long"))
def l1_stack_rule_importances(spark, sf):
    return rnd(_rule_long(spark, sf).select("family", "model", "feature", "index", "importance"))


@q("l2_l3_rule_importance_ranking", _l_sql(f"""SELECT family, feature, {rd('m')} AS mean_importance, {rd('sqrt(abs(m))')} AS score,
row_number() OVER (PARTITION BY family ORDER BY sqrt(abs(m)) DESC, feature) AS rank
FROM (SELECT family, feature, avg(importance) AS m FROM long GROUP BY 1, 2)"""))
def l2_l3_rule_importance_ranking(spark, sf):
    """P13 on rule predictors: permute, write, read, harmonise, stack, average, root, rank."""
    out = explain.aggregate_importances(_rule_long(spark, sf), drop=["shoulder", "wrist"])
    return rnd(out.withColumn("rank", F.col("rank").cast("long")))
