"""E (aggregations and profiling) queries + oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import q, rnd
from catalog.q_basic import _RULE_T, rule_tscore
from catalog.sqlparts import cte, mode_sql, rd
from riskframe.fixtures import patients
from riskframe.operators import associations, profile
from riskframe.plans.cleaning import clean_caroc
from riskframe.spec import CAROC

P = cte()


def _caroc():
    from catalog.oracles import _CAROC
    return _CAROC


NUM = list(CAROC.numeric)
CLEAN_COLS = [*CAROC.columns[1:], "bmi"]          # the 30 profiled features of the cleaned table
CORR_COLS = ["PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn", "PatientGender", "parentbreak",
             "alcohol", "oralster", "smoke", "obreak", "howbreak", "CalcFraxWithBMD"]


def _union(parts):
    return " UNION ALL ".join(parts)


# ---- E1-E5 -----------------------------------------------------------------------------------------------------
@q("e1_column_means", P + _union(f"SELECT '{c}' AS feature, {rd(f'avg({c})')} AS mean FROM patients" for c in NUM))
def e1_column_means(spark, sf):
    return rnd(profile.column_means(patients(spark, sf), NUM))


@q("e2_mean_by_gender", P + "SELECT PatientGender, " + ", ".join(f"{rd(f'avg({c})')} AS mean_{c}" for c in NUM) +
   " FROM patients GROUP BY PatientGender")
def e2_mean_by_gender(spark, sf):
    return rnd(profile.group_means(patients(spark, sf), "PatientGender", NUM))


_MODE_COLS = list(CAROC.nominal) + ["obreak", "ptunsteady"]


@q("e3_column_modes", P + _union(f"SELECT '{c}' AS feature, CAST({mode_sql(c, 'patients')} AS DOUBLE) AS mode"
                                 for c in dict.fromkeys(_MODE_COLS)))
def e3_column_modes(spark, sf):
    return profile.column_modes(patients(spark, sf), list(dict.fromkeys(_MODE_COLS)))


@q("e4_column_stddevs", P + _union(f"SELECT '{c}' AS feature, {rd(f'stddev_samp({c})')} AS std FROM patients"
                                   for c in NUM))
def e4_column_stddevs(spark, sf):
    return rnd(profile.column_stddevs(patients(spark, sf), NUM))


_MISS_COLS = [*CAROC.columns, "CalcFraxWithBMD", "CalcFraxNoBMD", "datebone", "obreak_frac_count"]


@q("e5_missing_report", P + _union(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS total, "
    f"{rd(f'count(*) FILTER (WHERE {c} IS NULL) * CAST(100 AS DOUBLE) / count(*)')} AS pct FROM patients"
    for c in _MISS_COLS))
def e5_missing_report(spark, sf):
    return rnd(profile.missing_report(patients(spark, sf), _MISS_COLS))


# ---- E6 describe ---------------------------------------------------------------------------------------------
def _describe_sql():
    types = {c: ("double" if c in NUM or c == "bmi" else "int") for c in CLEAN_COLS}
    parts = []
    for c in CLEAN_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, count({x}) AS count, {rd(f'avg({x})')} AS mean, {rd(f'stddev_samp({x})')} AS std, "
            f"{rd(f'min({x})')} AS min, {rd(f'quantile_cont({x}, 0.25)')} AS p25, "
            f"{rd(f'quantile_cont({x}, 0.5)')} AS p50, {rd(f'quantile_cont({x}, 0.75)')} AS p75, "
            f"{rd(f'max({x})')} AS max, {rd(f'CAST(count(*) - count({x}) AS DOUBLE) / count(*)')} AS missing, "
            f"'{types[c]}' AS dtype FROM caroc")
    return _caroc() + _union(parts)


@q("e6_describe", _describe_sql())
def e6_describe(spark, sf):
    return rnd(profile.describe(clean_caroc(patients(spark, sf)), CLEAN_COLS))


# ---- E7 / E8 correlation -------------------------------------------------------------------------------------
def _corr_sql(a, b):
    xa, xb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    den = (f"(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {xa} END) * "
           f"stddev_samp(CASE WHEN {a} IS NOT NULL THEN {xb} END))")
    return f"CASE WHEN {den} > 0 THEN covar_samp({xa}, {xb}) / {den} END"


@q("e7_correlation_matrix", P + _union(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rd(_corr_sql(a, b))} AS corr FROM patients"
    for a in CORR_COLS for b in CORR_COLS))
def e7_correlation_matrix(spark, sf):
    return rnd(profile.correlation_matrix(patients(spark, sf), CORR_COLS))


@q("e8_correlation_with_target", P + _union(
    f"SELECT '{c}' AS feature, {rd(_corr_sql(c, 'bmdtest_tscore_fn'))} AS corr FROM patients"
    for c in CORR_COLS if c != "bmdtest_tscore_fn"))
def e8_correlation_with_target(spark, sf):
    return rnd(profile.correlation_with(patients(spark, sf), "bmdtest_tscore_fn",
                                        [c for c in CORR_COLS if c != "bmdtest_tscore_fn"]))


# ---- E9 / E10 --------------------------------------------------------------------------------------------------
@q("e9_value_counts", P + "SELECT oralster, count(*) AS count FROM patients GROUP BY oralster")
def e9_value_counts(spark, sf):
    return profile.value_counts(patients(spark, sf), "oralster")


@q("e10_category_share", P + "SELECT PatientGender, count(*) AS count, "
                             "round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER () * 10) / 10 AS pct "
                             "FROM patients GROUP BY PatientGender")
def e10_category_share(spark, sf):
    return profile.category_share(patients(spark, sf), "PatientGender")


# ---- E11 / E12 / E18 histograms ------------------------------------------------------------------------------
def _hist_sql(src_sql, col, bins):
    return src_sql + f""", mm AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM caroc),
bb AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((CAST({col} AS DOUBLE) - lo) / ((hi - lo) / CAST({bins} AS DOUBLE))) AS BIGINT), {bins - 1}) END AS bin
       FROM caroc, mm WHERE {col} IS NOT NULL),
cnt AS (SELECT bin, count(*) AS count FROM bb GROUP BY bin),
edges AS (SELECT range AS bin, lo + range * ((hi - lo) / {bins}) AS lower, lo + (range + 1) * ((hi - lo) / {bins}) AS upper
          FROM mm, range({bins}))
SELECT edges.bin, {rd('lower')} AS lower, {rd('upper')} AS upper, coalesce(cnt.count, 0) AS count
FROM edges LEFT JOIN cnt ON edges.bin = cnt.bin"""


@q("e11_histogram", _hist_sql(_caroc(), "PatientAge", 40))
def e11_histogram(spark, sf):
    return rnd(profile.histogram(clean_caroc(patients(spark, sf)), "PatientAge", 40))


def _auto_hist_sql():
    x = "CAST(bmi AS DOUBLE)"
    return _caroc() + f""", ps AS (SELECT PatientGender, count({x}) AS n, min({x}) AS lo, max({x}) AS hi,
         quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75 FROM caroc
         WHERE bmi IS NOT NULL GROUP BY PatientGender),
pw AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q75 - q25) * pow(n, -1.0 / 3.0) AS fd FROM ps),
pn AS (SELECT PatientGender, lo, hi, CASE WHEN n = 0 OR hi = lo THEN 1 ELSE
         greatest(1, CAST(ceil((hi - lo) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)) AS BIGINT)) END
         AS nbins FROM pw),
bb AS (SELECT c.PatientGender, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor(({x} - lo) / ((hi - lo) / CAST(nbins AS DOUBLE))) AS BIGINT), nbins - 1) END AS bin
       FROM caroc c JOIN pn ON c.PatientGender = pn.PatientGender WHERE c.bmi IS NOT NULL),
cnt AS (SELECT PatientGender, bin, count(*) AS count FROM bb GROUP BY 1, 2),
edges AS (SELECT PatientGender, range AS bin, lo + range * (hi - lo) / nbins AS lower,
                 lo + (range + 1) * (hi - lo) / nbins AS upper, nbins FROM pn, range(nbins))
SELECT e.PatientGender, e.bin, {rd('lower')} AS lower, {rd('upper')} AS upper, nbins, coalesce(cnt.count, 0) AS count
FROM edges e LEFT JOIN cnt ON e.PatientGender = cnt.PatientGender AND e.bin = cnt.bin"""


@q("e12_auto_histogram_by_gender", _auto_hist_sql())
def e12_auto_histogram_by_gender(spark, sf):
    return rnd(profile.auto_histogram_by_group(clean_caroc(patients(spark, sf)), "bmi", "PatientGender"))


@q("e18_binned_scatter", _caroc() + """, mm AS (SELECT min(PatientAge) AS xlo, max(PatientAge) AS xhi,
  min(bmdtest_tscore_fn) AS ylo, max(bmdtest_tscore_fn) AS yhi FROM caroc
  WHERE PatientAge IS NOT NULL AND bmdtest_tscore_fn IS NOT NULL)
SELECT CASE WHEN xhi = xlo THEN 0 ELSE least(CAST(floor((PatientAge - xlo) / ((xhi - xlo) / CAST(20 AS DOUBLE))) AS BIGINT), 19) END AS x_bin,
       CASE WHEN yhi = ylo THEN 0 ELSE least(CAST(floor((bmdtest_tscore_fn - ylo) / ((yhi - ylo) / CAST(20 AS DOUBLE))) AS BIGINT), 19) END AS y_bin,
       count(*) AS count
FROM caroc, mm WHERE PatientAge IS NOT NULL AND bmdtest_tscore_fn IS NOT NULL GROUP BY 1, 2""")
def e18_binned_scatter(spark, sf):
    return profile.binned_scatter(clean_caroc(patients(spark, sf)), "PatientAge", "bmdtest_tscore_fn", 20)


# ---- E13 box statistics ----------------------------------------------------------------------------------------
_BOX_ALL = ["PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn", "PatientGender"]


def _box_sql(col):
    src = "(SELECT * FROM patients WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _BOX_ALL) + ")"
    return P + f""", qq AS (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS q2,
  quantile_cont({col}, 0.75) AS q3 FROM {src} s),
f AS (SELECT q1, q2, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qq)
SELECT '{col}' AS feature, {rd('q1')} AS q1, {rd('q2')} AS median, {rd('q3')} AS q3, {rd('iqr')} AS iqr,
  {rd(f'min(CASE WHEN {col} >= lo THEN {col} END)')} AS whisker_low,
  {rd(f'max(CASE WHEN {col} <= hi THEN {col} END)')} AS whisker_high,
  count(*) FILTER (WHERE {col} < lo OR {col} > hi) AS outliers
FROM {src} s, f GROUP BY q1, q2, q3, iqr"""


@q("e13_box_stats", _box_sql("bmdtest_weight"))
def e13_box_stats(spark, sf):
    p = patients(spark, sf).select(*_BOX_ALL)
    return rnd(profile.box_stats(p, "bmdtest_weight", _BOX_ALL))


# ---- E14 / E15 profile -----------------------------------------------------------------------------------------
_PROFILE_COLS = ["PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn", "bmi", "parentbreak",
                 "obreak", "howbreak"]


def _profile_sql(src, cols, group=None, stage=None):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        g = f"s.{group}, " if group else ""
        gb = f" GROUP BY s.{group}" if group else ""
        join = f" JOIN mu_{c} m ON s.{group} IS NOT DISTINCT FROM m.{group}" if group else f", mu_{c}"
        st = f", '{stage}' AS stage" if stage else ""
        parts.append(f"""SELECT {g}'{c}' AS feature, count({x}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS missing,
  count(DISTINCT {x}) AS "distinct", {rd(f'avg({x})')} AS mean, {rd(f'stddev_samp({x})')} AS std,
  {rd(f'min({x})')} AS min, {rd(f'max({x})')} AS max,
  {rd(f'CASE WHEN sum(pow({x} - mu, 2)) > 0 THEN sqrt(count({x})) * sum(pow({x} - mu, 3)) / pow(sum(pow({x} - mu, 2)), 1.5) END')} AS skewness,
  {rd(f'CASE WHEN sum(pow({x} - mu, 2)) > 0 THEN count({x}) * sum(pow({x} - mu, 4)) / pow(sum(pow({x} - mu, 2)), 2) - 3 END')} AS kurtosis,
  {rd(f'CAST(arg_max_null_top AS DOUBLE)')} AS top{st}
FROM {src} s{join}{gb}""".replace("arg_max_null_top", f"min(top_{c})"))
    mus = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        if group:
            mus.append(f"mu_{c} AS (SELECT {group}, avg({x}) AS mu, (SELECT {x} FROM {src} t WHERE t.{group} IS NOT DISTINCT FROM o.{group} "
                       f"AND {c} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1) AS top_{c} FROM {src} o GROUP BY {group})")
        else:
            mus.append(f"mu_{c} AS (SELECT avg({x}) AS mu, {mode_sql(x, src)} AS top_{c} FROM {src})")
    return mus, _union(parts)


def _e14_sql():
    mus, body = _profile_sql("caroc", _PROFILE_COLS)
    return _caroc() + ", " + ", ".join(mus) + "\n" + body


@q("e14_profile", _e14_sql())
def e14_profile(spark, sf):
    return rnd(profile.profile(clean_caroc(patients(spark, sf)), _PROFILE_COLS))


_NOMINAL = ["PatientGender", "parentbreak", "alcohol", "smoke", "obreak", "bmdtest_10yr_caroc"]
_NUMERIC = ["PatientAge", "bmi", "bmdtest_tscore_fn"]


def _associations_sql(group=None):
    """Every ordered pair of different columns by DuckDB's own entropy and corr, and sums by category."""
    from itertools import permutations
    nominal = [c for c in _NOMINAL if c != group]
    g, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    parts = []
    for a, b in permutations(nominal, 2):
        ha, hb, hab = f"entropy({a})", f"entropy({b})", f"entropy({a}::VARCHAR || '|' || {b}::VARCHAR)"
        value = f"CASE WHEN {ha} <= 1e-12 THEN 1 ELSE greatest(0, ({ha} - ({hab} - {hb})) / {ha}) END"
        parts.append(f"SELECT {g}'{a}' AS feature_a, '{b}' AS feature_b, 'uncertainty' AS measure, {rd(value)} AS value, "
                     f"count(*) AS n FROM caroc WHERE {a} IS NOT NULL AND {b} IS NOT NULL{by}")
    for a in nominal:
        for b in _NUMERIC:
            per = f"SELECT {g}count(*) AS k, avg({b}) AS m, var_pop({b}) AS v FROM caroc WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {g}{a}"
            mean = "sum(k * m) / sum(k)"
            value = (f"CASE WHEN sum(k * (v + m * m)) / sum(k) - pow({mean}, 2) <= 1e-12 THEN 0 ELSE sqrt(greatest(0, (sum(k * m * m) / sum(k) "
                     f"- pow({mean}, 2)) / (sum(k * (v + m * m)) / sum(k) - pow({mean}, 2)))) END")
            for x, y in ((a, b), (b, a)):
                parts.append(f"SELECT {g}'{x}', '{y}', 'correlation_ratio', {rd(value)}, CAST(sum(k) AS BIGINT) FROM ({per}){by}")
    for a, b in permutations(_NUMERIC, 2):
        parts.append(f"SELECT {g}'{a}', '{b}', 'pearson', {rd(f'corr({a}, {b})')}, count(*) FROM caroc "
                     f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL{by}")
    return _caroc() + "\n" + _union(parts)


@q("e14_associations", _associations_sql())
def e14_associations(spark, sf):
    """Nominal and numeric columns of the cleaned table against each other."""
    return rnd(associations.associations(clean_caroc(patients(spark, sf)), _NOMINAL, _NUMERIC))


@q("e15_associations_by_gender", _associations_sql("PatientGender"))
def e15_associations_by_gender(spark, sf):
    c = clean_caroc(patients(spark, sf))
    return rnd(associations.associations(c, [x for x in _NOMINAL if x != "PatientGender"], _NUMERIC, group="PatientGender"))


_TOP = ["PatientGender", "parentbreak", "obreak", "howbreak", "bmdtest_10yr_caroc"]


def _top_sql(group=None):
    g = f"{group}, " if group else ""
    parts = [f"SELECT {g}'{c}' AS feature, {c}::VARCHAR AS value, count(*) AS count FROM caroc WHERE {c} IS NOT NULL GROUP BY ALL" for c in _TOP]
    w = f"PARTITION BY {g}feature"
    return _caroc() + f""", counts AS ({_union(parts)})
SELECT {g}feature, row_number() OVER ({w} ORDER BY count DESC, value) AS rank, value, count,
  {rd(f"count / CAST(sum(count) OVER ({w}) AS DOUBLE)")} AS share
FROM counts QUALIFY row_number() OVER ({w} ORDER BY count DESC, value) <= 5"""


@q("e14_top_values", _top_sql())
def e14_top_values(spark, sf):
    """The five most frequent values of each column, with their share."""
    top = associations.top_values(clean_caroc(patients(spark, sf)), _TOP)
    return rnd(top.withColumn("rank", F.col("rank").cast("long")))


_E15_COLS = ["PatientAge", "bmdtest_weight", "bmdtest_tscore_fn", "parentbreak"]


def _e15_sql():
    mus, body = _profile_sql("patients", _E15_COLS, group="PatientGender", stage="pre")
    return P + ", " + ", ".join(mus) + "\n" + body


@q("e15_profile_by_gender", _e15_sql())
def e15_profile_by_gender(spark, sf):
    return rnd(profile.profile(patients(spark, sf), _E15_COLS, group="PatientGender", stage="pre"))


def _e15_post_sql():
    mus, body = _profile_sql("caroc", _E15_COLS, group="PatientGender", stage="post")
    pre_mus, pre = _profile_sql("patients", _E15_COLS, group="PatientGender", stage="pre")
    names = [m.split(" AS ")[0] for m in mus]
    for n in names:  # the two halves need names of their own
        pre_mus = [m.replace(n, "pre_" + n) for m in pre_mus]
        pre = pre.replace(n, "pre_" + n)
    return _caroc() + ", " + ", ".join(mus + pre_mus) + "\n" + body + " UNION ALL " + pre


@q("e15_profile_before_and_after", _e15_post_sql())
def e15_profile_before_and_after(spark, sf):
    """E15 as the cleaners report it: the same profile of the input and of the cleaned table."""
    p = patients(spark, sf)
    pre = profile.profile(p, _E15_COLS, group="PatientGender", stage="pre")
    return rnd(pre.unionByName(profile.profile(clean_caroc(p), _E15_COLS, group="PatientGender", stage="post")))


# ---- E16 / E17 / E19 ---------------------------------------------------------------------------------------------
@q("e16_shape", _caroc() + f"SELECT (SELECT count(*) FROM caroc) AS rows, {len(CAROC.columns) + 1} AS columns, "
                           "(SELECT count(*) FROM patients) - (SELECT count(*) FROM caroc) AS removed")
def e16_shape(spark, sf):
    p = patients(spark, sf)
    return profile.shape(clean_caroc(p), p)


def _e17_sql():
    double = {"PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn", "bmi"}
    kinds = {c: "bigint" if c == "PatientId" else "double" if c in double else "int" for c in [*CAROC.columns, "bmi"]}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in kinds.items()) + ") t(feature, dtype)"


@q("e17_dtypes", _e17_sql())
def e17_dtypes(spark, sf):
    return profile.dtypes_frame(clean_caroc(patients(spark, sf)))


@q("e19_scatter_index", _caroc() + f"SELECT {rd(f'sqrt(avg(pow(bmdtest_tscore_fn - {_RULE_T}, 2))) / avg(bmdtest_tscore_fn)')} "
                                   "AS scatter_index FROM caroc")
def e19_scatter_index(spark, sf):
    c = clean_caroc(patients(spark, sf)).withColumn("pred", rule_tscore())
    v = profile.scatter_index(c, "bmdtest_tscore_fn", "pred", c)
    return rnd(spark.createDataFrame([(v,)], "scatter_index double"))
