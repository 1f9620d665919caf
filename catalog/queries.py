"""Registered Spark queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or the ``patients`` view Spark derives from orders + lineitem) in full.
Double outputs are rounded to 6 digits, as are the oracle's, because summation order differs between engines.
The queries are defined family by family in the ``q_*`` modules next to their oracle SQL.
"""

from __future__ import annotations

from catalog.common import QUERIES, q, rnd
from riskframe.fixtures import patients
from riskframe.plans import cleaning

# ---- composite cleaners (P1-P6) and the flagship -----------------------------------------------------------
@q("p4_caroc_label_counts")
def p4_caroc_label_counts(spark, sf):
    return rnd(cleaning.label_counts_by_gender(cleaning.clean_caroc(patients(spark, sf))))


@q("p4_caroc_clean")
def p4_caroc_clean(spark, sf):
    return rnd(cleaning.clean_caroc(patients(spark, sf)))


@q("p1_raw_clean")
def p1_raw_clean(spark, sf):
    return rnd(cleaning.clean_raw(patients(spark, sf)))


@q("p2_main_clean")
def p2_main_clean(spark, sf):
    return rnd(cleaning.clean_main(patients(spark, sf)))


@q("p3_old_clean")
def p3_old_clean(spark, sf):
    return rnd(cleaning.clean_old(patients(spark, sf)))


@q("p5_frax_web_clean")
def p5_frax_web_clean(spark, sf):
    return rnd(cleaning.clean_frax_web(cleaning.with_frax_web_label(patients(spark, sf))))


@q("p6_frax_dll_clean")
def p6_frax_dll_clean(spark, sf):
    return rnd(cleaning.clean_frax_dll(patients(spark, sf)))


# families (import registers them)
from catalog import q_basic, q_profile, q_prep, q_eval, q_models, q_io, q_explain, q_plans  # noqa: E402,F401
