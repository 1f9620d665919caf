"""Unit repair and body-measure expressions (pure Column expressions, whole-stage codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's).
LB_TO_KG = 0.45359237
METRE_RANGE = (1.0, 2.2)      # exclusive bounds, height in metres -> x100
INCH_RANGE = (50.0, 84.0)     # exclusive bounds, height in inches -> x2.54
CM_LOWER = 125.0              # strictly above: already centimetres
INCH_TO_CM = 2.54
SUSPICION_BUFFER = 30.0
# Height bands for the pound-suspicion rule: (lower bound exclusive, upper bound inclusive, weight limit kg).
# The limit is applied as weight >= limit + buffer; None = open bound.
SUSPICION_BANDS = [
    (None, 152.4, 56.7),
    (152.4, 154.9, 56.7),
    (152.4, 157.5, 59.0),
    (157.5, 160.0, 61.2),
    (160.0, 162.6, 63.5),
    (162.6, 165.1, 65.8),
    (165.1, 167.6, 68.0),
    (167.6, 170.2, 70.3),
    (170.2, 172.7, 72.6),
    (172.7, 175.3, 74.8),
    (175.3, 177.8, 77.1),
    (177.8, 180.3, 79.4),
    (180.3, 182.9, 81.6),
    (182.9, 185.4, 83.9),
    (185.4, 188.0, 86.2),
    (188.0, 190.5, 88.5),
    (190.5, None, 90.7),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lbs_to_kg(w) -> Column:
    """D1."""
    return _c(w) * F.lit(LB_TO_KG)


def _is_metres(h: Column) -> Column:
    return (h > F.lit(METRE_RANGE[0])) & (h < F.lit(METRE_RANGE[1]))


def _is_inches(h: Column) -> Column:
    return (h > F.lit(INCH_RANGE[0])) & (h < F.lit(INCH_RANGE[1]))


def height_to_cm(h) -> Column:
    """Infer the unit from the magnitude; undecidable values and nulls become 0."""
    h = _c(h)
    return (F.when(_is_metres(h), h * F.lit(100.0))
            .when(_is_inches(h), h * F.lit(INCH_TO_CM))
            .when(h > F.lit(CM_LOWER), h)
            .otherwise(F.lit(0.0)))


def is_imperial(h) -> Column:
    """True when the height was read as inches (first matching range wins; ranges are disjoint)."""
    h = _c(h)
    return F.coalesce(~_is_metres(h) & _is_inches(h), F.lit(False))


def weight_to_kg(h, w) -> Column:
    """D3: the weight unit follows the height unit."""
    return F.when(is_imperial(h), lbs_to_kg(w)).otherwise(_c(w))


def pound_suspicion(raw_h, w_kg) -> Column:
    """A weight far above the normal range for the (raw) height is taken as pounds.

    The chain of ``when`` is generated from the band table; a band matches only if its weight test passes too,
    otherwise later bands are tried, as in an if/elif chain whose conditions include the weight test.
    """
    h, w = _c(raw_h), _c(w_kg)
    expr = None
    for lo, hi, limit in SUSPICION_BANDS:
        cond = w >= (F.lit(limit) + F.lit(SUSPICION_BUFFER))
        if lo is not None:
            cond = (h > F.lit(lo)) & cond
        if hi is not None:
            cond = (h <= F.lit(hi)) & cond
        expr = F.when(cond, lbs_to_kg(w)) if expr is None else expr.when(cond, lbs_to_kg(w))
    return expr.otherwise(w)


def weight_to_kg_with_suspicion(raw_h, w) -> Column:
    """D3 followed by D4 on the metric branch (the raw cleaner's variant)."""
    return F.when(is_imperial(raw_h), lbs_to_kg(w)).otherwise(pound_suspicion(raw_h, w))


def bmi(h_cm, w_kg) -> Column:
    """W / (h/100)^2; a zero height gives NULL instead of infinity."""
    h = _c(h_cm)
    return F.try_divide(_c(w_kg), F.pow(h / F.lit(100.0), F.lit(2.0)))


def to_metric(df, height_col: str = "bmdtest_height", weight_col: str = "bmdtest_weight",
              suspicion: bool = False):
    """D2 + D3 (+ D4) as one projection; both outputs are computed from the raw height."""
    h, w = F.col(height_col), F.col(weight_col)
    wexpr = weight_to_kg_with_suspicion(h, w) if suspicion else weight_to_kg(h, w)
    return df.withColumns({weight_col: wexpr, height_col: height_to_cm(h)})
