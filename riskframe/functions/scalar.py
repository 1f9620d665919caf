"""Small scalar helpers (D10, D13-D18): all built-in Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_timestamp(c, fmt: str | None = None) -> Column:
    """Lenient parse; unparseable text becomes NULL instead of failing the job (ANSI on)."""
    c = _c(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def sqrt_abs(c) -> Column:
    """Signed-safe root."""
    return F.sqrt(F.abs(_c(c)))


def class_name(index, names: Sequence[str]) -> Column:
    """Class index (0-based) -> name by array position; out of range -> NULL."""
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), _c(index).cast("int") + F.lit(1))


def code_label(c, mapping: Mapping) -> Column:
    """Code -> label through a literal map."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(c))


def interactions(cols: Sequence[str], sep: str = "*") -> dict[str, Column]:
    """Pairwise products only (no squares), named ``a*b`` in column order."""
    out = {}
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out[f"{a}{sep}{b}"] = F.col(a) * F.col(b)
    return out


def ratios(cols: Sequence[str], sep: str = "/") -> dict[str, Column]:
    """N1 (ratio part): pairwise ratios with a zero denominator giving NULL."""
    out = {}
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out[f"{a}{sep}{b}"] = F.try_divide(F.col(a), F.col(b))
    return out


def residual(pred, label) -> Column:
    """D17."""
    return _c(pred) - _c(label)


def to_percent(p) -> Column:
    """D18."""
    return _c(p) * F.lit(100.0)
