"""List-literal parsing and array arithmetic, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_list_literal(s: Column | str) -> Column:
    """C9: "['E1', 'E2']" or "[1, 22]" -> ARRAY<STRING>; malformed -> NULL. Never evaluates code."""
    return F.from_json(F.translate(_c(s), "'", '"'), "array<string>")


def join_items(arr: Column | str, sep: str = " ") -> Column:
    """Items joined by a separator."""
    return F.array_join(_c(arr), sep)


def pad_or_truncate(vec: Column | str, n: int) -> Column:
    """right-pad with 0.0 or cut to exactly n items."""
    v = _c(vec).cast("array<double>")
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def l2_norm(vec: Column | str) -> Column:
    v = _c(vec).cast("array<double>")
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vec: Column | str, eps: float = 1e-12) -> Column:
    """v / max(||v||, eps)."""
    v = _c(vec).cast("array<double>")
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"),
                                  lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def mean_squared_diff(x: Column | str, xhat: Column | str) -> Column:
    """mean of (x - xhat)^2 over the vector length."""
    sq = F.zip_with(_c(x).cast("array<double>"), _c(xhat).cast("array<double>"),
                    lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(sq)


# Weights of the three largest absolute errors, largest first.
TOP3_WEIGHTS = (50.0, 70.0, 100.0)


def weighted_top3_error(errors: Column | str, weights: tuple[float, ...] = TOP3_WEIGHTS) -> Column:
    """three largest |errors| (descending) times the weights, summed."""
    top = F.slice(F.sort_array(F.transform(_c(errors).cast("array<double>"), F.abs), asc=False),
                  1, len(weights))
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(top, w, lambda a, b: F.coalesce(a * b, F.lit(0.0))),
                       F.lit(0.0), lambda acc, v: acc + v)
