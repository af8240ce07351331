"""Band maths. A pixel value of NULL is invalid; there is no second mask and no sentinel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tiles import col


def mask_nodata(value, nodata) -> Column:
    """The exact nodata sentinel becomes NULL (NaN matches NaN)."""
    value, nodata = col(value).cast("double"), col(nodata).cast("double")
    return F.when(nodata.isNull() | (value != nodata), value)


def finite_or_null(value) -> Column:
    """NaN and infinities become NULL."""
    value = col(value)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def band_add(a, b) -> Column:
    return col(a).cast("double") + col(b).cast("double")


def band_subtract(a, b) -> Column:
    return col(a).cast("double") - col(b).cast("double")


def band_multiply(a, b) -> Column:
    return col(a).cast("double") * col(b).cast("double")


def band_divide(a, b) -> Column:
    """Division; an exactly zero denominator makes the pixel invalid."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def normalized_difference(a, b) -> Column:
    """(a - b) / (a + b)."""
    return finite_or_null(band_divide(band_subtract(a, b), band_add(a, b)))


def ndvi(nir="nir", red="red") -> Column:
    """Vegetation index from near infrared and red."""
    return normalized_difference(nir, red)


def nbr(nir="nir", swir="swir") -> Column:
    """Burn ratio from near and short-wave infrared."""
    return normalized_difference(nir, swir)


def all_valid(*inputs) -> Column:
    """A pixel is valid only if every declared input is, referenced or not."""
    return reduce(lambda p, q: p & q, [col(c).isNotNull() for c in inputs])


def rescale(value, low: float, high: float) -> Column:
    """Clamp to [low, high] and stretch to 0..255."""
    if not low < high:
        raise ValueError(f"degenerate input range: {low} >= {high}")
    value = col(value)
    clamped = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))
    return (clamped - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(255.0)


def quantize(value) -> Column:
    """Clamp to 0..255 and drop the fraction; NULL stays NULL."""
    value = col(value)
    return F.when(
        value.isNotNull(), F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("short")
    )


def rgba(r, g, b, valid: Column | None = None) -> Column:
    """Quantised ``struct<r,g,b,a>``: alpha 255 where valid, all zero where not."""
    valid = all_valid(r, g, b) if valid is None else valid & all_valid(r, g, b)
    zero = F.lit(0).cast("short")
    part = lambda c: F.when(valid, quantize(c)).otherwise(zero)
    alpha = F.when(valid, F.lit(255).cast("short")).otherwise(zero)
    return F.struct(part(r).alias("r"), part(g).alias("g"), part(b).alias("b"), alpha.alias("a"))


def qa_clear(word) -> Column:
    """1 where no cloud, cloud-neighbour or shadow bit is set, 0 otherwise.

    Words that are not whole numbers in 0..255 are invalid.
    """
    word = col(word).cast("double")
    whole = (word >= 0) & (word <= 255) & (word == F.floor(word))
    return F.when(whole, F.when(word.cast("long").bitwiseAND(F.lit(14)) == 0, 1.0).otherwise(0.0))


# Quick-look ramp colours at 0, 0.5 and 1 (brown, yellow, green).
QUICKLOOK = ((121.0, 74.0, 44.0), (222.0, 213.0, 116.0), (17.0, 87.0, 29.0))


def quicklook_rgb(index) -> Column:
    """A vegetation index on the brown-yellow-green ramp as ``struct<r,g,b>``, invalid black."""
    index = col(index)
    t = F.least(F.greatest(index + F.lit(0.1), F.lit(0.0)), F.lit(1.0))
    low, mid, high = QUICKLOOK
    parts = []
    for i, name in enumerate("rgb"):
        lower = F.lit(low[i]) + F.lit(mid[i] - low[i]) * (t / F.lit(0.5))
        upper = F.lit(mid[i]) + F.lit(high[i] - mid[i]) * ((t - F.lit(0.5)) / F.lit(0.5))
        value = F.bround(F.when(t < 0.5, lower).otherwise(upper), 0).cast("int")
        parts.append(F.when(index.isNotNull(), value).otherwise(F.lit(0)).alias(name))
    return F.struct(*parts)


def array_element(bands: Column, index: int | None = None, label: str | None = None, labels: list[str] | None = None) -> Column:
    """One band of an array column, by zero-based index or by label; exactly one must be given."""
    if (index is None) == (label is None):
        raise ValueError("give exactly one of index and label")
    if label is not None:
        if not labels or label not in labels:
            raise ValueError(f"no band labelled {label!r}")
        index = labels.index(label)
    if index < 0 or (labels is not None and index >= len(labels)):
        raise ValueError(f"band index {index} is out of range")
    return F.get(bands, F.lit(index))


# --- expression text: how a layer's band maths is stored and rebuilt ---

_SYMBOLS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}


def expression_text(expr) -> str:
    """Infix text of a nested ``(op, left, right)`` tuple; bands are names, constants numbers.

    Nested operations are parenthesised: ``("divide", ("subtract", "nir", "red"), ...)`` gives
    ``(nir - red) / ...``.
    """
    if not isinstance(expr, tuple):
        return expr if isinstance(expr, str) else repr(float(expr)).removesuffix(".0")
    op, *args = expr
    parts = [f"({expression_text(a)})" if isinstance(a, tuple) else expression_text(a) for a in args]
    return f"{parts[0]} {_SYMBOLS[op]} {parts[1]}"


def referenced_bands(expr) -> list[str]:
    """Bands an expression reads, each once, in order of first use."""
    if isinstance(expr, str):
        return [expr]
    if not isinstance(expr, tuple):
        return []
    found: list[str] = []
    for arg in expr[1:]:
        found += [b for b in referenced_bands(arg) if b not in found]
    return found


def expression_column(expr) -> Column:
    """The column of an expression tuple, with zero division and overflow invalid."""
    ops = {"add": band_add, "subtract": band_subtract, "multiply": band_multiply, "divide": band_divide}

    def build(node) -> Column:
        if isinstance(node, tuple):
            return ops[node[0]](build(node[1]), build(node[2]))
        return F.col(node) if isinstance(node, str) else F.lit(float(node))

    return finite_or_null(build(expr))
