"""Column expressions: class codes, losses, names, rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Map-unit symbols and their integer codes.
CLASS_CODES = {"af1": 1, "Qal": 2, "Qaf": 3, "Qat": 4, "Qc": 5, "Qca": 6, "Qr": 7}
# Fixed value: what a pixel outside a patch is filled with.
PATCH_FILL = -999999.0
# Fixed value: tolerance (map units) that closes slivers between polygons.
SLIVER_TOLERANCE = 0.1


def encode_class(col: Column | str, mapping: Mapping[str, int] = CLASS_CODES) -> Column:
    """Code of a class symbol; an unknown symbol is NULL (nodata)."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(col) if isinstance(col, str) else col)


def image_name(path: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def sigmoid(x: Column) -> Column:
    """Logistic function, written so that ``exp`` never overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in its stable form."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal_loss_element(
    logit: Column,
    target: Column,
    alpha: float | Sequence[float] | Column = 1.0,
    gamma: float = 2.0,
    label: Column | None = None,
) -> Column:
    """``alpha * (1 - pt)^gamma * bce`` with ``pt = exp(-bce)``.

    ``alpha`` may hold one weight per class, picked by the 0-based ``label``.
    """
    bce = bce_with_logits(logit, target.cast("double"))
    if isinstance(alpha, (int, float)):
        weight = F.lit(float(alpha))
    elif isinstance(alpha, Column):
        weight = alpha
    else:
        if label is None:
            raise ValueError("alpha per class needs the label column")
        weight = F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), (label + 1).cast("int"))
    return weight * F.pow(1.0 - F.exp(-bce), F.lit(float(gamma))) * bce


def round_half_even(col: Column | str, digits: int) -> Column:
    """Rounding as in Python: halves go to the even neighbour."""
    return F.bround(col, digits)


def scale_rgb(v: Column) -> Column:
    """8-bit band value to 0..1."""
    return v / 255.0
