"""Column functions that keep the estimator's conventions: ln 0 is -Infinity, half-even counts per million, keyed uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logsumexp(values: Column) -> Column:
    """Of an array column; all -Infinity gives -Infinity."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(top == F.lit("-Infinity").cast("double"), top).otherwise(top + F.ln(total))


def expit(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, clip: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q) - F.log1p(-q)


def cpm(weight: Column) -> Column:
    """Counts per million, rounded half to even."""
    return F.bround(weight * 1_000_000).cast("long")


def uniform(*keys) -> Column:
    """A uniform of [0, 1) that depends on its keys alone, not on partitions or order."""
    text = F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, inside expressions that name it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(values: Column) -> Column:
    """exp(x) normalised, of an array of logarithms with at least one finite entry."""

    def shares(e: Column) -> Column:
        return bind(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

    def shifted(v: Column) -> Column:
        return bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    return bind(values, lambda v: bind(shifted(v), shares))


def first_argmax(values: Column) -> Column:
    """0-based place of the largest entry, the first one of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
