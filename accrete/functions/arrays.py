"""Vector and score functions as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def softmax(xs: Column) -> Column:
    """Shifted by the greatest logit."""
    e = F.transform(xs, lambda x: F.exp(x.cast("double") - F.array_max(xs).cast("double")))
    return F.transform(e, lambda x: x / total(e))


def entropy(p: Column, eps: float = 1e-6) -> Column:
    return -total(F.transform(p, lambda x: x * F.log(x + eps)))


def margin(p: Column) -> Column:
    top = F.slice(F.sort_array(p, asc=False), 1, 2)
    return F.get(top, F.lit(0)) - F.get(top, F.lit(1))


def l2(xs: Column) -> Column:
    return F.sqrt(total(F.transform(xs, lambda x: x.cast("double") * x.cast("double"))))


def gradient(p: Column, label: Column) -> Column:
    """Of the cross entropy with respect to the logits."""
    return F.transform(p, lambda x, i: x - (i == label).cast("double"))


def outer(g: Column, e: Column) -> Column:
    return F.flatten(F.transform(g, lambda x: F.transform(e, lambda y: x * y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_half(a: Column, b: Column) -> Column:
    """0.5 + 0.5 * cosine; 0.5 where a norm is zero."""
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = l2(a) * l2(b)
    return F.when(norms > 0, 0.5 + 0.5 * dot / norms).otherwise(0.5)


def top_k(xs: Column, k: int) -> Column:
    """Places of the k greatest, ties by place."""
    order = F.array_sort(F.transform(xs, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the errors of the product and of the sum (Dekker, Knuth) are added last."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)  # 2^27 + 1
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    product = a * b
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total_ = product + c
    rest = total_ - product
    return F.when(F.abs(total_) < 1e290, total_ + ((product - (total_ - rest)) + (c - rest) + lost)).otherwise(total_)


def quantile(xs: Column, q: float) -> Column:
    """The interpolated quantile of the numbers, null of none; low * (1 - d) + high * d with one rounding in the first product and the sum, as quantile_cont."""
    order, at = F.sort_array(xs), (F.size(xs) - 1) * F.lit(float(q))
    low, high = F.get(order, F.floor(at).cast("int")), F.get(order, F.ceil(at).cast("int"))
    d = at - F.floor(at)
    return F.when(d == 0, low).otherwise(fused(1 - d, low, high * d))
