"""Deterministic ids and hashed vectors as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of the point ids (a fixed value that stored collections depend on).
POINT_NAMESPACE = "6f1d3c2e-4a5b-4c7d-8e9f-0a1b2c3d4e5f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null when either side is null or the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, p: s + p))


def unsigned_zeros(v: Column) -> Column:
    """The vector with 0.0 for every -0.0, so that equal vectors are the same bytes. The width of its numbers stays."""
    return F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))


def l2(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""

    def scaled(d: Column) -> Column:
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n)))

    return let(F.transform(v, lambda x: x.cast("double")), scaled)


def hashed_vector(text: Column, dim: int = 256) -> Column:
    """A deterministic vector of a text: the SHA-256 stream of text and block counter, two bytes a component."""
    blocks = (dim * 2 + 31) // 32
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lpad(F.hex(c), 4, "0"))), 256)), "")

    def components(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(h.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 32767.5 - 1)

    return let(stream, components)
