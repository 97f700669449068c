"""Strictly typed reads from parsed JSON (VARIANT).

A plain variant cast is looser than the record format allows (``"5"`` and
``5.0`` both cast to 5), so a read checks the stored type first. Each look-up
walks the value again, so reads take as few as they can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node(v: Column, path: str) -> Column:
    """Sub-value as VARIANT; SQL NULL only when the path is missing."""
    return F.try_variant_get(v, path, "variant")


def _stored(v: Column, path: str, kind: str) -> Column:
    return F.schema_of_variant(node(v, path)) == kind


def text(v: Column, path: str) -> Column:
    # of the types of JSON only strings cast to bytes
    return F.try_variant_get(v, path, "binary").cast("string")


def members(v: Column, schema: str) -> Column:
    """The members of an object in one walk; missing ones cost nothing. Members of type ``binary`` are strings only, as :func:`text` reads them."""
    return F.try_variant_get(v, "$", f"struct<{schema}>")


def nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def flag(v: Column, path: str) -> Column:
    """True only for a JSON ``true``."""
    return F.coalesce(F.when(_stored(v, path, "BOOLEAN"), F.try_variant_get(v, path, "boolean")), F.lit(False))


def integer(v: Column, path: str) -> Column:
    return F.when(_stored(v, path, "BIGINT"), F.try_variant_get(v, path, "bigint"))


def unsigned(v: Column, path: str) -> Column:
    """Unsigned integer or NULL."""
    value = integer(v, path)
    return F.when(value >= 0, value)


def unsigned_or_zero(v: Column, path: str) -> Column:
    return F.greatest(integer(v, path), F.lit(0).cast("bigint"))


def number(v: Column, path: str) -> Column:
    """Any JSON number as double, NULL for other types."""
    kind = F.schema_of_variant(node(v, path))
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(v, path, "double"))


def present(v: Column, path: str) -> Column:
    """Key exists (its value may be JSON null)."""
    return node(v, path).isNotNull()


def present_nonnull(v: Column, path: str) -> Column:
    return present(v, path) & ~F.is_variant_null(node(v, path))


def items(v: Column, path: str) -> Column:
    """Array elements, NULL when the value is not an array."""
    return F.try_variant_get(v, path, "array<variant>")


def flat_text(v: Column, path: str) -> Column:
    """A string, or the ``text`` members of an array joined by newlines."""
    parts = F.filter(F.transform(items(v, path), lambda b: text(b, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(parts, "\n"), text(v, path), F.lit(""))
