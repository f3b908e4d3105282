"""Schema-driven rewriting of nested records (PRJ04, PRJ05, PRJ08, PRJ16, PRJ18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binary_paths(schema: T.DataType, path: str = "") -> list[str]:
    """Where a schema holds bytes, arrays as ``[]``."""
    if isinstance(schema, T.BinaryType):
        return [path]
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in binary_paths(f.dataType, f"{path}.{f.name}".lstrip("."))]
    if isinstance(schema, T.ArrayType):
        return binary_paths(schema.elementType, path + "[]")
    return []


def only_blob(schema: T.StructType) -> str:
    """PRJ04: the one path with bytes; an error unless there is exactly one."""
    found = binary_paths(schema)
    if len(found) != 1:
        raise ValueError(f"{len(found)} embedded blobs: {found}")
    return found[0]


def without_bytes(column: Column, kind: T.DataType) -> Column:
    """PRJ05: the value without fields called ``bytes``; other bytes become their length."""
    if isinstance(kind, T.BinaryType):
        return F.struct(F.octet_length(column).alias("binary_length"))
    if isinstance(kind, T.StructType):
        fields = [without_bytes(column[f.name], f.dataType).alias(f.name) for f in kind if f.name != "bytes"]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: without_bytes(x, kind.elementType))
    return column


def known_names(given: str, known: list[str]) -> list[str]:
    """PRJ18: ``all`` or a comma list, in the order of the known names; an unknown name is an error."""
    if given.strip() == "all":
        return list(known)
    names = [n.strip() for n in given.split(",") if n.strip()]
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return [n for n in known if n in names]


def under(path: Column, root: str) -> Column:
    """FLT11: whether a relative path, its dots resolved, lies below ``root``; NULL, absolute paths and those that leave the base don't."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # The names above the current one; NULL, and so it stays, once a step has led out of the base.
    names = lambda a: F.slice(a, 1, F.size(a) - 1)
    step = lambda a, p: F.when(p != "..", F.array_append(a, p)).when(F.size(a) > 0, names(a))
    resolved = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.coalesce(~F.startswith(path, F.lit("/")) & (F.get(resolved, F.lit(0)) == root) & (F.size(resolved) > 1), F.lit(False))


def first_mismatch(a: Column, b: Column) -> Column:
    """JOI16, SCL50: the first position, from 0, at which two arrays differ; NULL if they are equal."""
    n = F.greatest(F.size(a), F.size(b))
    places = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | (i >= F.size(a)) | (i >= F.size(b)))
    return F.get(places, F.lit(0))


def aligned(expected: Column, actual: Column, value: Column) -> Column:
    """FLT14: the value if the two arrays are equal throughout, else NULL; missing arrays are not aligned."""
    return F.when(expected.isNotNull() & actual.isNotNull() & first_mismatch(expected, actual).isNull(), value)


def context(a: Column, place: Column, reach: int = 12) -> Column:
    """WIN15: the elements up to ``reach`` positions around a place."""
    low = F.greatest(F.lit(0), place - reach)
    return F.slice(a, low + 1, place + reach - low + 1)
