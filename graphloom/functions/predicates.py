"""Filter operators over dotted paths, compiled to columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Envelope fields that other spellings of a path stand for.
ENVELOPE = {
    "metadata.tags": "tags",
    "metadata.aliases": "aliases",
    "metadata.version": "version",
    "metadata.confidence": "confidence",
    "metadata.createdBy": "created_by",
    "timestamps.createdAt": "created_at",
    "timestamps.updatedAt": "updated_at",
    "timestamps.deletedAt": "deleted_at",
    "embeddings.dense": "embedding",
    "sourceId": "source_id",
    "targetId": "target_id",
}


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any


def resolve(df: DataFrame, path: str, like: Any = None) -> Column:
    """The column that a path names: envelope field, typed property, or an entry of the properties map.

    Values of the map are strings; they take the type of `like`, the value that they are compared with. A path that
    names nothing is null.
    """
    path = ENVELOPE.get(path, path)
    head, _, rest = path.partition(".")
    if path in df.columns:
        return F.col(f"`{path}`")
    if head == "properties" and rest:
        if f"p_{rest}" in df.columns:
            return F.col(f"`p_{rest}`")
        if "properties" not in df.columns:
            return F.lit(None).cast("string")
        raw = F.try_element_at("properties", F.lit(rest))
        if "." in rest:  # a key with dots, or a path into a value that is JSON, at any depth
            key, _, inner = rest.partition(".")
            steps = "".join(f"['{x}']" for x in inner.split("."))
            raw = F.coalesce(raw, F.get_json_object(F.try_element_at("properties", F.lit(key)), f"${steps}"))
        if isinstance(like, (list, tuple)) and like:
            like = like[0]
        if isinstance(like, bool):
            return raw.try_cast("boolean")
        return raw.try_cast("double") if isinstance(like, (int, float)) else raw
    if rest and head in df.columns and isinstance(df.schema[head].dataType, T.StructType):
        at, kind = F.col(f"`{head}`"), df.schema[head].dataType
        for name in rest.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return F.lit(None).cast("string")
            at, kind = at.getField(name), kind[name].dataType
        return at
    return F.lit(None).cast("string")


def as_text(df: DataFrame, col: Column) -> Column:
    """A value as text: arrays joined by commas, whole doubles without a fraction."""
    kind = df.select(col.alias("c")).schema[0].dataType
    if isinstance(kind, T.ArrayType):
        return F.array_join(col.cast("array<string>"), ",")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(col == F.floor(col), col.cast("decimal(38,0)").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in(c: Column, v: Any) -> Column:
    return _false(c.isin(list(v))) if isinstance(v, (list, tuple, set)) else F.lit(False)


def _nin(c: Column, v: Any) -> Column:
    return F.coalesce(~c.isin(list(v)), F.lit(True)) if isinstance(v, (list, tuple, set)) else F.lit(False)


#: Missing values equal only null; no comparison or text operator holds for them; neq and nin do.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "neq": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: _false(c > F.lit(v)),
    "gte": lambda c, v: _false(c >= F.lit(v)),
    "lt": lambda c, v: _false(c < F.lit(v)),
    "lte": lambda c, v: _false(c <= F.lit(v)),
    "in": _in,
    "nin": _nin,
}
TEXT_OPERATORS: dict[str, Callable[[Column, str], Column]] = {
    "contains": lambda c, v: _false(F.contains(c, F.lit(v))),
    "startsWith": lambda c, v: _false(F.startswith(c, F.lit(v))),
    "endsWith": lambda c, v: _false(F.endswith(c, F.lit(v))),
    "regex": lambda c, v: _false(c.rlike(v)),
}


def predicate(df: DataFrame, f: Filter) -> Column:
    """One filter as a column that is never null. An unknown operator is an error."""
    if f.operator in OPERATORS:
        return OPERATORS[f.operator](resolve(df, f.field, f.value), f.value)
    if f.operator in TEXT_OPERATORS:
        return TEXT_OPERATORS[f.operator](as_text(df, resolve(df, f.field)), str(f.value))
    raise ValueError(f"unknown filter operator: {f.operator}")


def all_of(df: DataFrame, filters: Iterable[Filter]) -> Column:
    """Their conjunction; true for none."""
    return reduce(lambda a, b: a & b, [predicate(df, f) for f in filters], F.lit(True))


def where(df: DataFrame, filters: Iterable[Filter] | Column | Callable[[DataFrame], Column] | None) -> DataFrame:
    """df filtered by filters, by a column, or by a function from a frame to a column."""
    if filters is None:
        return df
    if isinstance(filters, Column):
        return df.where(filters)
    if callable(filters):
        return df.where(filters(df))
    return df.where(all_of(df, filters))


def candidates(df: DataFrame, label: str | None = None, type_: str | None = None) -> Column:
    """Label or any alias has the text, whatever its case; and the type is equal."""
    out = F.lit(True)
    if label is not None:
        text = label.lower()
        out = F.contains(F.lower("label"), F.lit(text)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(text)))
    return out & (F.col("type") == type_) if type_ is not None else out


def search(text: str) -> Column:
    """Label or type has the text, whatever its case."""
    return F.contains(F.lower("label"), F.lit(text.lower())) | F.contains(F.lower("type"), F.lit(text.lower()))


def inside_box(df: DataFrame, south: float, west: float, north: float, east: float, lat: str = "properties.lat", lon: str = "properties.lon") -> Column:
    """Whether a place is in a box; one whose west is east of its east goes over the date line. No place, no hit."""
    y, x = resolve(df, lat, 0.0).try_cast("double"), resolve(df, lon, 0.0).try_cast("double")
    across = x.between(west, east) if west <= east else (x >= west) | (x <= east)
    return _false(y.between(south, north) & across)


def not_deleted() -> Column:
    return F.col("deleted_at").isNull()
