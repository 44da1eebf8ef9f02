"""Column functions over JSON payloads (metadata and attributes). Keys are those of the top level only; malformed JSON counts as an empty object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def value(payload: ColumnLike, key: str) -> Column:
    """The value as text (strings without quotes), null where the key is missing, the value is null or the JSON malformed."""
    return F.get_json_object(_c(payload), f"$.{key}")


def top_keys(payload: ColumnLike) -> Column:
    """The keys of the top level; none where there is no object."""
    return F.coalesce(F.json_object_keys(_c(payload)), F.array().cast("array<string>"))


def has_key(payload: ColumnLike, *keys: str) -> Column:
    return F.arrays_overlap(top_keys(payload), F.array(*map(F.lit, keys)))


def is_json_string(payload: ColumnLike, key: str) -> Column:
    """The value is a JSON string, rather than a number, boolean, list or object."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(payload)), f"$.{key}", "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def _number_zero(v: Column) -> Column:
    return F.coalesce(v.try_cast("double") == 0, F.lit(False))


def _says_no(payload: ColumnLike, key: str, v: Column) -> Column:
    """A number that is zero, or an empty list or object; the same written as a text does not."""
    return (v.isin("[]", "{}") | _number_zero(v)) & ~is_json_string(payload, key)


def attr_enabled(payload: ColumnLike, key: str) -> Column:
    """Whether a value stands for yes: not null, no zero number, no text like false, 0, no or none, no empty list or object."""
    v = value(payload, key)
    plain = ~F.lower(F.btrim(v, F.lit(" \t\n\r\x0b\x0c"))).isin("", "false", "0", "no", "none", "null")
    return F.coalesce(v.isNotNull() & plain & ~_says_no(payload, key, v), F.lit(False))


def raw_truthy(payload: ColumnLike, key: str) -> Column:
    """As attr_enabled, but texts are not trimmed and `no` counts as yes."""
    v = value(payload, key)
    plain = ~F.lower(v).isin("", "false", "0", "none", "null")
    return F.coalesce(v.isNotNull() & plain & ~_says_no(payload, key, v), F.lit(False))


def truthy(payload: ColumnLike, key: str) -> Column:
    """Whether a value is non-empty: any text but the empty one, any number but zero, true, a list or object with something in it."""
    v = value(payload, key)
    text = is_json_string(payload, key)
    other = ~v.isin("false", "[]", "{}") & ~_number_zero(v)
    return F.coalesce(v.isNotNull() & F.when(text, v != "").otherwise(other), F.lit(False))


def length(payload: ColumnLike, key: str) -> Column:
    """The length of a list, or of a text in characters; null for anything else."""
    v = value(payload, key)
    return F.when(is_json_string(payload, key), F.length(v)).otherwise(F.json_array_length(v))


def strings(payload: ColumnLike, key: str) -> Column:
    """A list's elements as texts."""
    return F.from_json(value(payload, key), "array<string>")


def source_context(payload: ColumnLike) -> Column:
    """The provenance; production where none is told. The empty text is kept."""
    return F.when(is_json_string(payload, "source_context"), value(payload, "source_context")).otherwise("production")


def is_research(payload: ColumnLike) -> Column:
    context = value(payload, "source_context")
    kind = F.coalesce(value(payload, "source_kind") == "research", F.lit(False))
    return kind | F.coalesce(~context.isin("", "production"), F.lit(False))


def boundary(attributes: ColumnLike) -> Column:
    """Whether a call crosses a trust boundary."""
    return unresolved(attributes) | attr_enabled(attributes, "sink") | attr_enabled(attributes, "cross_boundary")


def unresolved(attributes: ColumnLike) -> Column:
    return attr_enabled(attributes, "unresolved") & ~attr_enabled(attributes, "internal_candidate")


def parsed(payload: ColumnLike) -> Column:
    """The payload read once: a map from key to kind (of JSON value) and text, for many tests of one row."""
    each = F.from_json(_c(payload), "map<string,variant>")
    return F.transform_values(each, lambda k, v: F.struct(F.schema_of_variant(v).alias("kind"), v.cast("string").alias("text")))


def with_parsed(payload: ColumnLike, body) -> Column:
    """body(map), the payload being read once."""
    return F.get(F.transform(F.array(parsed(payload)), body), F.lit(0))


def map_truthy(m: Column, key: str) -> Column:
    """truthy() of a key of parsed()."""
    kind, text = m[key]["kind"], m[key]["text"]
    number = ~F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.coalesce(F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").otherwise(~text.isin("[]", "{}") & number), F.lit(False))


def map_length(m: Column, key: str) -> Column:
    return F.when(m[key]["kind"] == "STRING", F.length(m[key]["text"])).otherwise(F.json_array_length(m[key]["text"]))
