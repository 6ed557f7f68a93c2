"""Casts and parsers that give NULL, not an error, on a bad value, and JSON readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ISO-8601 layout that counts as a timestamp (zone required,
# one to nine fraction digits allowed) and the two spellings of a boolean.
ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"
ISO_SHORTEST = len("2024-01-01T00:00:00Z")
BOOLEAN_WORDS = ("true", "false")


def safe_int(text: Column) -> Column:
    return text.try_cast("bigint")


def safe_bool(text: Column) -> Column:
    """true/false in any case; Spark's own cast would also take yes, 1 and t."""
    word = F.lower(text)
    return F.when(word.isin(*BOOLEAN_WORDS), word == "true")


def safe_timestamp(text: Column) -> Column:
    """UTC instant of an ISO-8601 text; NULL without a time of day or a zone.

    Texts too short for that, mere days for instance, are not given to the parser, whose failure is dear.
    """
    return F.when(F.octet_length(text) >= ISO_SHORTEST, F.try_to_timestamp(text, F.lit(ISO_TIMESTAMP)))


def scalar_text(value: Column) -> Column:
    """Text of a VARIANT that holds a scalar; objects and arrays give NULL."""
    shape = F.schema_of_variant(value)
    nested = shape.startswith("OBJECT") | shape.startswith("ARRAY")
    return F.when(~nested, F.try_variant_get(value, "$", "string"))


def json_scalar(payload: Column, path: str) -> Column:
    """One scalar out of a JSON text.  For many paths use ``flatten_payload``."""
    return scalar_text(F.try_variant_get(F.try_parse_json(payload), path, "variant"))


def json_object_text(payload: Column, path: str) -> Column:
    """The JSON text below ``path``; a missing part becomes the text ``null``."""
    return F.coalesce(F.get_json_object(payload, path), F.lit("null"))


def json_array_size(text: Column, strict: bool = False) -> Column:
    """Length of a JSON array, 0 for NULL.

    ``strict`` raises on text that is not an array; otherwise that counts as 0.
    """
    size = F.json_array_length(text)
    if strict:
        size = F.when(
            text.isNotNull() & size.isNull(),
            F.raise_error(F.concat(F.lit("not a JSON array: "), text)).cast("int"),
        ).otherwise(size)
    return F.coalesce(size, F.lit(0))
