"""JSON documents of any shape as VARIANT: attachment lists, names and headers, where a text may be an object, a scalar, or broken.

Nothing here fails on a malformed document: what is no array has no attachments, and a broken text is no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document(text: Column) -> Column:
    """The parsed document, or null where the text is null or no JSON."""
    return F.try_parse_json(text)


def kind(text: Column) -> Column:
    """array, object, string, number, boolean, null (a JSON null), or null for what is no document."""
    schema = F.schema_of_variant(document(text))
    of = F.when(schema.startswith("ARRAY<"), "array").when(schema.startswith("OBJECT<"), "object").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null")
    return of.when(schema.isNotNull(), "number")


def elements(text: Column) -> Column:
    """array<variant> of an array; null for everything else."""
    return F.try_variant_get(document(text), "$", "array<variant>")


def has_attachments(text: Column) -> Column:
    """True only for an array that holds something."""
    return F.coalesce(F.size(elements(text)) > 0, F.lit(False))


def field(element: Column, name: str) -> Column:
    """A field of an element as text, whatever it holds; null for a missing or null one, and for elements that are no objects."""
    return F.try_variant_get(element, f"$.{name}", "string")


def names(text: Column, name: str = "filename") -> Column:
    """The names that the elements of an array give, in order, without nulls; empty for everything else."""
    found = F.filter(F.transform(elements(text), lambda x: field(x, name)), lambda n: n.isNotNull())
    return F.coalesce(found, F.array().cast("array<string>"))


def attachments(rows: DataFrame, text_col: str = "attachments", keep: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """A row for each element of each array, with its position, filename, sha256 and whether it is an object at all."""
    at = rows.select(*keep, F.posexplode(elements(F.col(text_col))).alias("position", "_e"))
    is_object = F.coalesce(F.schema_of_variant(F.col("_e")).startswith("OBJECT<"), F.lit(False))
    return at.select(*keep, "position", field(F.col("_e"), "filename").alias("filename"), field(F.col("_e"), "sha256").alias("sha256"), is_object.alias("is_object"))


def header_values(text: Column, name: str) -> Column:
    """Values of a header in a document of {name: [values]} or {name: value}; names are compared without case, and what has another shape has none."""
    pairs = F.map_entries(F.try_variant_get(document(text), "$", "map<string,variant>"))
    own = F.filter(pairs, lambda p: F.lower(p["key"]) == name.lower())
    values = F.transform(own, lambda p: F.coalesce(F.try_variant_get(p["value"], "$", "array<string>"), F.array(F.try_variant_get(p["value"], "$", "string"))))
    return F.coalesce(F.filter(F.flatten(values), lambda v: v.isNotNull()), F.array().cast("array<string>"))
