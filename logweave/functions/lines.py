"""JSON lines as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_line(line: Column) -> Column:
    """The JSON value of a line; null if it is torn or anything follows the value.

    The parser itself would take ``{"a": 1} and more`` for an object. Inside
    brackets whatever follows is an error or a second element.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    alone = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(boxed, "$[0]", "variant"))


def is_object(value: Column) -> Column:
    """Whether a parsed line is a JSON object; false for null."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
