"""Queries over the four export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(content: DataFrame, styles: DataFrame, semantics: DataFrame) -> DataFrame:
    """Styles join on content_id, semantics on element_id; Catalyst chooses how."""
    named = styles.withColumnRenamed("element_id", "_style_of")
    return content.join(named, F.col("content_id") == F.col("_style_of")).drop("_style_of").join(semantics, "element_id")


def with_role(tables: DataFrame, role: str, bold: bool | None = True) -> DataFrame:
    out = tables.where(F.col("semantic_role") == role)
    return out if bold is None else out.where(F.col("style_bold") == F.lit(bold))


def mentions_page(metadata: Column, page: int) -> Column:
    """By substring, as the documentation has it: page 5 also finds 50."""
    return metadata.contains(f'"page": {page}')


def is_on_page(metadata: Column, page: int) -> Column:
    return F.get_json_object(metadata, "$.page") == str(page)
