"""Queries that are written once as SQL: @name stands for an input, @ts for the type of a time without a zone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def spark_sql(template: str, **inputs: DataFrame) -> DataFrame:
    """The query over DataFrames; Catalyst plans it like any other."""
    text = template.replace("@ts", "TIMESTAMP_NTZ").replace("@double", "DOUBLE")
    for name in inputs:
        text = re.sub(rf"@{name}\b", f"{{{name}}}", text)
    return next(iter(inputs.values())).sparkSession.sql(text, **inputs)


def duck_sql(template: str, **inputs: str) -> str:
    text = template.replace("@ts", "TIMESTAMP").replace("@double", "DOUBLE")
    for name, sql in inputs.items():
        text = re.sub(rf"@{name}\b", f"({sql})", text)
    return text
