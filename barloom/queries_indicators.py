"""One query and one SQL oracle for every indicator, made from the same graph of lines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.indicators import CLOSE, REGISTRY, indicator
from barloom.plans.lines import Line, to_sql, with_lines
from barloom.sources.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]


def has_fold(x: Line) -> bool:
    return x.kind == "fold" or any(map(has_fold, x.args))


def tidy(names) -> str:
    """Rounded values; adding 0 turns -0 into 0."""
    return ", ".join(["symbol", "dt", *(f"round({n}, 6) + 0 AS {n}" for n in names)])


def line_query(view: str, lines: dict[str, Line]) -> tuple[Query, str | None]:
    bars, sql = VIEWS[view]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_lines(bars(spark, sf_dir), lines).selectExpr(*("symbol", "dt", *(f"round({n}, 6) + 0 AS {n}" for n in lines)))

    return run, to_sql(sql, lines, tidy(lines))


def snake(name: str) -> str:
    return re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)).lower()


def indicator_queries() -> dict[str, tuple[Query, str | None]]:
    out = {}
    for name in REGISTRY:
        lines = indicator(name, **({"data": CLOSE / 1000} if name in ("Accum", "ApplyN") else {}))  # sums that a double holds to 6 places
        out[f"ind_{snake(name)}"] = line_query("hourly" if any(map(has_fold, lines.values())) else "orders", lines)
    return out
