"""Evaluate a formula in steps.

Long index formulas use each intermediate several times. Each step is a lateral
column alias of the steps before it, so Spark plans a chain of projections and
whole-stage codegen keeps every intermediate in a local variable. Steps are SQL
text: one call and one analysis for a whole formula.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TMP = "__step_"


def _named(text: str) -> str:
    """``:name`` stands for an earlier step."""
    return re.sub(r":([a-z]\w*)", lambda m: TMP + m[1], text)


def compute(df: DataFrame, steps: Mapping[str, str], out: Mapping[str, str]) -> DataFrame:
    """Run the steps and add the columns of ``out`` (replacing equal names).

    The results leave through a one-element generator. A filter or join key on
    them is then evaluated on the finished value; without it the optimizer would
    push the condition below all steps and write the whole formula out, growing
    with every reuse of an intermediate.
    """
    staged = df.selectExpr("*", *[f"{_named(e)} AS {TMP}{k}" for k, e in steps.items()])
    fields = ", ".join(f"'{k}', {_named(e)}" for k, e in out.items())
    keep = [f"`{c}`" for c in df.columns if c not in out]
    return staged.selectExpr(*keep, f"inline_outer(array(named_struct({fields})))")


def as_col(x: Column | str | int | float) -> Column:
    """A column name, a number or a Column, as a Column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    if isinstance(x, int):
        return F.lit(x).cast("long")
    return F.lit(x)


def as_sql(x: str | int | float) -> str:
    """A column name or a number, as SQL text."""
    if isinstance(x, str):
        return f"`{x}`"
    return f"{x}L" if isinstance(x, int) else f"{x!r}D"
