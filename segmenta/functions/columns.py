"""Small helpers for building larger Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A one-element ``transform`` gives the bound value a name, so nesting
    expressions stays linear in size instead of doubling at every level.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def each(arr: Column, body: str) -> Column:
    """``transform`` with the function given as SQL text, e.g. ``t -> upper(t)``:
    one parsed expression where the Column form needs a call per operator."""
    return F.call_function("transform", arr, F.expr(body))


def bind(value: Column, body: str) -> Column:
    """``let`` with an SQL function text."""
    return F.get(each(F.array(value), body), F.lit(0))


def sql_text(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text_or_empty(value) -> Column:
    """NULL is written as the empty string."""
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def or_default(value: Column, default) -> Column:
    """``value || default``: empty and missing both take the default."""
    return F.coalesce(F.nullif(value, F.lit("")), as_col(default))


def materialise(df: DataFrame, name: str, value: Column, keep: list[str] | None = None) -> DataFrame:
    """Add a column that later filters and projections take as given.

    The optimizer pushes a filter through a projection by repeating the
    projected expression inside it; for a parsed message that would parse
    again, below.  Emitted by a generator, the value is computed once per row
    and filters on it stay above, while filters on other columns still reach
    the scan.  A generator interprets its argument, so the value is a column
    of a projection before it, which is compiled and shares common parts."""
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    made = f"__m_{name}"
    return df.select(*keep, value.alias(made)).select(*keep, F.explode(F.array(made)).alias(name))
