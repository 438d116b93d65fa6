"""Numeric expressions with the missing-value rules of the data: NaN is null, x / 0 is null."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(c: Column | str) -> Column:
    """NaN to null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({n: present(n) for n, t in df.dtypes if t in ("double", "float")})


def number(c: str) -> Column:
    """A lenient cast: what is no number is null."""
    return present(F.expr(f"try_cast(`{c}` as double)"))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def total(columns: list[str]) -> Column:
    """Horizontal sum; nulls count 0."""
    return reduce(add, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers count 0; whole numbers become doubles."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def signed_exp(c: Column) -> Column:
    return F.signum(c) * F.expm1(F.abs(c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def money(c: Column) -> Column:
    """Short text in millions or thousands of pounds."""
    return F.when(F.abs(c) >= 1e6, F.format_string("£%.2fM", c / 1e6)).when(c.isNotNull(), F.format_string("£%.0fk", c / 1e3))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation as an aggregate; null, not an error, where a column is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
