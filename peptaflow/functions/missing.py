"""Missing values: text tokens, sentinels and IEEE division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that means missing in the data stages, and in the workflow stage (which lacks N/A).
NA_TOKENS = ("None", "", "NA", "Na", "N/A", "none", ".")
NA_TOKENS_WORKFLOW = ("None", "", "NA", "Na", "none", ".")
#: Stand-ins for a missing affinity, distance or rank.
BIG_INT, BIGGER_INT = 2**30, 2**32


def is_na(c: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    return c.isNull() | c.isin(*tokens)


def na_to_null(c: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    return F.when(~is_na(c, tokens), c)


def to_number(c: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    """Text to double; missing tokens and text that is no number become null."""
    return na_to_null(c, tokens).try_cast("double")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with x/0 = infinity, 0/0 = NaN and nulls passed on, whatever the ANSI setting."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))
