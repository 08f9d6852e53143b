"""Arrow UDFs that modules can define before there is a session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, functions as F


def arrow_udf(returns: str):
    """Like pandas_udf, but the return type is parsed when the function is first applied."""

    def wrap(f):
        @wraps(f)
        def apply(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return apply

    return wrap
