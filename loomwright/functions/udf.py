"""Arrow functions that are made when first applied, so that modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(kind: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a pandas function of columns with a result type in DDL; `once` keeps a filter on its result from running it anew."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def apply(*columns) -> Column:
            made = F.pandas_udf(f, kind)
            return (made.asNondeterministic() if once else made)(*columns)

        return apply

    return wrap
