from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """NULL instead of an ANSI error on division by zero."""
    return F.try_divide(as_col(a), as_col(b))
