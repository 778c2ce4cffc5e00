"""Resource quantity parsing and formatting (Q-1..Q-4) as Column expressions.

All of these are pure Catalyst expressions: they stay inside whole-stage
codegen and never call Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# Unit multipliers of resource quantities.
KI, MI, GI = 1024, 1024 ** 2, 1024 ** 3
K, M, G = 1000, 1000 ** 2, 1000 ** 3
MIN_MEMORY_BYTES = 128 * MI          # floor of a memory recommendation
MIN_CPU_CORES = 0.1                  # floor of a cpu recommendation


def _num(text: Column) -> Column:
    return text.try_cast("double")


def parse_cpu(c) -> Column:
    """CPU text -> cores: ``250m`` -> 0.25, ``5n`` -> 5e-9, ``1.5`` -> 1.5.

    NULL, empty, ``Unknown`` and text that is not a number give 0.0.
    """
    c = as_col(c)
    s = F.trim(c)
    body1 = s.substr(F.lit(1), F.length(s) - 1)
    parsed = (
        F.when(s.endswith("m"), _num(body1) / 1000.0)
        .when(s.endswith("n"), _num(body1) / 1e9)
        .otherwise(_num(s))
    )
    return (F.when(c.isNull() | (s == "") | (s == "Unknown"), F.lit(0.0))
            .otherwise(F.coalesce(parsed, F.lit(0.0))))


def parse_memory(c) -> Column:
    """Memory text -> bytes (long, truncated): ``Ki/Mi/Gi`` binary, ``K/M/G`` decimal."""
    c = as_col(c)
    s = F.trim(c)
    n = F.length(s)
    body2 = _num(s.substr(F.lit(1), n - 2))
    body1 = _num(s.substr(F.lit(1), n - 1))
    value = (
        F.when(s.endswith("Ki"), body2 * KI)
        .when(s.endswith("Mi"), body2 * MI)
        .when(s.endswith("Gi"), body2 * GI)
        .when(s.endswith("K"), body1 * K)
        .when(s.endswith("M"), body1 * M)
        .when(s.endswith("G"), body1 * G)
        .otherwise(_num(s))
    )
    out = F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(c.isNull() | (s == "") | (s == "Unknown"), F.lit(0).cast("bigint")).otherwise(out)


def parse_memory_gb(c) -> Column:
    """Memory text -> GiB as the cost collector reads it (``Mi``/``Gi``/bytes)."""
    c = as_col(c)
    s = F.trim(c)
    n = F.length(s)
    body2 = _num(s.substr(F.lit(1), n - 2))
    return F.coalesce(
        F.when(s.endswith("Mi"), body2 / 1024.0)
        .when(s.endswith("Gi"), body2)
        .otherwise(_num(s) / float(GI)),
        F.lit(0.0))


def _strip_zeros(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")


def format_cpu(c) -> Column:
    """Cores -> text: below one core ``<int millicores>m`` (truncated), else
    three decimals (half-up) with trailing zeros cut: 2.5 -> ``2.5``, 1.0 -> ``1``."""
    c = as_col(c)
    milli_trunc = (c * 1000).cast("long")
    milli_round = F.floor(c * 1000 + 0.5).cast("long")
    whole = F.floor(milli_round / 1000).cast("long")
    frac = F.lpad(F.pmod(milli_round, F.lit(1000)).cast("string"), 3, "0")
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(c < 1.0, F.concat(milli_trunc.cast("string"), F.lit("m")))
            .otherwise(_strip_zeros(F.concat(whole.cast("string"), F.lit("."), frac))))


def _round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * (10 ** digits) + 0.5).cast("long")


def format_memory(c) -> Column:
    """Bytes -> text: ``x.yGi`` / ``xMi`` / ``xKi`` / bytes; half-up rounding."""
    c = as_col(c).cast("double")
    gi10 = _round_half_up(c / GI, 1)
    gi = F.concat(F.floor(gi10 / 10).cast("long").cast("string"), F.lit("."),
                  F.pmod(gi10, F.lit(10)).cast("string"), F.lit("Gi"))
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(c >= GI, gi)
            .when(c >= MI, F.concat(_round_half_up(c / MI, 0).cast("string"), F.lit("Mi")))
            .when(c >= KI, F.concat(_round_half_up(c / KI, 0).cast("string"), F.lit("Ki")))
            .otherwise(c.cast("long").cast("string")))
