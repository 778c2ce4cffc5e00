"""Requests granted under a cluster cap by service priority.

Requests are taken in order of their service's priority, then by service and name;
each gets what is left of the cap, so all before some request are granted whole, that
one in part, and the later ones not at all.  What is left is a running sum over all
requests, in parts of bounded size, in whole units (millicores, bytes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import CHUNK_ROWS, sum_before

# Usable share of the cluster, and the services in order of priority.
CAP_PCT = 80
PRIORITIES = ["checkoutservice", "frontend", "cartservice", "productcatalogservice", "recommendationservice"]


def priority_of(service, priorities=PRIORITIES):
    """Place of a service in the list, from 1; services not listed come after."""
    at = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(service))
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(priorities) + 1)).otherwise(at).cast("long")


def grants(requests: DataFrame, capacity: int, amount: str = "requested", service: str = "service", name: str = "name",
           priorities=PRIORITIES, cap_pct: int = CAP_PCT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``requests`` with ``priority``, ``granted`` and ``outcome`` (granted, partial,
    refused).  Negative or null amounts count as 0 and are granted.  (service, name)
    should tell requests apart; equal ones are taken in any order."""
    cap = capacity * cap_pct // 100
    want = F.greatest(F.coalesce(F.col(amount).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    d = requests.withColumn("priority", priority_of(service, priorities)).withColumn("_want", want.cast("decimal(38,0)"))
    d = sum_before(d, [], ["priority", service, name], "_want", "_before", chunk_rows)
    left = F.greatest(F.lit(cap).cast("decimal(38,0)") - F.col("_before").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    granted = F.least(F.col("_want"), left).cast("long")
    outcome = F.when(granted == F.col("_want"), "granted").when(granted > 0, "partial").otherwise("refused")
    return d.select(*requests.columns, "priority", granted.alias("granted"), outcome.alias("outcome"))
