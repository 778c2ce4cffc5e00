"""Writers (A-11..A-15).  Reports are built as DataFrames of text lines from
aggregated (small) tables and written by Spark; nothing is formatted from
collected data rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import maybe_broadcast


def write_experiments(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """A-11: one table partitioned by service (parquet, or CSV with header)."""
    w = df.write.mode(mode).partitionBy("service")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_master(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A-12: the single training table of all services."""
    df.write.mode(mode).parquet(path)
    return path


#: Rows that one exported document may hold.
DOCUMENT_ROWS = 1000


def documents_of(df: DataFrame, keys, rows: int = DOCUMENT_ROWS) -> DataFrame:
    """Add ``_doc``: a number that splits the rows of each key over documents of
    about ``rows`` rows, so that no document grows with the data."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_docs"))
    each = F.xxhash64(*[F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])
    return df.join(maybe_broadcast(n), keys).withColumn("_doc", F.pmod(each, F.col("_docs"))).drop("_docs")


def _fmt(x: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(F.col(x).cast("double"), F.lit(0.0)))


# section number and title -> (column title, column, digits)
REPORT_SECTIONS = [
    ("Cost efficiency", [("cpu hours", "mean_cpu_hours", 4), ("memory hours", "mean_memory_hours", 4),
                         ("cpu cores", "mean_cpu_cores", 2), ("memory GB", "mean_memory_gb", 2)]),
    ("Performance integrity", [("mean p95", "mean_p95_latency", 4), ("max p95", "max_p95_latency", 4),
                               ("error rate", "mean_error_rate", 4), ("throughput", "mean_throughput", 2)]),
    ("Stability", [("scaling events", "mean_scaling_events", 2), ("all scaling events", "total_scaling_events", 0),
                   ("volatility", "mean_volatility", 4), ("max volatility", "max_volatility", 4)]),
]
UNSUPPORTED = "Unsupported output format"


def _lines(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "line string, _o string")


def strategy_report_lines(report: DataFrame, savings: DataFrame | None, service: str,
                          fmt: str = "markdown") -> DataFrame:
    """A-13: the comparative report as (line, _o), _o giving the order: markdown
    with a section each for cost, performance and stability, or one JSON document;
    any other format gives the single line ``Unsupported output format``.
    ``report`` is the L-11 table (one row per strategy); columns it lacks are left
    out."""
    spark = report.sparkSession
    have = set(report.columns)
    sections = [(title, [x for x in cols if x[1] in have]) for title, cols in REPORT_SECTIONS]
    if fmt == "json":
        # one entry a strategy: a handful
        part = lambda cols: F.sort_array(F.collect_list(F.struct("strategy", *[c for _, c, _ in cols])))
        doc = report.agg(*[part(cols).alias(title.lower().replace(" ", "_")) for title, cols in sections])
        if savings is not None:
            doc = doc.join(savings.agg(F.collect_list(F.struct("*")).alias("savings")))
        return doc.select(F.to_json(F.struct(F.lit(service).alias("service_name"), "*")).alias("line"), F.lit("0").alias("_o"))
    if fmt != "markdown":
        return _lines(spark, [(UNSUPPORTED, "0")])
    parts = _lines(spark, [(f"# Comparative report: {service}", "0")])
    for k, (title, cols) in enumerate(sections, 1):
        head = " | ".join(["| strategy", *[t for t, _, _ in cols]]) + " |"
        parts = parts.unionByName(_lines(spark, [(f"## {title}", f"{k}0"), (head, f"{k}1"), ("| --- " * (len(cols) + 1) + "|", f"{k}2")]))
        row = F.concat(F.lit("| "), F.concat_ws(" | ", "strategy", *[_fmt(c, d) for _, c, d in cols]), F.lit(" |"))
        parts = parts.unionByName(report.select(row.alias("line"), F.concat(F.lit(f"{k}3"), "strategy").alias("_o")))
        if k == 1 and savings is not None:
            parts = parts.unionByName(savings.select(F.concat(
                F.lit("Savings of "), "candidate", F.lit(" over "), "baseline", F.lit(": cpu "), _fmt("cpu_savings_percent", 2),
                F.lit("%, memory "), _fmt("memory_savings_percent", 2), F.lit("%, overall "), _fmt("overall_savings_percent", 2),
                F.lit("%")).alias("line"), F.concat(F.lit("14"), "candidate").alias("_o")))
    return parts


def write_report(lines: DataFrame, path: str) -> str:
    """A-13 sink: a text file of the report lines in order (one partition:
    the report has one line per strategy)."""
    lines.orderBy("_o").select("line").coalesce(1).write.mode("overwrite").text(path)
    return path


def write_metrics(samples: DataFrame, summary: DataFrame, path: str) -> str:
    """A-14: sample rows and the summary as JSON under one folder."""
    samples.write.mode("overwrite").json(f"{path}/samples")
    summary.write.mode("overwrite").json(f"{path}/summary")
    return path


def evaluation_lines(scores: DataFrame, summary: DataFrame, comp: DataFrame | None = None,
                     by_target: DataFrame | None = None) -> DataFrame:
    """A-15: fleet line, a line per service (V-19..V-21), and the standards report:
    a line per checked result (V-18) and the mean score per target (V-22)."""
    failed = F.col("overall_score").isNull()
    per = scores.select(
        F.when(failed, F.format_string("%s: no successful result", "service"))
        .otherwise(F.format_string("%s: overall score %.1f%% (%s)", "service", "overall_score", "band")).alias("line"),
        F.concat(F.lit("1"), F.col("service")).alias("_o"))
    fleet = summary.select(F.format_string(
        "Services: %d, failed %d, average score %.1f%%, excellent %d, good %d, acceptable %d, below %d",
        "total_services", "failed_evaluations", "average_score", "excellent_services", "good_services", "acceptable_services",
        "below_standard_services").alias("line"), F.lit("0").alias("_o"))
    out = fleet.unionByName(per)
    if comp is not None:
        keys = [c for c in ("service", "target", "model") if c in comp.columns]
        word = lambda c: F.when(F.col(c), "pass").when(~F.col(c), "fail").otherwise("none")
        checks = F.concat_ws(", ", *[F.concat(F.lit(f"{n} "), word(f"{n}_compliant")) for n in ("mse", "mae", "r2", "overall", "confidence")])
        out = out.unionByName(comp.select(F.concat(F.concat_ws(" / ", *keys), F.lit(": "), checks).alias("line"),
                                          F.concat(F.lit("2"), F.concat_ws("/", *keys)).alias("_o")))
    if by_target is not None:
        out = out.unionByName(by_target.select(F.format_string("%s: mean score %.1f%% over %d services", "target", "mean_score", "n_services")
                                               .alias("line"), F.concat(F.lit("3"), "target").alias("_o")))
    return out
