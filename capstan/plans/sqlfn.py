"""SQL text helpers for the DuckDB oracle (mirror of capstan.functions)."""

from __future__ import annotations


def parse_cpu(c: str) -> str:
    s = f"trim({c})"
    body = f"left({s}, length({s}) - 1)"
    return (f"(CASE WHEN {c} IS NULL OR {s} = '' OR {s} = 'Unknown' THEN 0.0::DOUBLE "
            f"WHEN {s} LIKE '%m' THEN coalesce(TRY_CAST({body} AS DOUBLE) / 1000.0, 0.0) "
            f"WHEN {s} LIKE '%n' THEN coalesce(TRY_CAST({body} AS DOUBLE) / 1e9, 0.0) "
            f"ELSE coalesce(TRY_CAST({s} AS DOUBLE), 0.0) END)")


def parse_memory(c: str) -> str:
    s = f"trim({c})"
    b2 = f"TRY_CAST(left({s}, length({s}) - 2) AS DOUBLE)"
    b1 = f"TRY_CAST(left({s}, length({s}) - 1) AS DOUBLE)"
    v = (f"(CASE WHEN {s} LIKE '%Ki' THEN {b2} * 1024 WHEN {s} LIKE '%Mi' THEN {b2} * 1048576 "
         f"WHEN {s} LIKE '%Gi' THEN {b2} * 1073741824 WHEN {s} LIKE '%K' THEN {b1} * 1000 "
         f"WHEN {s} LIKE '%M' THEN {b1} * 1000000 WHEN {s} LIKE '%G' THEN {b1} * 1000000000 "
         f"ELSE TRY_CAST({s} AS DOUBLE) END)")
    return (f"(CASE WHEN {c} IS NULL OR {s} = '' OR {s} = 'Unknown' THEN 0::BIGINT "
            f"ELSE coalesce(TRY_CAST(trunc({v}) AS BIGINT), 0::BIGINT) END)")


def parse_memory_gb(c: str) -> str:
    s = f"trim({c})"
    b2 = f"TRY_CAST(left({s}, length({s}) - 2) AS DOUBLE)"
    return (f"coalesce(CASE WHEN {s} LIKE '%Mi' THEN {b2} / 1024.0 WHEN {s} LIKE '%Gi' THEN {b2} "
            f"ELSE TRY_CAST({s} AS DOUBLE) / 1073741824.0 END, 0.0)")


def _strip(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '')"


def format_cpu(c: str) -> str:
    mr = f"CAST(floor({c} * 1000 + 0.5) AS BIGINT)"
    txt = f"CAST(floor({mr} / 1000) AS BIGINT) || '.' || lpad(CAST({mr} % 1000 AS VARCHAR), 3, '0')"
    return (f"(CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 1.0 THEN CAST(trunc({c} * 1000) AS BIGINT) || 'm' "
            f"ELSE {_strip(txt)} END)")


def format_memory(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    g10 = f"CAST(floor({x} / 1073741824 * 10 + 0.5) AS BIGINT)"
    return (f"(CASE WHEN {c} IS NULL THEN NULL "
            f"WHEN {x} >= 1073741824 THEN CAST(floor({g10} / 10) AS BIGINT) || '.' || ({g10} % 10) || 'Gi' "
            f"WHEN {x} >= 1048576 THEN CAST(floor({x} / 1048576 + 0.5) AS BIGINT) || 'Mi' "
            f"WHEN {x} >= 1024 THEN CAST(floor({x} / 1024 + 0.5) AS BIGINT) || 'Ki' "
            f"ELSE CAST(trunc({x}) AS BIGINT)::VARCHAR END)")


def safe_div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"
