"""Registered end-to-end plans (Spark) with their DuckDB oracle SQL."""

from . import q_experiments, q_features, q_ml, q_models, q_monitor, q_rightsize, q_series, q_sources, q_strategy, q_stream  # noqa: F401
from .registry import REGISTRY  # noqa: F401
