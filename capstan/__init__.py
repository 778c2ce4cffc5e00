"""capstan: capacity analytics (series queries, features, forecasts, scoring,
rightsizing and strategy comparison) as Spark DataFrame operators."""

__version__ = "0.1.0"
