"""Time-series event analytics as Spark DataFrame operators."""
