"""Security-telemetry analytics as Spark DataFrame and stream operators."""
