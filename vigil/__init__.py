"""Vigil: Spark-first analytics for operational telemetry and incident knowledge."""
