"""Telemetry analytics as DataFrame operators: metrics, logs and traces on Spark."""
