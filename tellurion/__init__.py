"""Telemetry analytics and corpus processing on Spark."""
