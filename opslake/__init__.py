"""Telemetry and incident analytics expressed as Spark DataFrame operators."""
