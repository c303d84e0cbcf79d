"""Model-telemetry analytics as PySpark DataFrame jobs."""
