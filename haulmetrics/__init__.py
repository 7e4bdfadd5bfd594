"""Fleet-telemetry analytics as Spark DataFrame jobs."""
