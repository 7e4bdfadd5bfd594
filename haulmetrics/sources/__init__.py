"""Readers, sinks and the telemetry view over the driver's tables."""
