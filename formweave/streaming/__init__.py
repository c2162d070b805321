"""Structured Streaming forms of the telemetry measures."""
