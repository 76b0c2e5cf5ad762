"""Mesh-router telemetry on Spark: extraction, enrichment, rates, panels and streams."""
