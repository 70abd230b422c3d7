"""Telemetry medallion analytics expressed as Spark DataFrame operators."""
