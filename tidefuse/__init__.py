"""Telemetry fusion and anomaly labelling as Spark DataFrame operators."""
