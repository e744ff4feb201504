"""Sensor-log, spatial-mapping and telemetry operators on PySpark DataFrames."""
