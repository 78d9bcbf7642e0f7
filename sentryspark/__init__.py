"""PySpark-native analytics for decoy-sensor telemetry."""
