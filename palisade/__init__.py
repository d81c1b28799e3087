"""Palisade: Spark-native analytics over source text, dependency inventories and scan telemetry."""
