"""Endpoint-telemetry analytics on PySpark: normalise, detect, store, search, summarise, featurise, model."""
