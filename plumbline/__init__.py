"""Spark-first retrieval, calibration, ranking and field analytics."""
