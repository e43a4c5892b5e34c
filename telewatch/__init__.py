"""Reliability and anomaly analytics for sensor networks, written as Spark DataFrame operations."""
