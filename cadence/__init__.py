"""Cadence: lineup, interval and event analytics as Spark jobs."""
