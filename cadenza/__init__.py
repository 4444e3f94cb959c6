"""Periodic-signal analytics as DataFrame-to-DataFrame operators on Spark."""
