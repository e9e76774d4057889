"""Event-time sensor analytics on Spark."""
