"""Time-window analytics on Spark."""
