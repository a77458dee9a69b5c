"""Campaign measurement on Spark."""
