"""Build telemetry and dependency-graph analytics on Spark DataFrames."""
