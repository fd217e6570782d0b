"""Agent-session analytics as Spark DataFrames."""
