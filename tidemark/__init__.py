"""Event-centric web-archive analytics, expressed with Spark DataFrames."""
