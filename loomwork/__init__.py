"""loomwork: analytics on PySpark DataFrames, SQL and Structured Streaming."""
