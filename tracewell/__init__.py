"""tracewell: session-log analytics on PySpark DataFrames."""
