"""Finding, redacting and measuring sensitive data with Spark DataFrames."""
