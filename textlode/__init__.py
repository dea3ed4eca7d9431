"""textlode: positional full-text search on Spark DataFrames."""
