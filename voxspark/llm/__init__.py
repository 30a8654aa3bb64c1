"""Training-data operators: filtering, de-duplication, mixing, sharding, tokenising and formatting.

Nothing outside this package imports it. Every operator takes and returns Spark DataFrames.
"""
