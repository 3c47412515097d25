"""Training-data operators: search, deduplication, classification, filtering, mixing and tokenizing on Spark.

Nothing outside this package imports it.
"""
