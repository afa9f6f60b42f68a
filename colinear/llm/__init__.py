"""Training-data operators: sharding, dedup, mixing, classifiers, search and formatting.

Nothing outside this package imports it.  ``llm.queries`` holds the thin queries.
"""
