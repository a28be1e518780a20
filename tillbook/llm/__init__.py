"""Training-data operators: dedup, mixing, sharding, fingerprints, language, URLs, captures, quality, leaks, joins.

Nothing else in the library imports this subpackage.
"""
