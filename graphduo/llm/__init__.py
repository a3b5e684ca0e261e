"""Training-data operators (near-duplicates, fingerprints, tokens, language, mixing, leaks, HTML).

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
