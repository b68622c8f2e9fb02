"""Training-data operators: deduplication, language, tokens, pages, media, leaks, toxicity, secrets.

Nothing else in the library imports this package; it may be removed as a whole.
"""
