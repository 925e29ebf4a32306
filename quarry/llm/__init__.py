"""Training-data operators: mixing, quality, language, dedup, toxicity, packing, WARC, LM scoring.

Nothing else in the library imports this subpackage. ``queries`` holds the thin
per-operator queries; each operator module keeps its own general interface.
"""
