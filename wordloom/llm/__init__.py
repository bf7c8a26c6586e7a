"""Training-data operators: tokenisers, packing, near-duplicate search, language models and sharding.

Nothing outside this package imports it; it can be removed as a whole.
"""
