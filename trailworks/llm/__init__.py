"""Training-data operators: token counts, encoding, decontamination, quality, dedup, sharding, PII, search, secrets,
manifests, spelling variants and URL filters.

Nothing else in the library imports this package.
"""
