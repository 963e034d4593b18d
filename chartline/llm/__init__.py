"""Operators of a training-data pipeline: search, dedup, packing, personal data, mixing, quality, storage.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries where it is present.
"""
