"""Operators for building training corpora: sharding, packing, quality, archives, dedup.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when
it is present.
"""
