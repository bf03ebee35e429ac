"""Operators of a training-data pipeline: shard, mix, search, fingerprint, identify, deduplicate,
format, tokenize, join and scan."""
