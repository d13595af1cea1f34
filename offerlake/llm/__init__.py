"""Training-data operators: license scan, BPE, token shards, language id,
n-gram join, decontamination, WARC, toxicity, streaming dedup, secret scan.

Nothing else in the library imports this package.
"""
