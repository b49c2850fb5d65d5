"""Training-data operators: quality rules, mixing, toxicity, PII, licences, LM scoring,
sharding, decontamination, quality classifier, n-gram Jaccard join, fill-in-the-middle, token ids
and source divergence.

Nothing outside this subpackage imports it.
"""
