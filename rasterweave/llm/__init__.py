"""Training-data operators: language ID, near-duplicate joins, quality, token
files, HTML extraction, URL rules, archives, decontamination, embeddings, packing.

Nothing outside this subpackage imports it.
"""
