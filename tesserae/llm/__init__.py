"""Training-data operators: dedup, scans, mixing, packing, classification and nearest neighbours.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
