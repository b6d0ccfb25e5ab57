"""Training-data operators: deduplication, classifiers, fingerprints, tokens and packing.

Nothing else in the library imports this subpackage.
"""
