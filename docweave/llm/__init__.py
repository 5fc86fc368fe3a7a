"""Training-data operators: dedup, tokenising, scanning, scoring, packing and archives.

Nothing else in the library imports this subpackage.
"""
