"""Training-data operators: filtering, scoring, extraction, mixing, search, deduplication.

Nothing else in the library imports this subpackage.  Each operator module
holds a general ``DataFrame -> DataFrame`` interface; ``queries.py`` registers
the thin contract queries on top of them.
"""
