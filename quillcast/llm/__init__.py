"""Operators of a training-data pipeline: line and document dedup, extraction, scoring, mixing and formatting.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers the thin queries.
"""
