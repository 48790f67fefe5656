"""Operators of a training-data pipeline: scoring, deduplication, decontamination, extraction and mixing.

Nothing else in the package imports this folder.
"""
