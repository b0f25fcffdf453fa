"""Operators for preparing training text: scoring, deduplication, mixing, decontamination, search, output."""
