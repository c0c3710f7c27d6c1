"""Operators for preparing training text: filters, deduplication, decontamination, formatting and packing.

Nothing outside this folder imports it.
"""
