"""Operators for preparing training text: ten of them, and the queries that apply them to whole tables."""
