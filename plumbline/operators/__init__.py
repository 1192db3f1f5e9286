"""Operators over DataFrames of rules, chunks, cases and verdicts."""
