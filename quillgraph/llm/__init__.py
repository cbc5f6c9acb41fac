"""Operators for preparing training text at corpus scale.

Every operator takes DataFrames and returns a DataFrame; ``queries.py`` registers
one query for each. Nothing outside this subpackage imports it.
"""
