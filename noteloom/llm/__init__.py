"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin registered queries and their SQL.
"""
