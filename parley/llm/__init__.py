"""Operators for preparing training corpora: one module for each operator.

Nothing outside this folder imports it.  ``queries.py`` holds the thin queries
that apply each operator to the driver's tables.
"""
