"""Operators for large-scale training-data preparation.

Ten operators, each in its own module with a general interface, and the
named queries that apply them to the shared tables (``queries``). Nothing
in the rest of the library imports this subpackage.
"""
