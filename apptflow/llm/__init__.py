"""Operators for preparing training data, their queries and oracle SQL.

Nothing else in the library imports this subpackage.
"""
