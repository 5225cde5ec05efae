"""Operators for preparing training data: each module is one method, ``catalog`` its queries."""
