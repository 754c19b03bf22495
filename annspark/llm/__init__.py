"""Operators for preparing training data: filters, near-duplicates, mixing, tokens, chat.

Nothing else in the library imports this subpackage. Each module holds one operator with
its own interface; ``queries.py`` registers one query per operator.
"""
