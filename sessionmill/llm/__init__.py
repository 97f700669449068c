"""Operators for preparing training text at scale.

Each module holds one operator with its own interface; ``queries`` registers one query per operator
with production parameters. Nothing outside this folder imports it.
"""
