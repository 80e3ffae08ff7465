"""Relational operators: each module is one family of DataFrame transformations."""
