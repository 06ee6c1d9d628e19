"""Relational operators over clauses, terms, hits and answers."""
