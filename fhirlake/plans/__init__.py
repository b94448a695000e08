"""Composed plans: silver models, quality contract, named analysis reports."""
