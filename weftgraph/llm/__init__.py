"""Operators on texts, source files and vectors for corpus preparation. Nothing outside this package imports it."""
