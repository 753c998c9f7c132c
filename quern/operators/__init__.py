"""Relational operators of the engine: best rows, cleaners, profile, quality gate."""
