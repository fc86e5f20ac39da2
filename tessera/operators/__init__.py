"""Relational and grid operators on pixel tables."""
