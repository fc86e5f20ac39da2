"""Readers, writers and adapters that give pixel tables."""
