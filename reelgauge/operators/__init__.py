"""Relational, text-mining and learning operators."""
